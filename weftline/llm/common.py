"""Shared pieces: reading inputs, whole-text helpers, cutting lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: ASCII white space of the word rules, in Java's patterns exactly this: blank, \t, \n, \x0B, \f, \r.
SPACES = r"\s+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The whole text; a null text counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def spaced_words(text: Column) -> Column:
    """Array of maximal runs of anything but ASCII white space."""
    core = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, with a local master only, a temporary one where that is unset."""
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", got := f"file://{made}")
    return got.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{shared_dir(spark)}/weftline-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a file that `cut` writes, at least, where it is told how many there are.
FILE_ROWS = 200_000


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    Ends the lineage: a lost executor costs a reread, not a recomputation, and
    what is used twice is computed once. Given a bound of its `rows`, few rows
    go to few files.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Delete what `cut` has written for this application; call it when all results are stored."""
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


SPAN = "array<struct<start:int,end:int,text:string>>"


def spans(text: Column, pattern: Column) -> Column:
    """Leftmost non-overlapping matches of a Java regex, with code point offsets (end exclusive).

    The pattern must not match the empty string. Offsets come from the lengths
    of the pieces between matches, so no user function is needed.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("h"))
    parts = F.transform(parts, lambda x: F.struct(F.length(x["p"]).alias("gap"), x["h"].alias("hit")))
    return F.get(F.transform(F.array(parts), _placed), F.lit(0))


#: Arrays are appended to in blocks of so many, as each append copies what is there.
BLOCK = 256


def blocks(items: Column) -> Column:
    """An array of arrays of at most BLOCK items."""
    count = F.ceil(F.size(items) / BLOCK).cast("int")
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(items, k * BLOCK + 1, BLOCK))).otherwise(F.array())


def _placed(parts: Column) -> Column:
    """Spans of (gap, hit) pieces; offsets within blocks first, then those of the blocks."""

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        found = F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("text"))
        return F.struct(
            (start + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
            F.when(x["hit"].isNull(), a["out"]).otherwise(F.array_append(a["out"], found)).alias("out"),
        )

    def join(a: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda s: F.struct((s["start"] + a["at"]).alias("start"), (s["end"] + a["at"]).alias("end"), s["text"].alias("text")))
        return F.struct((a["at"] + x["at"]).alias("at"), F.array_append(a["out"], moved).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    each = F.transform(blocks(parts), lambda b: F.aggregate(b, zero, step))
    return F.flatten(F.aggregate(each, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), join, lambda a: a["out"]))


def anchored(value: Column) -> Column:
    """`value`, in a form through which Catalyst pushes no filter.

    A filter on a result would otherwise be rewritten over the whole chain of
    array expressions behind it, with each reference written out in full, at a
    cost that grows with the square of the text.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """`df` where `condition` holds, evaluated once above the projections below it.

    Catalyst pushes a filter through projections by writing their expressions
    into it; a condition on a long chain of array expressions would then be
    evaluated again, each reference in full. A column that isn't deterministic,
    and is true of every row, stops that.
    """
    return df.withColumn("__bar", F.monotonically_increasing_id()).where(condition & (F.col("__bar") >= 0)).drop("__bar")
