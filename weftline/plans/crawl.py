"""Crawling as a breadth-first traversal of a captured link table.

Each round is an anti join of the frontier's targets with what was seen. Rounds
are written to the shared folder, so plans stay small and a lost executor costs
a reread.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", got := f"file://{made}")
    return got.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crawl(edges: DataFrame, seeds: DataFrame, max_pages: int | None = None, max_rounds: int | None = None) -> DataFrame:
    """(url, round, source): what is reachable over edges (src, dst) from seeds (url, source).

    Rounds go on until one finds nothing new, or for `max_rounds` where given.
    With `max_pages`, a round admits the first URLs in order until the cap is met.
    """
    frontier = seeds.select("url", F.lit(0).alias("round"), "source").dropDuplicates(["url"])
    if max_pages is not None:
        frontier = frontier.orderBy("url").limit(max_pages)
    frontier = written(frontier)
    seen, n = frontier, frontier.count()
    for k in count(1) if max_rounds is None else range(1, max_rounds + 1):
        if max_pages is not None and n >= max_pages:
            break
        hops = edges.join(frontier.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        fresh = hops.join(seen.select("url"), "url", "left_anti").select("url", F.lit(k).alias("round"), F.lit("link").alias("source"))
        if max_pages is not None:
            fresh = fresh.orderBy("url").limit(max_pages - n)
        frontier = written(fresh)
        got = frontier.count()
        if not got:
            break
        n += got
        # each round's folder stays as it is; reading many of them is cheaper than writing what was seen again
        seen = seen.unionByName(frontier)
        if k % 16 == 0:
            seen = written(seen)
    return seen


def exclusive_assets(edges: DataFrame, used: DataFrame, seeds: DataFrame, levels: int = 3) -> DataFrame:
    """(url, round) of assets that only the seeds need, followed through style sheets for at most three levels."""
    found = crawl(edges, seeds.select("url", F.lit("seed").alias("source")), max_rounds=levels)
    return found.join(used.select("url"), "url", "left_anti").select("url", "round")
