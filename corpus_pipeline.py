"""Corpus pipeline: quality rules, near-dedup, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and returns a DataFrame; all but the last return the columns of `documents`.
Rows are carried as one struct, so columns that bear an operator's output name
come through unharmed. Null doc_ids and repeated doc_ids are told apart by the
hash of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontam, near_copies, packing, quality, secret_scan
from weftline.llm.common import cut, keep_where, table, whole_text


def _carried(docs: DataFrame) -> DataFrame:
    """(text, row): the row as one struct beside the text the operator reads."""
    return docs.select("text", F.struct("*").alias("row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.score_quality(_carried(docs)).select("row", "kept")
    return keep_where(judged, F.col("kept")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 at least."""
    return near_copies.deduplicate(docs).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64(whole_text()).cast("string"))
    keyed = docs.withColumn("__key", key)
    found = decontam.contaminated(keyed, table(spark, sf_dir, "benchmark"), doc_id="__key").select(F.col("doc_id").alias("__bad")).distinct()
    return keyed.join(found, F.col("__key") == F.col("__bad"), "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text."""
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    out = secret_scan.scan_secrets(rows)
    text = F.when(F.size("secrets") > 0, secret_scan.redact(F.col("text"), F.col("secrets"))).otherwise(F.col("text"))
    out = out.select("row", text.alias("clean"), (F.size("secrets") > 0).alias("hit"))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("hit"), F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("clean")}
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.digest(packing.pack_documents(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("pack", pack),
]

#: SQL can't express the components of near copies and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
