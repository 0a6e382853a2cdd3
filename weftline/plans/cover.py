"""Greedy cover: few probe terms that find every document.

One pass turns the documents into (path, term) rows, letters and words, written
once. A round counts the uncovered rows of each term, takes the best one, and
keeps the documents without it: a partial aggregation and an anti join. Only the
chosen term reaches the driver, and the rounds are bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.search import words
from weftline.plans.crawl import written

ROUNDS = 12


def terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """(path, pool, term): the letters of the text as they are, and its folded words of 4 to 24 letters."""
    letters = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}"), F.lit(0)))
    a = docs.select("path", F.lit(0).alias("pool"), F.explode(letters).alias("term"))
    b = words(docs, text).where(F.length("word").between(4, 24)).select("path", F.lit(1).alias("pool"), F.col("word").alias("term"))
    return a.unionByName(b)


def greedy_cover(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(round, term, covered): letters before words, then the most documents, then the alphabet.

    A row without a term, if any, counts the documents that stay uncovered after
    the last round. After a round only the terms of uncovered documents are kept.
    """
    spark, out = docs.sparkSession, []
    table = written(terms(docs, text))
    left = docs.select("path").distinct().count()
    for k in range(1, rounds + 1):
        best = table.groupBy("pool", "term").agg(F.count("*").alias("n")).orderBy("pool", F.desc("n"), "term").first()
        if best is None:
            break
        out.append((k, best.term, best.n))
        left -= best.n
        hit = table.where((F.col("pool") == best.pool) & (F.col("term") == best.term)).select("path")
        table = written(table.join(hit, "path", "left_anti"))
    if left:
        out.append((None, None, left))
    return spark.createDataFrame(out, "round int, term string, covered long")
