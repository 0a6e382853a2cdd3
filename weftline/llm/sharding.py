"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. Rows fall into `parts` virtual partitions by a seeded hash; only the counts
   of the partitions (at most `parts` numbers) reach the driver.
2. The driver draws the communication matrix: row i says how many rows of
   partition i go to each shard. Drawn row by row from the multivariate
   hypergeometric law of the capacity that is left, so it has exactly the
   distribution that a uniform permutation of all rows would give.
3. Each partition permutes its rows locally and deals them out by its row of
   the matrix: the exchange.
4. Each shard permutes again: rows fall into hashed blocks in random order and
   are ordered by another hash inside a block, so a shard of any size is
   numbered by many tasks. Block offsets make the slots gapless.

Orders hash all columns of a row, and rows that agree in all of them are told
apart by their place in the input, so neither a null key nor a repeated one
gathers rows in one partition or block. The first pass writes each row with its
hashes; everything after is a function of what is written and the seed, so a lost
executor's tasks give the same rows again. Partitions and blocks are as many as
keep each at about HELD rows.

Defined results: a null text has no bytes; a null doc_id is a value like any
other; repeated rows are interchangeable and get slots of their own; an empty
table gives an empty table; input columns pass through whatever their names,
except `shard` and `slot`, which are replaced.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, table, whole_text

SEED = 20_240_607


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` without replacement are good; inversion outward from the mode, any population size."""
    low, high = max(0, draws - bad), min(good, draws)
    if low >= high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u, up, down, i, j = rng.random() - p, p, p, mode, mode
    while u > 0 and (i < high or j > low):
        if i < high:
            up *= (good - i) * (draws - i) / ((i + 1) * (bad - draws + i + 1))
            i += 1
            if (u := u - up) <= 0:
                return i
        if j > low:
            down *= j * (bad - draws + j) / ((good - j + 1) * (draws - j + 1))
            j -= 1
            if (u := u - down) <= 0:
                return j
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of counts per shard; row sums are `counts`, column sums are `sizes`."""
    rng, left = random.Random(seed), list(sizes)
    out = []
    for n in counts:
        row, rest, open_ = [], sum(left), n
        for j, room in enumerate(left):
            rest -= room
            row.append(open_ if j == len(left) - 1 else hypergeometric(rng, room, rest, open_))
            open_ -= row[-1]
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


#: Rows of a virtual partition and of a block, about; and the most virtual partitions, as the matrix is drawn on the driver.
HELD, MOST_PARTS = 100_000, 16_384


def assign_shards(rows: DataFrame, shards: int = 40, parts: int | None = None, blocks: int | None = None, seed: int = SEED) -> DataFrame:
    """`rows` with `shard` (counts at most one apart) and `slot` (gapless from 0 in its shard).

    Hand in narrow rows: they are written twice and sorted twice. The broadcast
    tables hold parts x shards and shards x blocks numbers: a number for each
    HELD rows and shard, and at most MOST_PARTS x shards.
    """
    spark, names = rows.sparkSession, [c for c in rows.columns if c not in ("shard", "slot")]
    hashed = [F.col(c) for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    once = F.xxhash64(F.lit(seed), *hashed)
    # the row number tells repeated rows apart; it is written before it is used, so it stays what it was
    rows = cut(rows.select(F.struct(*names).alias("row"), once.alias("h"), F.monotonically_increasing_id().alias("n")), "rows")
    total = rows.count()
    parts = parts or min(MOST_PARTS, max(64, -(-total // HELD)))
    blocks = blocks or max(8, -(-total // (shards * HELD)))
    order = lambda k: F.xxhash64(F.lit(seed + k), "h", "n")
    rows = rows.withColumn("part", F.pmod(order(1), F.lit(parts)).cast("int"))
    found = {r[0]: r[1] for r in rows.groupBy("part").count().collect()}
    known = sorted(found)
    matrix = communication_matrix([found[p] for p in known], [total // shards + (j < total % shards) for j in range(shards)], seed)
    dealt = [{"part": p, "upto": [sum(row[: j + 1]) for j in range(shards)]} for p, row in zip(known, matrix, strict=True)]
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(dealt)), "array<struct<part:int,upto:array<bigint>>>")))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(order(2), "h", "n")))
    rows = rows.join(F.broadcast(plan), "part")
    rows = rows.withColumn("shard", F.size(F.filter("upto", lambda c: c < F.col("r")))).withColumn("block", F.pmod(order(3), F.lit(blocks)).cast("int"))
    placed = cut(rows.select("row", "h", "n", "shard", "block"), "sharded")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "block").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("shard", "block").orderBy(order(4), "h", "n")
    out = placed.withColumn("r", F.row_number().over(inside)).join(F.broadcast(starts), ["shard", "block"])
    return out.select("row.*", "shard", (F.col("start") + F.col("r") - 1).cast("long").alias("slot"))


def row_size(text: Column) -> Column:
    return (F.octet_length(text) + 16).cast("long")


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = whole_text()
    rows = table(spark, sf_dir, "documents").select("doc_id", row_size(t).alias("size"), F.crc32(t).alias("text_crc32"))
    out = assign_shards(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
