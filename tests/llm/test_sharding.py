import collections
import random
import struct
import zlib

import xxhash
from pyspark.sql import functions as F

from weftline.llm import sharding


def test_exact_sizes_and_slots(spark):
    rows = sharding.op2_shard(spark, "/root/testdata/sf0.001").collect()
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    sizes = [len(shards[k]) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 16 for r in rows)


def xx64(seed, *longs):
    """Spark's hash of longs (a literal int first)."""
    h = 42
    for k, x in enumerate((seed, *longs)):
        h = xxhash.xxh64_intdigest(struct.pack("<i" if k == 0 else "<q", x), h)
    return h - (1 << 64) if h >> 63 else h


def test_against_a_plain_version(spark):
    """The same hashes, partitions, matrix, local orders and blocks in plain Python."""
    d = spark.range(700).coalesce(1).selectExpr("id as doc_id")
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.assign_shards(d, shards=7, parts=16, blocks=3, seed=11).collect()}
    rows = [(xx64(11, i), i) for i in range(700)]
    part = {r: xx64(12, *r) % 16 for r in rows}
    known = sorted(set(part.values()))
    counts = [sum(p == k for p in part.values()) for k in known]
    matrix = sharding.communication_matrix(counts, [100] * 7, 11)
    shard = {}
    for p, dealt in zip(known, matrix, strict=True):
        mine = sorted((r for r in rows if part[r] == p), key=lambda r: (xx64(13, *r), r))
        for j, k in enumerate(dealt):
            shard |= dict.fromkeys(mine[:k], j)
            mine = mine[k:]
    want = {}
    for j in range(7):
        mine = sorted((r for r in rows if shard[r] == j), key=lambda r: (xx64(14, *r) % 3, xx64(15, *r), r))
        want |= {r[1]: (j, k) for k, r in enumerate(mine)}
    assert got == want


def test_names_that_clash_and_a_hot_row(spark):
    d = spark.createDataFrame([(7, k % 3, 1, "a", 5) for k in range(3000)] + [(None, 1, 2, None, 6)] * 2000, "doc_id long, part int, p int, upto string, slot int").withColumns({"row": F.lit(1), "h": F.lit(2), "block": F.lit("x"), "r": F.lit(0.5)})
    out = sharding.assign_shards(d, shards=5)
    assert out.columns == ["doc_id", "part", "p", "upto", "row", "h", "block", "r", "shard", "slot"]
    rows = out.collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(j, k) for j in range(5) for k in range(1000)]
    hot = [sum(r.doc_id is None for r in rows if r.shard == j) for j in range(5)]
    assert all(320 < n < 480 for n in hot) and sum(hot) == 2000
    early = sum(r.doc_id is None for r in rows if r.slot < 200)
    assert 320 < early < 480


def test_matrix_margins():
    counts, sizes = [5, 0, 100, 3_000_000_000], [777, 0, 2_999_999_328]
    m = sharding.communication_matrix(counts, sizes, 1)
    assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m)] == sizes


def test_hypergeometric_law():
    rng = random.Random(5)
    x = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)]
    mean = sum(x) / len(x)
    var = sum((v - mean) ** 2 for v in x) / len(x)
    assert abs(mean - 6) < 0.05 and abs(var - 20 * 0.3 * 0.7 * 80 / 99) < 0.15
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0


def test_uniform_over_shards(spark):
    # rows of one virtual partition should spread over shards
    d = spark.range(4000).withColumnRenamed("id", "doc_id")
    first = sharding.assign_shards(d, shards=4, seed=1).where("doc_id < 400").groupBy("shard").count().collect()
    assert all(60 < r["count"] < 140 for r in first)


def test_odd_rows(spark):
    d = spark.createDataFrame([(None, 1), (None, 1), (3, 2)], "doc_id long, a int")
    got = sharding.assign_shards(d, shards=2).collect()
    assert sorted(r.shard for r in got) in ([0, 0, 1],) and len({(r.shard, r.slot) for r in got}) == 3
    assert sharding.assign_shards(d.where("a > 5")).collect() == []
