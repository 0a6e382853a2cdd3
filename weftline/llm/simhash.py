"""SimHash near-duplicate detection by tiled exact comparison.

1. `fingerprints`: one pass over the texts, hashes and majority bits in numpy.
2. Equal fingerprints collapse to one row, so groups of copies cost nothing.
3. `links`: fingerprints fall into groups by the population counts of their two
   low 16-bit quarters, groups into tiles of about `tile` rows. Pairs of tiles
   whose counts differ by more than the radius can't hold a link and are never
   built; inside a pair only rows whose counts of the other 32 bits are within
   what is left of the radius are compared, by exclusive or and bit counts.
   A pair of tiles returns a spanning forest of its links (no link between
   components is lost), so dense groups don't return all their pairs. A tile
   travels once for each partner; up to TILE fingerprints of a group are one
   tile, with some 25 partners, however many documents there are.
4. `components`: alternating star contraction over the forest edges.

The comparison is exact, and quadratic in the number of distinct fingerprints
with a small factor: it visits about a tenth of all pairs. Wider fingerprints and
radii, for a similarity of shingles, are in `near_copies`.

Defined results: a null text counts as empty; a text without words has the
fingerprint zero and is linked like any other; a null doc_id is never a
component's smallest id unless the component has no other; repeated rows each
give a row; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import cut, table

RADIUS = 3
SHINGLE = 3
#: Fingerprints of a tile: half a megabyte, compared in blocks of BLOCK rows.
TILE = 65_536
BLOCK = 64
#: Hashes whose bits are counted at once.
COUNTED = 16_384
#: A fingerprint of more than one in HOT documents is hot; there are fewer than HOT of these.
HOT = 1000


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    n = max(1, len(words) - SHINGLE + 1)
    return int(majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)[:, None])[0])


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the rows of `hashes` (n x words of 64 bits)."""
    octets, ones = hashes.view(np.uint8).reshape(len(hashes), -1), 0
    for k in range(0, len(octets), COUNTED):
        ones = ones + np.unpackbits(octets[k : k + COUNTED], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def _fingerprint_batches(batches):
    for batch in batches:
        got = np.array([fingerprint(t.as_py()) for t in batch.column(2)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got.view(np.int64))], names=["doc_id", "carry", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """(doc_id, carry, fp): the 64 bits of the fingerprint as a long; `carry` is a column of longs handed through."""
    more = (F.col(carry) if carry else F.lit(None)).cast("long").alias("carry")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), more, F.col(text).alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, carry long, fp long")


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable for each of n nodes over the edges i-j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


#: Edges that a forest holds before it merges them.
PENDING = 200_000


class Forest:
    """Components of n nodes under edges that come in parts; edges within a component are dropped at once, so a dense group costs no more than its nodes."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j = self.label[i], self.label[j]
        fresh = i != j
        if fresh.any():
            self.edges.append((i[fresh], j[fresh]))
            self.size += int(fresh.sum())
            if self.size >= PENDING:
                self.merge()

    def merge(self) -> np.ndarray:
        """The smallest node of each node's component."""
        if self.edges:
            i, j = (np.concatenate(x) for x in zip(*self.edges, strict=True))
            self.label = _forest(i, j, len(self.label))[self.label]
            self.edges, self.size = [], 0
        return self.label


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, spent: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges between the fingerprints of two tiles; `spent` of the radius is used up by the groups' counts."""
    rest = lambda x: np.bitwise_count(x >> np.uint64(32))
    a = a[np.argsort(rest(a), kind="stable")]
    b = a if same else b[np.argsort(rest(b), kind="stable")]
    left, pa_, pb = radius - spent, rest(a).astype(np.int64), rest(b).astype(np.int64)
    nodes = a if same else np.concatenate([a, b])
    forest = Forest(len(nodes))
    for count in np.unique(pa_):
        lo, hi = np.searchsorted(pa_, [count, count + 1])
        blo, bhi = np.searchsorted(pb, [count - left, count + left + 1])
        if blo >= bhi:
            continue
        for k in range(lo, hi, BLOCK):
            near = np.bitwise_count(a[k : min(k + BLOCK, hi), None] ^ b[None, blo:bhi]) <= radius
            i, j = np.nonzero(near)
            forest.add(i + k, j + blo + (0 if same else len(a)))
    label = forest.merge()
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def _link_batches(batches):
    for batch in batches:
        for a, b, same, spent in zip(batch.column("a"), batch.column("b"), batch.column("same"), batch.column("spent"), strict=True):
            u, v = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (a, b))
            x, y = tile_links(u, v, same.as_py(), spent.as_py())
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["u", "v"])


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v): a forest that spans the links between the distinct fingerprints `fp`.

    At most 289 group counts reach the driver.
    """
    spark = distinct.sparkSession
    quarter = lambda k: F.bit_count(F.shiftright("fp", 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long")))
    rows = distinct.select("fp", quarter(0).alias("p"), quarter(1).alias("q"))
    counts = {(r.p, r.q): r["count"] for r in rows.groupBy("p", "q").count().collect()}
    if not counts:
        return spark.createDataFrame([], "u long, v long")
    groups = [{"p": p, "q": q, "n": -(-n // tile)} for (p, q), n in sorted(counts.items())]
    listed = ",".join(f"({g['p']},{g['q']},{g['n']})" for g in groups)
    table_ = spark.sql(f"select col1 as p, col2 as q, col3 as n from values {listed}")
    rows = rows.join(F.broadcast(table_), ["p", "q"])
    tiles = rows.groupBy("p", "q", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int").alias("t")).agg(F.collect_list("fp").alias("fps"))
    tiles = cut(tiles, "tiles")
    # pairs of tiles, each once, of groups within the radius
    one = table_.select(F.col("p").alias("p1"), F.col("q").alias("q1"), F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("t1"))
    span = range(-radius, radius + 1)
    steps = F.from_json(F.lit(json.dumps([{"dp": x, "dq": y} for x in span for y in span if abs(x) + abs(y) <= radius])), "array<struct<dp:int,dq:int>>")
    near = one.select("p1", "q1", "t1", F.explode(steps).alias("d")).select("p1", "q1", "t1", (F.col("p1") + F.col("d.dp")).alias("p2"), (F.col("q1") + F.col("d.dq")).alias("q2"))
    near = near.join(F.broadcast(table_.select(F.col("p").alias("p2"), F.col("q").alias("q2"), "n")), ["p2", "q2"])
    near = near.withColumn("t2", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    key = lambda k: F.struct(f"p{k}", f"q{k}", f"t{k}")
    near = near.where(key(1) <= key(2)).select("p1", "q1", "t1", "p2", "q2", "t2")
    side = lambda k, name: tiles.select(F.col("p").alias(f"p{k}"), F.col("q").alias(f"q{k}"), F.col("t").alias(f"t{k}"), F.col("fps").alias(name))
    pairs = near.join(side(1, "a"), ["p1", "q1", "t1"]).join(side(2, "b"), ["p2", "q2", "t2"])
    pairs = pairs.select("a", "b", (key(1) == key(2)).alias("same"), (F.abs(F.col("p1") - F.col("p2")) + F.abs(F.col("q1") - F.col("q2"))).alias("spent"))
    width = 4 * spark.sparkContext.defaultParallelism
    return pairs.repartition(width).mapInArrow(_link_batches, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of `edges` but the roots themselves: alternating large-star and small-star rounds.

    Each round is written; the rounds grow with the logarithm of the longest
    path, and minima are partially aggregated, so a hub is no hot spot.
    """
    least = lambda d: d.groupBy("u").agg(F.min("v").alias("m"))
    turn = lambda d: d.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    state = cut(turn(edges), "edges")
    mark = lambda d: tuple(d.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    seen = mark(state)
    while seen[0]:
        size = 2 * seen[0]  # a step gives each edge one or two in return
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = cut(turn(large), "edges", size)
        low = least(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        state = cut(turn(small), "edges", size)
        now = mark(state)
        if now == seen:
            break
        seen = now
    return state.select("u", F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, the document's own included.

    Documents find their component by a join on the fingerprint; the fingerprints
    of large groups of copies, fewer than HOT, are joined by broadcast instead.
    """
    found = cut(fingerprints(docs, doc_id, text).drop("carry"), "fingerprints")
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct, radius, tile)).withColumnRenamed("u", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = cut(rooted.join(least, "root").select("fp", "n", "component_id"), "placed")
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = placed.where(F.col("n") * HOT > total).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    marked = found.join(F.broadcast(hot), "fp", "left")
    rest = marked.where("hot is null").select("doc_id", "fp").join(placed.where(F.col("n") * HOT <= total), "fp")
    return marked.where("hot").select("doc_id", "fp", F.col("hot_id").alias("component_id")).unionByName(rest.select("doc_id", "fp", "component_id"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
