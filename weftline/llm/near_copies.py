"""Near copies by the Jaccard similarity of word shingles: SimHash finds candidates, each link is verified exactly.

The three bits of `simhash` are too few for a similarity of 0.8, at which a
tenth to a fifth of all bits differ. So this is the same tiled comparison with
fingerprints of 128 bits over the set of five-word shingles and a wider radius:

1. `sketches`: one pass over the texts. Equal word sequences are one node, so
   groups of copies cost nothing.
2. `candidates`: nodes fall into classes of size, as sets whose sizes differ by
   more than 5/4 can't be similar, and of population count; classes into tiles.
   Pairs of tiles whose sizes or population counts are too far apart are never
   built. Within a pair, exclusive or and bit counts; a spanning forest returns.
3. `links`: only texts in a component of candidates are read again. Their shingle
   sets fall into tiles by component and size; all pairs of a component whose
   sizes allow the similarity are compared exactly, and each pair of tiles returns
   a spanning forest of its links. Nothing is linked that wasn't compared.
4. The components of the links are the groups of near copies.

Of two sets at exactly the least similarity a bit differs with probability
arccos(8/9)/pi = 0.151, so 19.4 of 128 bits in the mean with a deviation of 4.1:
RADIUS is three deviations further. Unrelated texts differ in 64 with a deviation
of 5.7, so few of their pairs are candidates, and none is linked.

Defined results: a null text counts as empty; texts without words are copies of
each other; a text shorter than a shingle is one shingle; of rows that agree in
doc_id and text the one with the smallest hash of all columns stays; an empty
table gives an empty table; extra columns pass through.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut
from weftline.llm.simhash import BLOCK, Forest, components, majority

SHINGLE = 5
RADIUS = 32
#: Fingerprints of a tile of candidates, shingles of a tile of sets, population counts of a class.
PRINTS, TILE, COUNTS = 16_384, 65_536, 16


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only


def _runs(ws: list[bytes]):
    return map(b" ".join, zip(*(ws[k:] for k in range(SHINGLE)))) if len(ws) >= SHINGLE else [b" ".join(ws)]


def shingles(ws: list[bytes]) -> np.ndarray:
    """Distinct hashes of the runs of SHINGLE words, in order; a shorter text is one run."""
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, _runs(ws), repeat(42)), np.uint64, max(1, len(ws) - SHINGLE + 1)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A second word of bits for each hash: multiply and shift, twice."""
    for factor in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def wide_print(found: np.ndarray) -> np.ndarray:
    """128 bits, as two words, of a set of shingles."""
    return majority(np.stack([found, _mixed(found)], axis=1))


def _sketch(text: str | None) -> tuple[int, int, int, int]:
    """(node, number of shingles, both words of the fingerprint) of one text."""
    ws = words(text)
    found = shingles(ws)
    return xxhash.xxh64_intdigest(b" ".join(ws)), len(found), *map(int, wide_print(found))


def _sketch_batches(batches):
    for batch in batches:
        got = np.array([_sketch(t.as_py()) for t in batch.column(3)], np.uint64).reshape(-1, 4).view(np.int64)
        columns = [*(batch.column(k) for k in range(3)), *(pa.array(got[:, k]) for k in range(4))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", "row", "node", "n", "f", "g"])


def print_links(a: np.ndarray, b: np.ndarray, radius: int = RADIUS):
    """Places (i in a, j in b) of the pairs of fingerprints (n x 2 words) within the radius, a block at a time."""
    for k in range(0, len(a), BLOCK):
        far = np.bitwise_count(a[k : k + BLOCK, None, 0] ^ b[None, :, 0])
        far += np.bitwise_count(a[k : k + BLOCK, None, 1] ^ b[None, :, 1])
        i, j = np.nonzero(far <= radius)
        yield i + k, j


def _candidate_batches(batches):
    for batch in batches:
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            (u, x), (v, y) = ((t["nodes"].values.to_numpy(zero_copy_only=False), np.stack([t[c].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in ("f", "g")], axis=1)) for t in (a, b))
            yield from _spanning(np.concatenate([u, v]), ((i, len(u) + j) for i, j in print_links(x, y)))


def _spanning(nodes: np.ndarray, edges):
    """A forest that spans edges (arrays of places, in parts) of `nodes`, which may repeat."""
    known, place = np.unique(nodes, return_inverse=True)
    forest = Forest(len(known))
    for i, j in edges:
        forest.add(place[i], place[j])
    label = forest.merge()
    moved = np.nonzero(label != np.arange(len(known)))[0]
    if len(moved):
        yield pa.RecordBatch.from_arrays([pa.array(known[moved]), pa.array(known[label[moved]])], names=["u", "v"])


def _size_class(n: Column) -> Column:
    # sizes of similar sets differ by a factor of 5/4 at most; the factor here is a little less, so they are two classes apart at most
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.2499))).cast("int")


def candidates(nodes: DataFrame, tile: int = PRINTS) -> DataFrame:
    """(u, v): a forest that spans the pairs of `nodes` (node, n, f, g) within the radius; at most some hundred counts reach the driver."""
    spark = nodes.sparkSession
    count = F.bit_count("f") + F.bit_count("g")
    rows = nodes.select("node", "f", "g", _size_class(F.col("n")).alias("s"), F.floor(count / COUNTS).cast("int").alias("p"))
    counted = {(r.s, r.p): r["count"] for r in rows.groupBy("s", "p").count().collect()}
    if not counted:
        return spark.createDataFrame([], "u long, v long")
    split = {k: -(-n // tile) for k, n in counted.items()}
    table_ = spark.sql("select col1 as s, col2 as p, col3 as n from values " + ",".join(f"({s},{p},{n})" for (s, p), n in sorted(split.items())))
    rows = rows.join(F.broadcast(table_), ["s", "p"]).withColumn("t", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    tiles = cut(rows.groupBy("s", "p", "t").agg(F.collect_list(F.struct("node", "f", "g")).alias("x")).select("s", "p", "t", F.struct(F.col("x.node").alias("nodes"), F.col("x.f").alias("f"), F.col("x.g").alias("g")).alias("rows")), "prints")
    # pairs of classes, each once, whose sizes and population counts allow a link
    near = [(a, b) for a in sorted(split) for b in sorted(split) if a <= b and b[0] - a[0] <= 2 and (abs(a[1] - b[1]) - 1) * COUNTS < RADIUS]
    pairs = spark.sql("select col1 as s1, col2 as p1, col3 as n1, col4 as s2, col5 as p2, col6 as n2 from values " + ",".join(f"({a[0]},{a[1]},{split[a]},{b[0]},{b[1]},{split[b]})" for a, b in near))
    pairs = pairs.withColumn("t1", F.explode(F.sequence(F.lit(0), F.col("n1") - 1))).withColumn("t2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
    pairs = pairs.where((F.col("s1") < F.col("s2")) | (F.col("p1") < F.col("p2")) | (F.col("t1") <= F.col("t2"))).select("s1", "p1", "t1", "s2", "p2", "t2")
    side = lambda k, name: tiles.select(F.col("s").alias(f"s{k}"), F.col("p").alias(f"p{k}"), F.col("t").alias(f"t{k}"), F.col("rows").alias(name))
    both = pairs.join(side(1, "a"), ["s1", "p1", "t1"]).join(side(2, "b"), ["s2", "p2", "t2"]).select("a", "b")
    return both.repartition(8 * spark.sparkContext.defaultParallelism).mapInArrow(_candidate_batches, "u long, v long").distinct()


def _set_batches(batches):
    for batch in batches:
        sets = [shingles(words(t.as_py())).view(np.int64) for t in batch.column(2)]
        sizes = pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, pa.array(sets, pa.list_(pa.int64()))], names=["node", "cluster", "n", "shingles"])


def similar(a: list[np.ndarray], b: list[np.ndarray]):
    """Places (i, j) of the pairs of sets whose Jaccard similarity is at least 4/5, for one i at a time."""
    at = np.cumsum([0, *map(len, a + b)])
    known, ids = np.unique(np.concatenate(a + b), return_inverse=True)
    sizes, mark = np.diff(at), np.zeros(len(known), np.int32)
    first = at[len(a)]
    for i in range(len(a)):
        mine = ids[at[i] : at[i + 1]]
        mark[mine] = 1
        common = np.add.reduceat(mark[ids[first:]], at[len(a) : -1] - first)
        mark[mine] = 0
        j = np.nonzero(9 * common >= 4 * (sizes[i] + sizes[len(a) :]))[0]
        yield np.full(len(j), i), j


def _link_batches(batches):
    for batch in batches:
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            (u, x), (v, y) = (zip(*((r["node"].as_py(), r["shingles"].values.to_numpy(zero_copy_only=False)) for r in side), strict=True) for side in (a, b))
            yield from _spanning(np.array(u + v, np.int64), ((i, len(u) + j) for i, j in similar(list(x), list(y))))


def links(texts: DataFrame, tile: int = TILE) -> DataFrame:
    """(u, v): a forest that spans the similar pairs within each cluster of `texts` (node, cluster, text)."""
    sets = cut(texts.select("node", "cluster", "text").mapInArrow(_set_batches, "node long, cluster long, n long, shingles array<long>"), "sets")
    sets = sets.withColumn("size", _size_class(F.col("n")))
    tiles_of = sets.groupBy("cluster", "size").agg(F.ceil(F.sum("n") / tile).cast("int").alias("tiles"))
    tiles = sets.join(tiles_of, ["cluster", "size"]).withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiles = cut(tiles.groupBy("cluster", "size", "t").agg(F.collect_list(F.struct("node", "shingles")).alias("rows")), "tiles")
    one = tiles.select("cluster", F.col("size").alias("s1"), F.col("t").alias("t1"))
    two = tiles.select("cluster", F.col("size").alias("s2"), F.col("t").alias("t2"))
    near = one.withColumn("s2", F.explode(F.sequence(F.col("s1"), F.col("s1") + 2))).join(two, ["cluster", "s2"])
    near = near.where((F.col("s1") < F.col("s2")) | (F.col("t1") <= F.col("t2")))
    side = lambda k, name: tiles.select("cluster", F.col("size").alias(f"s{k}"), F.col("t").alias(f"t{k}"), F.col("rows").alias(name))
    pairs = near.join(side(1, "a"), ["cluster", "s1", "t1"]).join(side(2, "b"), ["cluster", "s2", "t2"]).select("a", "b")
    return pairs.repartition(4 * texts.sparkSession.sparkContext.defaultParallelism).mapInArrow(_link_batches, "u long, v long").distinct()


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tile: int = TILE, prints: int = PRINTS) -> DataFrame:
    """One row of `docs` for each group of near copies: that of the smallest doc_id (null last), then the smallest hashes of the text and of all columns."""
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = docs.withColumns({"__d_id": F.col(doc_id).cast("long"), "__d_h": F.xxhash64(F.coalesce(F.col(text), F.lit(""))), "__d_r": F.xxhash64(*hashed)})
    rows = keyed.select("__d_id", "__d_h", "__d_r", F.col(text).alias("text"))
    found = cut(rows.mapInArrow(_sketch_batches, "doc_id long, hash long, row long, node long, n long, f long, g long"), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "hash", "row"))
    nodes = cut(found.groupBy("node").agg(first.alias("k"), *(F.first(c).alias(c) for c in ("n", "f", "g"))), "nodes")
    clusters = components(candidates(nodes.select("node", "n", "f", "g"), prints))
    clusters = clusters.select(F.col("u").alias("node"), F.col("root").alias("cluster")).unionByName(clusters.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct())
    same = lambda k: F.col("__d_id").eqNullSafe(k["doc_id"]) & (F.col("__d_h") == k["hash"]) & (F.col("__d_r") == k["row"])
    asked = clusters.join(nodes.select("node", "k"), "node")
    texts = rows.join(asked, same(F.col("k"))).dropDuplicates(["node"])
    roots = components(links(texts, tile)).withColumnRenamed("u", "node")
    keep = nodes.select("node", "k").join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("k").alias("k")).select("k")
    out = keyed.join(keep, same(F.col("k")), "left_semi")
    return out.dropDuplicates(["__d_id", "__d_h", "__d_r"]).drop("__d_id", "__d_h", "__d_r")
