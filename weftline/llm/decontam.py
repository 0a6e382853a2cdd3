"""Benchmark decontamination by spaced-seed hashing.

A seed is a window of tokens some of whose positions a fixed mask ignores, so a
substituted token doesn't hide a match. Hashes of the benchmark's seeds are
joined with those of the documents; each hit names an item and a diagonal
(document position minus item position). Along the diagonal the two token
sequences are compared position by position, which tolerates substitutions: a
document is contaminated by an item where some window of the item agrees in
enough positions.

The masks lose no such window. A mask asks for pairs of neighbouring tokens at
even distances. Cut a window into pairs: each substitution spoils one pair, so

    tokens  substitutions  pairs  whole pairs left  masks
    12, 13  3              6      3                 three pairs
    10, 11  2              5      3                 three pairs
    8, 9    2              4      2                 two pairs
    6, 7    1              3      2                 two pairs
    4, 5    1              2      1                 one pair
    2, 3    0              1      1                 one pair
    1       0              0      0                 the token

and the masks of three (or two) pairs hold every way to lie apart. An item uses
the masks of its length, of 13 tokens if it is longer.

1. `seed_hits` works inside the row: tokens outside the benchmark's vocabulary
   and pairs outside its pairs can't take part in a seed; bitmaps of fixed size
   (of tokens, pairs and seeds) sort out what can't hit. They only spare work:
   the join decides. What remains of the documents is written once.
2. Surviving positions join the benchmark's seeds on the hash and collapse to
   distinct (document, item, diagonal).
3. The tokens of these are compared, and the best diagonal of each pair stays.

Documents are keyed by doc_id and the hash of the text, so rows that share an id
are compared one text at a time, and repeated rows once.

Only DataFrame expressions are used. Defined results: a null text counts as
empty; items without tokens match nothing; rows with the same doc_id, null
included, are one document, contaminated by what contaminates any of them; an
item that several rows repeat is one item; ties between diagonals go to the
smallest; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import cut, keep_where, table, whole_text

#: Contamination: in some window of so many of the item's tokens (all, if it has fewer), this share agrees.
WINDOW = 13
SHARE = 0.75
#: By the shortest item they serve: the places of a mask's pairs. An item uses those of the largest key up to its length; the token itself is key 1.
MASKS = {
    10: [(0, 2 * a, 2 * b) for a, b in combinations(range(1, 6), 2)],
    6: [(0, 2 * a) for a in range(1, 4)],
    2: [(0,)],
}
#: log2 of the bits of the bitmaps: 128 KB of tokens, 512 KB of pairs and of seeds, whatever the benchmark.
TOKEN_BITS = 20
SEED_BITS = 22
#: Seeds of the benchmark are broadcast up to this number and joined with a shuffle beyond.
BROADCAST_SEEDS = 500_000


def tokens(text: Column) -> Column:
    """64-bit hashes of lower-case runs of letters and digits."""
    words = F.split(F.regexp_replace(F.lower(text), r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def pairs(toks: Column) -> Column:
    """Hash of the pair of tokens at each position; null where one is missing or null."""
    last = F.size(toks) - 2
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    two = lambda i: F.when(F.get(toks, i).isNotNull() & F.get(toks, i + 1).isNotNull(), F.xxhash64(F.get(toks, i), F.get(toks, i + 1)))
    return F.transform(at, two)


def seeds(held: Column, i: Column, least: int) -> Column:
    """Array with the seed hash at position i of each mask of `MASKS[least]`, given the pairs; null where a pair is missing or null."""
    out = []
    for k, mask in enumerate(MASKS[least]):
        picks = [F.get(held, i + p) for p in mask]
        out.append(F.when(reduce(and_, (x.isNotNull() for x in picks)), F.xxhash64(F.lit(100 * least + k), *picks)))
    return F.array(*out)


def single(token: Column) -> Column:
    """The seed of an item of one token."""
    return F.xxhash64(F.lit(1), token)


def _bits(h: Column, log2: int, probes: int) -> list[Column]:
    """Bit numbers of a hash in a bitmap of 2^log2 bits."""
    return [F.shiftrightunsigned(h, 64 - log2 - s * (21 if probes > 1 else 0)).bitwiseAND(F.lit((1 << log2) - 1).cast("long")) for s in range(probes)]


def bitmap(hashes: DataFrame, log2: int, probes: int) -> Column:
    """A constant array of 2^(log2-6) words in which the bits of all values of column `hash` are set."""
    bits = hashes.select(F.explode(F.array(*_bits(F.col("hash"), log2, probes))).alias("b"))
    words = bits.groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
    got = {r.w: r.v for r in words.collect()}
    return F.split(F.lit(",".join(str(got.get(i, 0)) for i in range(1 << (log2 - 6)))), ",").cast("array<bigint>")


def _in(bitmap_: Column, h: Column, log2: int, probes: int) -> Column:
    each = (F.getbit(F.get(bitmap_, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1 for b in _bits(h, log2, probes))
    return reduce(and_, each)


def benchmark_seeds(items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((item_id, item_toks, held), (least, hash, item_id, ipos)) of the benchmark; `held` are the items' pairs, `least` the key of the mask."""
    rows = items.select(F.col(item_id).alias("item_id"), tokens(whole_text(text)).alias("item_toks"))
    rows = cut(rows.where(F.size("item_toks") > 0).distinct().withColumn("held", pairs(F.col("item_toks"))), "items")
    size, held, none = F.size("item_toks"), F.col("held"), F.array().cast("array<array<bigint>>")
    parts = [rows.where(size == 1).select(F.lit(1).alias("least"), single(F.get("item_toks", F.lit(0))).alias("hash"), "item_id", F.lit(0).alias("ipos"))]
    above = None
    for least in MASKS:
        mine = (size >= least) if above is None else (size >= least) & (size < above)
        at = F.when(F.size(held) > 0, F.transform(F.sequence(F.lit(0), F.size(held) - 1), lambda i: seeds(held, i, least))).otherwise(none)  # noqa: B023
        pos = rows.where(mine).select("item_id", F.posexplode(at).alias("ipos", "hs"))
        parts.append(pos.select(F.lit(least).alias("least"), F.explode("hs").alias("hash"), "item_id", "ipos").where("hash is not null"))
        above = least
    return rows, cut(reduce(DataFrame.unionByName, parts), "seeds")


def seed_hits(docs: DataFrame, vocabulary: Column, pair_map: Column, seed_map: Column, used: list[int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, toks, hits): documents with a seed that the bitmaps let through; hits are (pos, hash), key the hash of the text. `used` are the keys of the masks."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole_text(text)).alias("key"), tokens(whole_text(text)).alias("toks"))
    d = d.withColumn("known", F.transform("toks", lambda t: F.when(_in(vocabulary, t, TOKEN_BITS, 1), t)))
    d = d.withColumn("two", pairs(F.col("known")))
    d = d.withColumn("held", F.transform("two", lambda h: F.when(h.isNotNull() & _in(pair_map, h, SEED_BITS, 3), h)))
    held = F.col("held")
    d = d.withColumn("at", F.filter(F.transform("held", lambda h, i: F.when(h.isNotNull(), i)), lambda i: i.isNotNull()))
    hit = lambda i, h: F.struct(i.alias("pos"), h.alias("hash"))
    many = [x for x in used if x > 1]

    def found(i: Column) -> Column:
        every = F.concat(*(seeds(held, i, least) for least in many))
        return F.transform(F.filter(every, lambda h: h.isNotNull() & _in(seed_map, h, SEED_BITS, 3)), lambda h: hit(i, h))

    none = F.array().cast("array<struct<pos:int,hash:bigint>>")
    parts = [F.flatten(F.transform("at", found))] if many else [none]
    if 1 in used:
        parts.append(F.filter(F.transform("known", lambda t, i: F.when(t.isNotNull() & _in(seed_map, single(t), SEED_BITS, 3), hit(i, single(t)))), lambda x: x.isNotNull()))
    d = d.withColumn("hits", F.concat(*parts))
    return keep_where(d.select("doc_id", "key", "toks", "hits"), F.size("hits") > 0)


def compare(toks: Column, item: Column, diagonal: Column) -> Column:
    """(n_equal, n_compared, overlap) along a diagonal; overlap is the best window's share."""
    equal = F.transform(item, lambda x, i: F.coalesce((diagonal + i >= 0) & (F.get(toks, F.greatest(diagonal + i, F.lit(0))) == x), F.lit(False)).cast("int"))
    size = F.size(item)
    width = F.least(size, F.lit(WINDOW))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def best(eq: Column) -> Column:
        return F.struct(
            total(eq).alias("n_equal"),
            (F.least(size, F.size(toks) - diagonal) - F.greatest(F.lit(0), -diagonal)).alias("n_compared"),
            (F.array_max(F.transform(F.sequence(F.lit(1), size - width + 1), lambda k: total(F.slice(eq, k, width)))) / width).alias("overlap"),
        )

    return F.get(F.transform(F.array(equal), best), F.lit(0))


RESULT = "doc_id long, item_id long, n_equal long, n_compared long, overlap double, diagonal long"


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_equal, n_compared, overlap, diagonal): one row per document and item that contaminates it.

    n_compared counts the item's tokens that lie inside the document on the best
    diagonal, n_equal those that agree.
    """
    if share < SHARE:
        raise ValueError(f"the masks are proven for a share of at least {SHARE}")
    rows, seed_rows = benchmark_seeds(items)
    small = seed_rows.count() <= BROADCAST_SEEDS
    held = (lambda x: F.broadcast(x)) if small else (lambda x: x)
    used = sorted((r.least for r in seed_rows.select("least").distinct().collect()), reverse=True)
    if not used:
        return docs.sparkSession.createDataFrame([], RESULT).withColumns({"doc_id": F.lit(None).cast(docs.schema[doc_id].dataType), "item_id": F.lit(None).cast(items.schema["item_id"].dataType)})
    maps = bitmap(rows.select(F.explode("item_toks").alias("hash")), TOKEN_BITS, 1), bitmap(rows.select(F.explode("held").alias("hash")), SEED_BITS, 3), bitmap(seed_rows.select("hash"), SEED_BITS, 3)
    d = cut(seed_hits(docs, *maps, used, doc_id, text), "hits")
    hit = d.select("doc_id", "key", F.explode("hits").alias("h")).select("doc_id", "key", "h.pos", "h.hash")
    seeds_ = seed_rows.select("hash", "item_id", "ipos").distinct()
    diagonals = hit.join(held(seeds_), "hash").select("doc_id", "key", "item_id", (F.col("pos") - F.col("ipos")).alias("diagonal")).distinct()
    texts = d.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.first("toks").alias("toks"))
    both = diagonals.join(texts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")))
    both = both.join(held(rows.select(F.col("item_id").alias("__item"), "item_toks")), F.col("item_id").eqNullSafe(F.col("__item")))
    found = both.select("doc_id", "item_id", "diagonal", compare(F.col("toks"), F.col("item_toks"), F.col("diagonal")).alias("c"))
    found = found.select("doc_id", "item_id", "diagonal", "c.*").where(F.col("overlap") >= share)
    order = F.struct("overlap", "n_equal", -F.col("diagonal"))
    one = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_equal", "n_compared", "overlap", "diagonal"), order).alias("b"))
    return one.select("doc_id", "item_id", F.col("b.n_equal").cast("long").alias("n_equal"), F.col("b.n_compared").cast("long").alias("n_compared"), "b.overlap", F.col("b.diagonal").cast("long").alias("diagonal"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM d),
iw AS (SELECT item_id, unnest(w) AS t, unnest(range(len(w))) AS q FROM i),
m AS (SELECT doc_id, item_id, p - q AS diagonal, q FROM dw JOIN iw USING (t)),
-- only diagonals with enough equal tokens at all go on to the windows
e AS (SELECT doc_id, item_id, diagonal, count(*) AS n_equal FROM m GROUP BY ALL),
f AS (SELECT e.*, len(i.w) AS size, least(13, len(i.w)) AS width, len(d.w) AS total
      FROM e JOIN i USING (item_id) JOIN d USING (doc_id) WHERE n_equal >= 0.75 * least(13, len(i.w))),
g AS (SELECT f.*, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY q RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS inside
      FROM f JOIN m USING (doc_id, item_id, diagonal)),
h AS (SELECT doc_id, item_id, diagonal, any_value(n_equal) AS n_equal, max(inside) / any_value(width) AS overlap,
             least(any_value(size), any_value(total) - diagonal) - greatest(0, -diagonal) AS n_compared
      FROM g GROUP BY doc_id, item_id, diagonal)
SELECT doc_id, item_id, n_equal::BIGINT AS n_equal, n_compared::BIGINT AS n_compared, overlap::DOUBLE AS overlap, diagonal::BIGINT AS diagonal
FROM h WHERE overlap >= 0.75
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY overlap DESC, n_equal DESC, diagonal) = 1
"""
