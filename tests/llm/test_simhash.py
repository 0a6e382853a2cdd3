import numpy as np
import xxhash

from weftline.llm import simhash


def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 3)[0]:
            parent[root(i)] = root(i + 1 + int(j))
    least = {}
    for i, d in enumerate(ids):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[root(i)] for i in range(len(fps))]


def test_fingerprint_by_hand():
    text = "The quick brown FOX\tjumps over É the lazy dog"
    w = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(len(w) - 2)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("a b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_components_against_all_pairs(spark, odd_docs):
    docs = odd_docs.unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text", "1 as kept", "'y' as labels"))
    rows = simhash.near_duplicates(docs, tile=64).collect()
    assert len(rows) == docs.count()
    fps = np.array([r.fp for r in rows], dtype=np.int64).view(np.uint64)
    assert [r.component_id for r in rows] == brute_components(fps, [r.doc_id for r in rows])


def test_dense_random_fingerprints(spark):
    """Chains and clusters over many small tiles, whatever the tile size."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64)) if k else np.uint64(0) for k in rng.integers(0, 5, 900)]
    fps = np.unique(np.array([base[k % 40] ^ f for k, f in enumerate(flips)], dtype=np.uint64))
    d = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r.u: r.root for r in simhash.components(simhash.links(d, tile=16)).collect()}
    got = [roots.get(int(x), int(x)) for x in fps.view(np.int64)]
    want = brute_components(fps, list(range(len(fps))))
    groups = lambda v: sorted(sorted(i for i, y in enumerate(v) if y == x) for x in set(v))
    assert groups(got) == groups(want)


def test_long_path(spark):
    edges = spark.range(200).selectExpr("id as u", "id + 1 as v")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_many_copies_and_bits_in_parts(spark, monkeypatch):
    """Hot fingerprints take their own way; bits are counted in parts."""
    text = " ".join(f"w{k}" for k in range(3000))
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "COUNTED", 100)
    assert simhash.fingerprint(text) == want
    docs = spark.createDataFrame([(k, "the same text again and again") for k in range(300)] + [(1000 + k, f"other {k} " * (k + 1)) for k in range(40)], "doc_id long, text string")
    monkeypatch.setattr(simhash, "HOT", 10)
    rows = simhash.near_duplicates(docs).collect()
    fps = np.array([r.fp for r in rows], dtype=np.int64).view(np.uint64)
    assert len(rows) == 340 and [r.component_id for r in rows] == brute_components(fps, [r.doc_id for r in rows])
