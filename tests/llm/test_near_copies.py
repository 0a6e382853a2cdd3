import random

import numpy as np
import pytest

from weftline.llm import near_copies, simhash
from weftline.llm.common import table

cp = pytest.importorskip("corpus_pipeline")


def shingled(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}


def brute(rows):
    """Smallest id of each component of the pairs with a similarity of at least 0.8."""
    sets, group = [(i, shingled(t)) for i, t in sorted(rows)], {i: i for i, _ in rows}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                p, q = root(a), root(b)
                group[max(p, q)] = min(p, q)
    return {i for i in group if root(i) == i}


def test_near_copies_beyond_three_bits_leave_the_pipeline(spark):
    rng, rows = random.Random(3), []
    for i in range(30):
        ws = [f"w{rng.randrange(3000)}" for _ in range(120)]
        changed = ws[:60] + ["other"] + ws[61:]
        rows += [(10 * i, " ".join(ws)), (10 * i + 1, " ".join(changed)), (10 * i + 2, " ".join(ws[:40] + rng.sample(ws, 80)))]
    far = [(simhash.fingerprint(rows[k][1]) ^ simhash.fingerprint(rows[k + 1][1])).bit_count() > 3 for k in range(0, len(rows), 3)]
    assert any(far)  # the fingerprints of op9 miss them
    got = {r.doc_id for r in cp.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == brute(rows) and len(got) == 60


@pytest.mark.parametrize("tile", [300, near_copies.TILE])
def test_against_brute_force(spark, tile):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("length(text) < 2500")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id for r in near_copies.deduplicate(docs, tile=tile, prints=tile // 4).collect()} == brute(rows)


def test_radius_holds_pairs_at_the_least_similarity():
    """Of 2,000 pairs of sets at a similarity of 0.8 at most a few lie beyond the radius."""
    rng, missed = np.random.default_rng(4), 0
    for k in range(2000):
        n = 9 * int(rng.integers(3, 60))
        x = rng.integers(0, 2**64, n + n // 9, np.uint64)
        a, b = near_copies.wide_print(x[:n]), near_copies.wide_print(x[n // 9 :])
        missed += not any(len(i) for i, _ in near_copies.print_links(a[None], b[None]))
    assert missed <= 10


def test_forest_of_dense_groups(monkeypatch):
    """Edges in parts, all pairs of two groups among them, are merged as they come."""
    monkeypatch.setattr(simhash, "PENDING", 50)
    forest = simhash.Forest(300)
    for k in range(200):
        same = np.arange(k % 2, 200, 2)
        forest.add(np.full(len(same), k), same)
        assert forest.size < 50
    label = forest.merge()
    assert list(label[:200]) == [0, 1] * 100 and list(label[200:]) == list(range(200, 300))


def test_rows_that_differ_in_other_columns(spark):
    rows = [(1, "a b c d e f g", k) for k in range(20)]
    got = [sorted(map(tuple, near_copies.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, other int").repartition(n)).collect())) for n in (1, 7)]
    assert len(got[0]) == 1 and got[0] == got[1]


def test_edges(spark, odd_docs):
    got = near_copies.deduplicate(odd_docs).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == [(False, 1), (False, 2), (False, 5), (False, 6), (False, 8), (False, 10), (True, None)]
    assert near_copies.deduplicate(odd_docs.where("doc_id > 99")).collect() == []
