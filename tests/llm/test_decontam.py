import itertools
import random
import re

import numpy as np
import pytest

from weftline.llm import decontam
from weftline.llm.decontam import MASKS, SHARE, WINDOW

WORD = re.compile(r"[^\W_]+")


def brute(docs, items):
    """All diagonals of all pairs, without seeds."""
    by_item, out, number = {i: WORD.findall((t or "").lower()) for i, t in items}, {}, {}
    coded = lambda ws: np.array([number.setdefault(x, len(number)) for x in ws], np.int64)
    arrays = {i: coded(w) for i, w in by_item.items() if w}
    for d, t in docs:
        w = coded(WORD.findall((t or "").lower()))
        for i, item in arrays.items():
            if not len(w) or len(np.intersect1d(w, item)) < SHARE * min(WINDOW, len(item)) / 3:
                continue  # too few kinds of equal tokens, repeats of three allowed for
            padded = np.concatenate([np.full(len(item), -1), w, np.full(len(item), -1)])
            eq = np.lib.stride_tricks.sliding_window_view(padded, len(item)) == item
            width = min(WINDOW, len(item))
            best = np.lib.stride_tricks.sliding_window_view(eq, width, axis=1).sum(-1).max(-1) / width
            for k in np.nonzero(best >= SHARE)[0]:
                one = (round(best[k], 6), int(eq[k].sum()), int(len(item) - k))
                out[d, i] = max(out.get((d, i), (0, 0, -(10**9))), one)
    return out


def spoiled(text, step):
    return " ".join("zzz" if k % step == step - 1 else w for k, w in enumerate(WORD.findall(text)))


def test_against_brute_force(spark, monkeypatch):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    docs += [(-1, None), (-2, ""), (None, "Xx " + spoiled(items[5][1], 5)), (-4, spoiled(items[30][1], 4) + " yy"), (-5, "a b c " + items[50][1].upper()), (-5, "a b c " + items[51][1]), (-7, " ".join(WORD.findall(items[70][1])[8:24]))]
    d = spark.createDataFrame([(*x, "q") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([*items, (None, ""), items[0]], "item_id long, text string")
    want = brute(docs, items)
    assert {(None, items[5][0]), (-4, items[30][0]), (-5, items[50][0]), (-5, items[51][0]), (-7, items[70][0])} <= set(want)
    read = lambda: {(r.doc_id, r.item_id): (round(r.overlap, 6), r.n_equal, -r.diagonal) for r in decontam.contaminated(d, b).collect()}
    assert read() == want
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    assert read() == want


@pytest.mark.parametrize("size", range(1, 21))
def test_masks_cover_every_placement_of_substitutions(size):
    """Whatever tokens of the best window are substituted, a seed of the item survives."""
    width = min(WINDOW, size)
    if size == 1:
        return
    masks = MASKS[max(k for k in MASKS if k <= size)]
    for wrong in itertools.combinations(range(width), int((1 - SHARE) * width)):
        whole = [k for k in range(width - 1) if k not in wrong and k + 1 not in wrong]
        assert any(all(k + p in whole for p in mask) for k in whole for mask in masks), wrong


def test_short_items_and_all_placements(spark):
    """Every placement of three substitutions in 13 tokens, and items of every length, with null and repeated ids."""
    rng = random.Random(2)
    word = lambda k: f"w{k}"
    items = [(n, " ".join(word(100 * n + k) for k in range(n))) for n in range(1, 15)]
    docs, pad = [], lambda n: " ".join(word(9000 + rng.randrange(500)) for _ in range(n))
    for d, wrong in enumerate(itertools.combinations(range(13), 3)):
        docs.append((d, " ".join([pad(3), *("zz" if k in wrong else word(1300 + k) for k in range(13)), pad(4)])))
    for n in range(1, 15):
        for k in range(n):
            docs.append((1000 + 20 * n + k, " ".join("zz" if j == k else word(100 * n + j) for j in range(n))))
        docs.append((2000 + n, items[n - 1][1]))
    docs += [(None, f"{pad(5)} {items[12][1]}"), (None, pad(30)), (None, f"{items[11][1]} {pad(2)}"), (7, pad(9)), (7, pad(9))]
    want = brute(docs, items)
    assert {d for d, i in want if i == 13 and d is not None and d < 1000} == set(range(286)) and {(None, 13), (None, 12)} <= set(want)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = decontam.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (round(r.overlap, 6), r.n_equal, -r.diagonal) for r in got} == want


def test_very_long_text_and_hot_id(spark):
    item = " ".join(f"q{k}" for k in range(20))
    docs = [(None, item)] * 300 + [(None, f"other {k} {item}") for k in range(30)] + [(1, "the of and " * 60_000 + item)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, item), (6, "the of and the of and the of and the of")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_equal, r.diagonal) for r in decontam.contaminated(d, b).collect()}
    assert got == {(None, 5): (20, 0), (1, 5): (20, 180_000), (1, 6): (11, 0)}


def test_empty(spark):
    d = spark.createDataFrame([(1, "x " * 50)], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(d, b).collect() == []
    assert decontam.contaminated(d.where("doc_id > 1"), spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")).collect() == []
