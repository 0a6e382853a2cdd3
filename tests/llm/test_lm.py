import collections
import math
import pickle
import zlib

import numpy as np

from weftline.llm import attention_lm as lm
from weftline.llm import lm_score


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


def base(docs):
    """(held_out, n_known, base score) by (doc_id, n_tokens), and N."""
    counts = collections.Counter()
    for i, t in docs:
        if not held(i):
            counts.update(lm_score.words(t or ""))
    n, v = sum(counts.values()), len(counts)
    want = {}
    for i, t in docs:
        w = lm_score.words(t or "")
        want[i, len(w)] = held(i), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
    return want, n


def test_base_and_model(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + [(None, None), (-3, ""), (-3, "zzqx qq")]
    rows = lm_score.score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    want, n = base(docs)
    assert len(rows) == len(docs)
    for r in rows:
        h, known, score = want[r.doc_id, r.n_tokens]
        assert (r.held_out, r.n_known, r.train_tokens) == (h, known, n)
        assert abs(r.base_score - score) < 1e-6 * max(1, abs(score)) and r.score < 0
    # the model learns: better than the word unigram on texts it hasn't seen
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_odd_rows(spark, monkeypatch):
    """Nulls, repeats, clashing columns, long words and texts, a word that a third of the rows repeat."""
    monkeypatch.setattr(lm_score, "PIECE", 1000)
    monkeypatch.setattr(lm_score, "HELD_WORDS", 50)
    docs = [(None, None), (1, "a b"), (1, "a b c"), (2, "x" * 30_000 + " y"), (3, " odd space  \x85"), (4, "word other " * 4000)] + [(k, f"hot w{k} hot") for k in range(10, 60)]
    d = spark.createDataFrame([(*r, 1.0, 2) for r in docs], "doc_id long, text string, score double, word int").repartition(4)
    rows = lm_score.score_texts(d).collect()
    want, n = base(docs)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == sorted((i or 0, len(lm_score.words(t or ""))) for i, t in docs)
    for r in rows:
        assert (r.held_out, r.n_known) == want[r.doc_id, r.n_tokens][:2] and abs(r.base_score - want[r.doc_id, r.n_tokens][2]) < 1e-6 * max(1, -r.base_score)
        assert math.isfinite(r.score)


def test_empty_table(spark):
    assert lm_score.score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_windows_score_each_word_once():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        places, scored = lm.windows(n)
        assert sorted(places[scored]) == list(range(n))
    sizes = np.array([3, 0, 40, 100, 1])
    places, scored = lm.many_windows(sizes)
    at = 0
    for n in sizes:
        one, keep = lm.windows(n)
        assert np.array_equal(places[at : at + len(one)] - (places[at, 0]), one) and np.array_equal(scored[at : at + len(one)], keep)
        at += len(one)
    assert at == len(places) and list(places[scored]) == [k for b, n in zip(np.cumsum(sizes + 1) - sizes - 1, sizes) for k in range(b, b + n)]


def small_model(rng):
    ids = 41
    begins = np.arange(ids) % 2 == 0
    texts = [np.concatenate([[0], rng.integers(0, 40, 90)]) for _ in range(20)]
    return lm.fit(texts, ids, 40, begins, rounds=4, steps=8), begins


def test_spelling_is_normalized_and_gates_causal():
    rng = np.random.default_rng(1)
    m, begins = small_model(rng)
    p = np.exp(m.log_p.astype(float))
    assert np.allclose(p.sum(0), 1, atol=1e-4)
    # words of up to n ids: first * rest^(n-1) * end, summed over n, is 1
    first, rest = p[begins].sum(0), p[~begins].sum(0)
    assert np.allclose(sum(first * rest ** (n - 1) for n in range(1, 400)), 1, atol=1e-3)
    e = m.odds[rng.integers(0, 40, (2, lm.WIDTH))]
    later = e.copy()
    later[:, 20:] = 0
    assert np.allclose(m.gates(e)[:, :20], m.gates(later)[:, :20], atol=1e-6)
    assert np.allclose(m.gates(e).sum(-1), 1, atol=1e-5)


def test_score_is_that_of_a_plain_loop(spark):
    """Every word by itself: its window, its own attention in plain Python, and the product of its ids."""
    rng = np.random.default_rng(3)
    path = lm_score.vocabulary_path()
    train = [" ".join(rng.choice(["alpha", "beta", "gamma.", "delta"], 50)) for _ in range(40)]
    ids = [np.concatenate([lm_score.word_ids(path, t.encode().split())[0], [lm_score.END_ID]]) for t in train]
    m = lm.fit(ids, lm_score.VOCABULARY_SIZE, lm_score.START_ID, lm_score.begins(path), rounds=3, steps=5)
    docs = [(5, " ".join(rng.choice(["alpha", "beta", "unseenword"], 70))), (6, None)]
    frequent = lm_score.Frequent([b"alpha", b"\n"], np.array([-1.0, -2.0]), rng.dirichlet(np.ones(2), lm.K).T.astype(np.float32))
    sc = spark.sparkContext
    rows = lm_score.apply(spark.createDataFrame(docs, "doc_id long, text string"), sc.broadcast(pickle.dumps(m)), sc.broadcast(frequent), 0.9, path).collect()
    for doc_id, text in docs:
        ws = lm_score.words(text or "")
        spelt = [[lm_score.END_ID] if w == b"\n" else list(lm_score.encoder(path).encode_ordinary(" " + w.decode())) for w in ws]
        embed = [m.odds[lm_score.START_ID]] + [m.odds[x].mean(0) for x in spelt]
        frequent_sum, others = 0.0, []
        for t in range(len(ws)):
            w = 0 if t < lm.WIDTH else 1 + (t - lm.WIDTH) // lm.STEP
            context = embed[w * lm.STEP : t + 1]
            q, g = context[-1] @ m.gate["q"] / math.sqrt(lm.DIM), m.gate
            a = np.array([q @ (c @ g["k"]) + g["near"][len(context) - 1 - j] for j, c in enumerate(context)])
            a = np.exp(a - a.max())
            z = (a / a.sum()) @ np.array(context) @ g["v"] + g["bias"]
            gate = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            s = (gate * np.exp(m.log_p[spelt[t]].astype(float).sum(0))).sum() * 0.1
            if ws[t] in frequent.number:
                frequent_sum += math.log10(0.9 * (gate * frequent.share[frequent.number[ws[t]]]).sum() + s)
            else:
                others.append(math.log10(s))
        got = [r for r in rows if r.hash is None and r.doc_id == doc_id]
        assert len(got) == 1 and got[0].n_tokens == len(ws) and abs(got[0].score - frequent_sum) < 1e-3 * max(1, -frequent_sum)
        assert np.allclose(sorted(r.spelt for r in rows if r.hash is not None and r.rid == got[0].rid), sorted(others), rtol=1e-3)


def test_attention_is_trained_on_all_text(spark):
    docs = [(i, f"text {i} of " + "some words and others " * (i % 7 + 1)) for i in range(90)]
    path = lm_score.vocabulary_path()
    ids = [np.concatenate([lm_score.word_ids(path, t.encode().split())[0], [lm_score.END_ID]]) for _, t in docs]
    m = lm.fit(ids[:3], lm_score.VOCABULARY_SIZE, lm_score.START_ID, lm_score.begins(path))
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    gathered = lm_score.gather(rows, spark.sparkContext.broadcast(pickle.dumps(m)), path).cache()
    gate, n = lm_score.trained_gate(gathered, m)
    assert n == sum(len(lm_score.words(t)) for _, t in docs)
    assert not np.allclose(lm.Model(m.log_p, gate).flat(), m.flat())
    sums = collections.Counter()
    for r in gathered.where("word is not null").collect():
        sums[bytes(r.word)] += r.n
    assert sums == collections.Counter(w for _, t in docs for w in lm_score.words(t))
