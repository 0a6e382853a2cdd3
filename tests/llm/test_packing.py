import collections

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm import packing

TEXTS = [None, "", "I'M a <|endoftext|> test\x1cfoo it's İstanbul ΣΑΣ, ok!!! 123abc naïve?! éa ́x    nb", "DON'T stop... a%b &&& x9y 漢字 kana", "word " * 9000, "Äpfel, äpfel. ÄPFEL!"]


def test_ids_and_layout(spark, odd_docs):
    docs = odd_docs.unionByName(spark.createDataFrame([(100 + k, t, 1, "y") for k, t in enumerate(TEXTS)], odd_docs.schema)).dropDuplicates(["doc_id"]).repartition(3)
    rows = packing.pack_documents(docs).collect()
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d in docs.collect():
        want, got = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1], []
        for r in sorted(by[d.doc_id], key=lambda r: r.start):
            assert r.start == len(got) and r.doc_tokens == len(want)
            got += np.frombuffer(r.ids, "<u4").tolist()
        assert got == want
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 63), max_size=60))
def test_assign_is_exact(lengths):
    out = packing.assign(lengths, 64)
    got = collections.Counter()
    for s in out:
        for i, _, n in s:
            got[i] += n
    assert all(got[i] == n for i, n in enumerate(lengths))
    sizes = [sum(n for *_, n in s) for s in out]
    assert all(n & (n - 1) == 0 and n <= 64 for n in sizes)


def test_costs_are_balanced():
    out = packing.assign([1000] * 40 + [24] * 80 + [100] * 40)
    cost = [sum(n + n * n / 2048 for *_, n in s) for s in out if sum(n for *_, n in s) == 2048]
    assert max(cost) < 1.35 * min(cost)


def test_empty_table(spark, odd_docs):
    assert packing.pack_documents(odd_docs.where("doc_id > 999")).collect() == []
