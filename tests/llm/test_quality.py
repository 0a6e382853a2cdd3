import re

from weftline.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_against_brute_force(spark, odd_docs):
    extra = ["a b c d e f g h " * 3, "a b c d e f g h", "a b c d e f g h i a b c d e f g h", "x\n\nx\n x\nx", "#*$%&|<>\x0b\x0c a\rb"]
    docs = odd_docs.unionByName(spark.createDataFrame([(k, t, 1, "y") for k, t in enumerate(extra)], odd_docs.schema))
    docs = docs.unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "1 as kept", "'y' as labels"))
    rows = quality.score_quality(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        b = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0])
        assert not (r.kept and r.base_failed)


def test_labelled_documents(spark):
    """Good documents stay, bad ones mostly go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = quality.score_quality(docs).selectExpr("quality", "kept", "base_failed").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert all(r.kept for r in good) and sum(r.kept for r in bad) < 0.1 * len(bad)


def test_empty_table(spark, odd_docs):
    assert quality.score_quality(odd_docs.where("doc_id > 99")).collect() == []
