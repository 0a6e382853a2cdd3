import numpy as np
import pytest
from pyspark.sql import functions as F

cp = pytest.importorskip("corpus_pipeline")

from test_near_copies import brute  # noqa: E402

from weftline.llm import decontam, packing, quality, secret_scan  # noqa: E402
from weftline.llm.common import cut, table  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_and_clashing_columns(spark):
    docs = table(spark, SF, "documents").withColumns({"kept": F.lit(7), "secrets": F.lit("x"), "row": F.lit(1)})
    docs = docs.unionByName(docs.limit(3))
    names, sizes = docs.columns, [docs.count()]
    for name, stage in cp.STAGES:
        docs = cut(stage(spark, docs, SF), name)
        if name != "pack":
            assert docs.columns == names
            assert docs.where("kept <> 7 or secrets <> 'x' or row <> 1").count() == 0
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0


def test_run_against_single_steps(spark):
    """The decisions of run() are those of the operators applied one by one, by plain Python."""
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    good = {r.doc_id for r in quality.score_quality(table(spark, SF, "documents")).where("kept").collect()}
    left = sorted(brute([(i, docs[i].text) for i in good]))
    bad = {r.doc_id for r in decontam.contaminated(table(spark, SF, "documents").where(F.col("doc_id").isin(left)), table(spark, SF, "benchmark")).collect()}
    want = {}
    enc = packing.encoder(packing.vocabulary_path())
    for r in secret_scan.scan_secrets(table(spark, SF, "documents")).collect():
        if r.doc_id in left and r.doc_id not in bad:
            text, at, out = r.text, 0, []
            for s in r.secrets:
                if s.start >= at:
                    out += [text[at : s.start], "[secret]"]
                at = max(at, s.end)
            want[r.doc_id] = len(enc.encode("".join(out) + text[at:]))
    got = {r.doc_id: r.doc_tokens for r in cp.run(spark, SF).collect()}
    assert got == want and np.all([n > 0 for n in got.values()])


def test_odd_documents_run_through(spark):
    """Null ids and texts, repeated rows and ids, long and empty texts, extra columns; and a table without rows."""
    base = table(spark, SF, "documents").limit(20).withColumn("key", F.lit("k"))
    prose = " ".join(f"the word{k} of and to" for k in range(9000))
    odd = [(None, None), (None, None), (None, prose), (None, prose + " more"), (-1, ""), (-2, None), (-3, prose.replace("word7 ", "other ")), (-3, "x" * 100_000), (-4, "the and of to in is it " * 30)]
    more = spark.createDataFrame(odd, "doc_id long, text string")
    docs = base.unionByName(more.select(*(F.col(c) if c in ("doc_id", "text") else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns)))
    for name, stage in cp.STAGES:
        docs = cut(stage(spark, docs, SF), name)
        if name == "near_dedup":
            kept = {(r.doc_id, len(r.text)) for r in docs.where("doc_id is null or doc_id < 0").collect()}
            # the long texts are near copies of each other; the id counts before null does
            assert kept == {(-3, len(prose) + 0 + len("other ") - len("word7 "))}
    assert docs.count() > 0
    docs = base.limit(0)
    for name, stage in cp.STAGES:
        docs = cut(stage(spark, docs, SF), name)
        assert docs.count() == 0
