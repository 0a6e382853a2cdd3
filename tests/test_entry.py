import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from weftline.queries import QUERIES, SQL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["path", "rank"]


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_queries_against_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf), con.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    pick = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in pick) for r in want.fetchall()), key=repr)


def test_robots_verdict_of_pages_captured_twice(spark, tmp_path):
    urls = ["https://s.test/en/1", "https://s.test/en/1", "https://s.test/en/15", "https://s.test/fr/a.html", "https://s.test/fr/a.html?x=1", "https://s.test", None, None]
    spark.createDataFrame([(k, u, f"<p>{k}") for k, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted((tuple(r) for r in QUERIES["robots_verdict"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(con.sql(SQL["robots_verdict"]).fetchall(), key=repr) and len(got) == 6 and ("https://s.test/en/1", True) in got


def test_works_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['weftline.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and 'pipeline' not in e.queries(); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ROOT})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(QUERIES)


def test_stream(spark, tmp_path):
    from weftline.streaming.ingest import event_counts, parse_stream

    pages = spark.readStream.schema("page_id long, url string, html string").parquet("/root/testdata/sf0.001/", pathGlobFilter="pages.parquet")
    parse_stream(pages, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/", pathGlobFilter="events.parquet")
    q = event_counts(events).writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    whole = {(r.start, r.event_type): r.n for r in event_counts(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).collect()}
    got = {(r.start, r.event_type): r.n for r in spark.sql("select * from counts").collect()}
    assert got and got.items() <= whole.items()
