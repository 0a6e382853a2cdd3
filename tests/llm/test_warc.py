import base64
import hashlib

import pytest

from weftline.llm import warc
from weftline.llm.common import fresh_path

MAGIC = warc.MAGIC.decode()

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def test_round_trip_with_magic_inside(spark):
    rows = [(1, "u", "dup"), (2, "u\r\nX: y", "dup"), (3, None, FAKE + "tail"), (4, "u", None), (5, "u", ""), (None, "n", "dup"), (6, "é", "é" * 50 + FAKE * 3), (6, "é", "é" * 50 + FAKE * 3)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    path = fresh_path(spark, "warc")
    warc.write_archives(pages, path, per_file=3)
    assert warc.candidates(spark, path)[0].count() > len(rows)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect()), key=str)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = {"dup": 1, "": 4}.get(h or "", i)
        moved = i != first
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if moved else "response", first if moved else None))
    assert got == sorted(want, key=str)


def test_salted_way_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    pages = spark.createDataFrame([(k, "u", f"p{k % 3}") for k in range(30)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.plan_records(pages).collect()}
    assert got == {k: ("response", None) if k < 3 else ("revisit", k % 3) for k in range(30)}


@pytest.mark.parametrize("width", ["300", "5k"])
def test_ranges_cut_anywhere(spark, width):
    """Records, heads and magics that cross byte ranges, and records longer than many ranges; files may end anywhere."""
    rows = [(k, f"https://x/{k}", ("é\r\n\r\n" * (k % 9) + (FAKE if k % 3 == 0 else "") + "y" * (37 * (k % 11)) + MAGIC * (k % 4) + "\r\n" * (k % 3))) for k in range(30)] + [(60, "u", "z" * 9_000 + FAKE + "\r\n"), (61, "u", "dup"), (62, "u", "dup")]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, digest int, block int")
    path = fresh_path(spark, "warc")
    warc.write_archives(pages.coalesce(1), path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", width)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect()}
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    want = {i: (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, _, h in rows}
    assert got == want


def test_long_chain_and_empty(spark):
    path = fresh_path(spark, "warc")
    warc.write_archives(spark.range(300).selectExpr("id as page_id", "'u' as url", "concat('p', id) as html").coalesce(1), path)
    assert warc.read_archives(spark, path).count() == 300
    path = fresh_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_a_cut_file_keeps_what_leads_to_the_cut(spark, tmp_path):
    record = lambda k: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n".encode()
    (tmp_path / "a.warc").write_bytes(record(1) + record(2) + record(3)[:-9])
    assert {r.page_id for r in warc.read_archives(spark, f"file://{tmp_path}").collect()} == {1, 2}
