import json

import pytest
from pyspark.sql import functions as F

from weftline.__main__ import main
from weftline.operators import checks, classify, search
from weftline.sources import responses


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_probes(spark):
    p = rows(spark, [("/", 404, "<html>"), ("/en/", 200, "<html>"), ("/fr/", 404, None)], "prefix string, status int, html string")
    assert [r.verdict for r in checks.soft_404(p).collect()] == ["themed", "soft-404", "missing"]
    d = rows(spark, [("<title>You searched for Te</title>",), ("<h1>te</h1>",), ("<p>te</p>",)], "h string")
    assert [r[0] for r in d.select(checks.echoes(F.col("h"), "te")).collect()] == [True, True, False]
    links = rows(spark, [(0, "/page/3/?s=te", "", ""), (1, "/page/2/?s=te", "next", ""), (2, "/page/4/?s=ten", "next", "")], "pos int, url string, rel string, class string")
    assert checks.next_probe(links, "te").first().url == "/page/2/?s=te"
    assert checks.next_probe(links, "te", ("/page/2/?s=te",)).first().url == "/page/3/?s=te"


def test_hosts_and_warnings(spark):
    edges = rows(spark, [("external", "https://cms.other/wp-content/a.png"), ("external", "https://y/x"), ("page", "https://s/")], "kind string, dst string")
    assert [tuple(r) for r in checks.foreign_site_hosts(edges, ("s",)).collect()] == [("cms.other", 1)]
    hosts = rows(spark, [("a",), ("b",), ("c",)], "host string")
    addresses = rows(spark, [("a", "10.0.0.1"), ("b", "10.0.0.1"), ("b", "8.8.8.8"), ("c", "127.0.0.1")], "host string, address string")
    assert [r.host for r in checks.private_hosts(hosts, addresses).collect()] == ["a"]
    out = rows(spark, [(True, ""), (False, "")], "negotiated boolean, error string")
    assert sorted(r.kind for r in checks.warnings(out, rows(spark, [("h", 9), ("g", 1)], "host string, n long")).collect()) == ["folded-host", "negotiated-variants"]


@pytest.mark.parametrize("path, ok", [("/search/", True), ("search/", False), ("/", False), ("/a//b/", False), ("/../", False), ("/wp-admin/", False), ("/a.html/", False), ("/ä/", False)])
def test_search_path(path, ok):
    assert (checks.search_path_error(path) == "") is ok


def test_files_and_settings(spark):
    files = rows(spark, [("search/index.html",), ("x",)], "path string")
    assert checks.collision(files, "/search/").count() == 1 and checks.collision(files, "/find/").count() == 0
    p = rows(spark, [("de_AT",), ("en-US",), ("fr",)], "lang string")
    s = rows(spark, [("de-at", "A"), ("de", "B"), ("en", "C")], "key string, setting string")
    assert {r.lang: r.setting for r in classify.page_language_settings(p, s, "D").collect()} == {"de_AT": "A", "en-US": "C", "fr": "D"}
    q = rows(spark, [("https://s/en/a/",), ("https://s/b/",)], "url string")
    pre = rows(spark, [("de", "/"), ("en", "/en/")], "primary string, prefix string")
    assert [r.primary for r in classify.by_prefix(q, pre).collect()] == ["en", "de"]
    f = rows(spark, [(True, False), (False, False)], "search_form boolean, search_link boolean")
    assert checks.offers_search(f).first()[0] and not checks.offers_search(f.where("not search_form")).first()[0] and checks.offers_search(f.limit(0), forced=True).first()[0]


def test_index_json(spark):
    d = rows(spark, [("/a/", 'T"', "d", None, ("t", None, "2024-01-01", "de"))], search.DOCS)
    assert json.loads(search.index_json(d).first().doc) == ["/a/", 'T"', "d", "", {"t": "t", "i": "2024-01-01", "l": "de"}]


def test_command_line(spark, tmp_path):
    page = b"<html lang=en><head><title>Home</title></head><body><main>x<a href=/gone/>g</a></main></body></html>"
    data = [("https://s.test/", 200, {"content-type": "text/html"}, page, "https://s.test/", []), ("https://s.test/gone/", 404, {"content-type": "text/html"}, b"", "https://s.test/gone/", [])]
    rows(spark, data, responses.SCHEMA).write.parquet(str(tmp_path / "r"))
    argv = ["--base", "https://s.test", "--responses", str(tmp_path / "r"), "--out", str(tmp_path / "o")]
    assert main(argv) == 0 and main([*argv, "--strict"]) == 1
    assert json.load(open(tmp_path / "o/report.json"))["pages_ok"] == 1 and "pages failed: 1" in open(tmp_path / "o/report.txt").read()
    with pytest.raises(SystemExit):
        main([*argv, "--search-path", "x"])
