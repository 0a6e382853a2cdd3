import json

from weftline.operators import results
from weftline.rules import Site
from weftline.sources import responses

SITE = Site("https://x.de")


def test_forms_and_minify(spark):
    html = '<form role="search"><a href=" ">go</a></form><form action="/o"><input name="o"></form>'
    out, n = results.wire_form(html, "/s/")
    assert n == 3 and out == '<form role="search" action="/s/" method="get"><a href="/s/">go</a></form><form action="/o"><input name="o"/></form>'
    assert results.wire_form(out, "/s/")[1] == 0
    page = '<p style="a:b /* c */"><!-- c --><style> a { b : c } </style><script>\n<!--\nx()\n</script><script type="application/json">{"a": "<!--"}</script><textarea><!-- t --></textarea></p>'
    out, saved = results.minify_inline(page)
    assert "c -->" not in out and "a{b : c}" in out and "\nx()\n" in out and '{"a": "<!--"}' in out and saved > 0
    d = spark.createDataFrame([("u", page), ("v", "<p>x</p>")], "url string, html string")
    assert [r.url for r in results.minified(d).collect()] == ["u"]


def test_cards_and_slots(spark):
    cards = spark.createDataFrame([("1", '<a href="/tag/x/">t</a><a href="/b/?q=1#f">b</a><a href="/a/">a</a>'), ("2", '<a href="//o.test/a/">o</a>'), ("3", "<p>/a/</p>")], "card string, html string")
    index = spark.createDataFrame([("/a/",), ("/b/",)], "path string")
    assert [tuple(r) for r in results.card_pages(cards, index).collect()] == [("1", "/b/")]
    files = spark.createDataFrame([("a/index.html",), ("b/index.html",)], "path string")
    got = [tuple(r) for r in results.without_dead_links(cards, files).collect()]
    assert got == [("1", '<a>t</a><a href="/b/?q=1#f">b</a><a href="/a/">a</a>', 1)]


def test_text_assets_and_hosts(spark):
    d = spark.createDataFrame([("https://x.de/m.webmanifest", '{"start_url": "https:\\/\\/x.de\\/a\\/", "icons": [{"src": "https://www.x.de/i.png"}]}'), ("https://x.de/n.json", None)], "url string, text string")
    rows = {r.url: r for r in results.text_assets(d, SITE).collect()}
    assert json.loads(rows["https://x.de/m.webmanifest"].text) == {"start_url": "/a/", "icons": [{"src": "/i.png"}]}
    assert {tuple(x) for x in rows["https://x.de/m.webmanifest"].links} == {("page", "https://x.de/a/"), ("asset", "https://x.de/i.png")}
    h = spark.createDataFrame([("https://A.test:8080/x http://b.test/ wss://c.test",)], "html string")
    assert {r.host for r in results.named_hosts(h).collect()} == {"a.test:8080", "b.test", "c.test"}


def test_sliders(spark):
    blobs = spark.createDataFrame([("u", "1", '{"slides": {"a": {"slide": {"id": 7}, "layers": []}}}'), ("v", "1", "{"), ("w", "2", "{}")], "url string, slider_id string, blob string")
    objects = spark.createDataFrame([("1", '{"slides": {"z": {"slide": {"id": "7"}, "layers": [1]}}}')], "slider_id string, object string")
    assert [(r.url, json.loads(r.blob)["slides"]["a"]["layers"], r.n) for r in results.hydrated_sliders(blobs, objects).collect()] == [("u", [1], 1)]


def test_decomposed_retries_and_raw_files(spark):
    nfc, nfd = "https://x.de/%C3%A4/", "https://x.de/a%CC%88/"
    rows = [(nfc, 404, {"Content-Type": "text/html"}, b"no", nfc, []), (nfd, 200, {"Content-Type": "text/html"}, b"yes", nfd, []), ("https://x.de/b/", 404, {}, b"no", "", []), ("https://x.de/f/", 200, {"content-type": "application/pdf"}, b"pdf", "", [])]
    d = spark.createDataFrame(rows, responses.SCHEMA)
    got = {r.url: (r.status, bytes(r.body)) for r in responses.with_retries(d).collect()}
    assert got == {nfc: (200, b"yes"), nfd: (200, b"yes"), "https://x.de/b/": (404, b"no"), "https://x.de/f/": (200, b"pdf")}
    assert [r.url for r in results.raw_files(d).collect()] == ["https://x.de/f/"]


def test_output_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/index.html").write_text("<p>ä")
    (tmp_path / "b.css").write_text("p{}")
    (tmp_path / "c.bin").write_bytes(b"x")
    assert {tuple(r) for r in results.output_tree(spark, f"file://{tmp_path}").collect()} == {("a/index.html", "<p>ä"), ("b.css", "p{}")}
