import struct

from pyspark.sql import functions as F

from weftline.operators import cards, classify, graph, pages, search
from weftline.plans.cover import greedy_cover
from weftline.plans.crawl import crawl, exclusive_assets
from weftline.plans.site import site_tables
from weftline.rules import Site
from weftline.sources import images, responses, robots, sitemaps

SITE = Site("https://s.test")
ROBOTS = "User-agent: a\nUser-agent: *\nDisallow: /p\nAllow: /p/ok$\nDisallow: /*.php\nCrawl-delay: 0,5\nUser-agent: b\nDisallow: /\n# Disallow: /c\nSitemap: https://s.test/sm.xml\n"


def test_robots(spark):
    rules, delay = robots.parse_robots(ROBOTS)
    assert [(n, a, p) for n, a, p, _ in rules] == [(2, False, "/p"), (6, True, "/p/ok$"), (6, False, "/*.php")] and delay == 0.5
    paths = spark.createDataFrame([("/p",), ("/p/ok",), ("/p/ok/x",), ("/x/a.php",), ("/q",), ("/c",)], "path string")
    assert [r.denied for r in robots.robots_verdict(paths, rules).collect()] == [True, False, True, True, False, False]
    # ties allow
    assert not robots.robots_verdict(paths.limit(1), [(2, True, "/p", "^/p"), (2, False, "/p", "^/p")]).first().denied
    lines = spark.createDataFrame([(x,) for x in ROBOTS.splitlines()], "value string")
    assert [r.url for r in robots.declared_sitemaps(lines).collect()] == ["https://s.test/sm.xml"]
    assert robots.finished_robots(ROBOTS, "https://n/s.xml").endswith("Disallow: /\n# Disallow: /c\nSitemap: https://n/s.xml\n") and "Disallow: /" in robots.finished_robots(None, "", staging=True)


def test_sitemap_walk(spark):
    ix = "<sitemapindex><sitemap><loc>https://s.test/{0}.xml</loc></sitemap><sitemap><loc>https://foreign.test/x.xml</loc></sitemap></sitemapindex>"
    rows = [("https://s.test/i.xml", 200, ix.format("j")), ("https://s.test/j.xml", 200, ix.format("u")), ("https://s.test/u.xml", 200, "<urlset><url><loc>https://s.test/a/</loc></url></urlset>"), ("https://foreign.test/x.xml", 200, "<urlset><url><loc>https://no/</loc></url></urlset>"), ("https://s.test/bad.xml", 200, "<html>")]
    d = spark.createDataFrame(rows, "url string, status int, body string")
    got = sitemaps.walk(d, ["https://s.test/i.xml", "https://s.test/bad.xml"], ("s.test",))
    assert [tuple(r)[:3] for r in got.where("note = ''").collect()] == [("https://s.test/a/", 2, "https://s.test/u.xml")]
    assert {tuple(r) for r in got.where("note <> ''").collect()} == {("https://foreign.test/x.xml", k, f"https://s.test/{n}.xml", "foreign-sitemap") for k, n in enumerate("ij")}
    assert sitemaps.walk(d, [], ("s.test",)).count() == 0
    capped = sitemaps.walk(d, ["https://s.test/i.xml", "https://s.test/u.xml"], ("s.test",), max_files=2)
    assert [(r.url, r.note) for r in capped.where("note in ('', 'cap')").collect()] == [("https://s.test/a/", ""), ("https://s.test/j.xml", "cap")]
    assert sitemaps.walk(d, ["https://s.test/i.xml"], ("s.test",), max_depth=1).where("note = 'cap'").first().url == "https://s.test/u.xml"
    assert sitemaps.read_sitemap('<urlset xmlns:i="x"><url><i:image><i:loc>n</i:loc></i:image><loc> y </loc></url></urlset>') == ("urlset", ["y"], [])
    assert sitemaps.candidates("https://s.test/", ["https://s.test/sitemap.xml"])[:2] == ["https://s.test/sitemap.xml", "https://s.test/wp-sitemap.xml"]



def prefixes(spark, rows):
    d = spark.createDataFrame([(f"https://s.test{p}", "", "", False, lang) for p, lang in rows], "url string, save_url string, error string, is_stub boolean, lang string")
    return {r.primary: r.prefix for r in classify.language_prefixes(d).collect()}


def test_language_layouts(spark):
    assert prefixes(spark, [("/", "de-DE"), ("/a/", "de"), ("/en/", "en"), ("/en/a/", "en_US")]) == {"de": "/", "en": "/en/"}
    assert prefixes(spark, [("/de/", "de"), ("/de/a/", "de"), ("/en/", "en")]) == {"de": "/de/", "en": "/en/"}
    assert prefixes(spark, [("/language/de/", "de"), ("/language/de/x/", "de"), ("/language/en/", "en")]) == {"de": "/language/de/", "en": "/language/en/"}
    assert prefixes(spark, [("/a/", "de"), ("/b/", "de"), ("/c/", "en"), ("/d/", "en")]) == {}
    assert prefixes(spark, [("/de/", "de"), ("/de/a/", "en")]) == {}
    assert prefixes(spark, [("/", "de")]) == {}


def test_exclusion_and_report(spark):
    from weftline.queries import _page_rows, index_exclusion

    got = {r.url[-2]: (r.sitemap, r.search) for r in index_exclusion(spark, "").collect()}
    assert got["c"] == ("link-only", "") and got["b"] == ("noindex", "") and got["e"] == ("canonical-mismatch",) * 2 and got["j"] == ("wp-attachment",) * 2
    assert _page_rows(spark).select(classify.index_exclusion(Site("https://site.test", include_linked=True)).alias("x")).where("x = 'link-only'").count() == 0


def test_titles(spark):
    d = spark.createDataFrame([("A - S",), ("B - S",), ("C | S",), ("S",), (" - S",)], "title string")
    assert tuple(pages.title_suffix(d, "S").first()) == (" - S", 2)
    assert [r[0] for r in d.select(pages.strip_suffix(F.col("title"), " - S")).collect()] == ["A", "B", "C | S", "S", " - S"]
    assert tuple(classify.majority(spark.createDataFrame([("b",), ("a",), ("",)], "v string"), "v", prefer="b").first()) == ("b", 1)


DOCS = [
    ("/a/", "Fassade Holz", "kurz", "alles über Straßen und Fassaden", "2024-01-02"), ("/b/", "Straße", "", "nichts", "2023-01-01"), ("/c/", "Neues", "Fassade Holz im Bild", "x", "2. Juni 2026"),
    ("/d/", "Anderes", "", "die Fassade aus Holz; Fassade Holz", "2022-01-01T00:00:00+02:00"), ("/e/", "Holz", "", "eine Fassade", ""), ("/f/", "Weit", "", "holz und viel später fassade", "2025-01-01"),
]


def found(spark, query, lang=""):
    rows = [(p, "SEO", d, x, (t, "", i, "de" if p != "/f/" else "en")) for p, t, d, x, i in DOCS]
    d = spark.createDataFrame(rows, search.DOCS)
    return [(r.path, r["rank"]) for r in search.search(search.search_fields(d), query, lang).collect()]


def test_search_ranks(spark):
    assert found(spark, "strasse") == [("/b/", 1), ("/a/", 2)]
    assert found(spark, "Fassade Holz") == [("/a/", 1), ("/e/", 3), ("/c/", 4), ("/d/", 5), ("/f/", 6)]
    assert found(spark, "holz fassade") == [("/a/", 2), ("/e/", 3), ("/f/", 6), ("/d/", 6), ("/c/", 6)]
    assert found(spark, '"fassade holz"') == [("/a/", 1), ("/d/", 2), ("/c/", 2)]
    assert [p for p, _ in found(spark, "")] == ["/f/", "/a/", "/b/", "/d/", "/c/", "/e/"]
    assert found(spark, "zzz") == [] and ("/f/", 6) not in found(spark, "holz fassade", lang="de")
    assert search.query_terms("a b c d e f g h i")[1] == list("abcdefgh")


def test_terms(spark):
    d = spark.createDataFrame([("1", "alpha beta unbelievable"), ("2", "alpha gamma"), ("3", "alpha 123 beta")], "path string, text string")
    assert {r.word: r.df for r in search.document_frequency(d).collect()} == {"alpha": 3, "beta": 2, "gamma": 1, "unbelievable": 1}
    assert search.rare_term(search.document_frequency(d)).first().word == "unbelievable"
    e = spark.createDataFrame([("1", "ab"), ("2", "bc"), ("3", "cd"), ("4", "de")], "path string, text string")
    assert [tuple(r)[1:] for r in greedy_cover(e).collect()] == [("b", 2), ("d", 2)]
    f = spark.createDataFrame([("ČEŠTINA Őrült Việt ελλάς naïve",), (None,)], "t string").select(search.folded(F.col("t")).alias("f")).collect()
    assert [r.f for r in f] == ["cestina orult viet ελλας naive", None]
    u = spark.createDataFrame([("1", "čeština"), ("2", "cestina")], "path string, text string")
    assert {r.word: r.df for r in search.document_frequency(u).collect()} == {"cestina": 2}
    many = spark.createDataFrame([(str(k), f"q{k}") for k in range(3)] + [("n", "")], "path string, text string")
    assert [tuple(r) for r in greedy_cover(many).collect()] == [(1, "q", 3), (None, None, 1)]
    s = spark.createDataFrame([("you searched for te - te x",)], "t string").select(search.split_echo(F.col("t"), "te").alias("e")).first().e
    assert (s.before, s.after) == ("you searched for te - ", " x")


def test_missing_refs(spark):
    refs = spark.createDataFrame([("f", r) for r in ("/a/", "/b", "/c.css?v=1", "/d/", "/wp-content/x/", "/e/", "//x/", "rel", "/t/{id}", "/wp-json/x", "/cdn-cgi/l/email-protection#1", "/ä.png")], "file string, ref string")
    files = spark.createDataFrame([(p,) for p in ("a/index.html", "b/index.html", "c.css", "d/", "wp-content/x/", "index.html")], "path string")
    errors = spark.createDataFrame([("https://s.test/%C3%A4.png",)], "url string")
    assert {(r.ref, r.origin_error) for r in graph.missing_refs(refs, files, errors).collect()} == {("/d/", False), ("/e/", False), ("/ä.png", True)}


def test_crawl(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("a", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("a", "sitemap"), ("a", "sitemap")], "url string, source string")
    assert {r.url: r["round"] for r in crawl(edges, seeds).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r.url for r in crawl(edges, seeds, max_pages=2).collect()} == {"a", "b"}
    used = spark.createDataFrame([("c",)], "url string")
    assert {r.url for r in exclusive_assets(edges, used, seeds).collect()} == {"a", "b", "d"}


def test_crawl_follows_a_chain_of_over_a_hundred_hops(spark):
    edges = spark.createDataFrame([(f"p{k}", f"p{k + 1}") for k in range(103)], "src string, dst string").coalesce(1).cache()
    seeds = spark.createDataFrame([("p0", "sitemap")], "url string, source string")
    assert {r.url: r["round"] for r in crawl(edges, seeds).collect()} == {f"p{k}": k for k in range(104)}
    assert crawl(edges, seeds, max_rounds=2).count() == 3


def test_cards_round_trip(spark):
    html = [f'<li class="post-{k}"><a href="/p{k}/">T{k}</a>{"<img src=x><b>i</b>" if k % 2 else ""}<span>by</span></li>' for k in range(4)]
    rows = spark.createDataFrame([("a", str(k), h) for k, h in enumerate(html)], "layout string, card string, html string")
    t = cards.templates(rows).first()
    assert t.optional == ["li/b0", "li/img0"]
    by = {}
    for r in cards.walk_cards(rows).collect():
        by.setdefault(r.card, ({}, set()))[1 if r.kind == "el" else 0]
        if r.kind == "el":
            by[r.card][1].add(r.key)
        else:
            by[r.card][0][r.key] = r.value
    for k, h in enumerate(html):
        assert cards.render(t.template, *by[str(k)]).replace("</img>", "") == h.replace("<img src=x>", '<img src="x">')


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 7, 9)
    jpg = b"\xff\xd8\xff\xc0" + struct.pack(">HBHH", 8, 8, 30, 40) + b"\0" * 8
    exif = b"Exif\0\0II*\0\x08\0\0\0\x01\0" + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0)
    turned = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + jpg[2:]
    vp8x = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert [images.image_size(x) for x in (png, jpg, turned, b"GIF89a\x05\0\x06\0", vp8x, b"", None, b"<svg>")] == [(7, 9), (40, 30), (30, 40), (5, 6), (100, 50), None, None, None]
    d = spark.createDataFrame([(png,), (b"x",)], "content binary")
    assert [r.size and tuple(r.size) for r in images.with_sizes(d).collect()] == [(7, 9), None]
    d = spark.createDataFrame([(100, 90, False), (100, 95, False), (100, 98, True), (0, 0, True)], "before long, after long, lossless boolean")
    assert tuple(images.savings(d).first()) == (4, 2, 300, 288)


def test_responses_and_site(spark):
    page = '<html lang="en"><head><title>{0} - S</title></head><body><main><p>{0} text</p>{1}</main></body></html>'
    rows = [
        ("https://s.test/", 200, "text/html; charset=utf-8", page.format("Home", '<a href="/a">a</a><a href="/gone/">g</a>'), "https://s.test/", []),
        ("https://s.test/a/", 200, "TEXT/HTML", page.format("Äpfel", '<a href="https://s.test/">h</a>'), "https://s.test/a/", [("https://s.test/a", 301)]),
        ("https://s.test/gone/", 404, "text/html", "", "https://s.test/gone/", []),
        ("https://s.test/x.png", 200, "text/html", "", "https://s.test/x.png", []),
        ("https://s.test/download/9/", 200, "application/pdf", "", "https://s.test/download/9/", []),
    ]
    d = spark.createDataFrame([(u, s, {"Content-Type": k, "Vary": "Cookie"}, b.encode(), f, h) for u, s, k, b, f, h in rows], responses.SCHEMA)
    out = {r.url: r for r in responses.outcomes(d, SITE).collect()}
    assert out["https://s.test/gone/"].error == "HTTP 404" and out["https://s.test/"].negotiated and out["https://s.test/a/"].is_html
    assert [tuple(r) for r in responses.asset_errors(d).collect()] == [("https://s.test/x.png", "got text/html for an asset")]
    assert [tuple(r) for r in responses.redirects(d).collect()] == [("https://s.test/a", "https://s.test/a/", 301)]
    found_ = responses.downloads(d, SITE)
    assert [tuple(r) for r in found_.collect()] == [("/download/9/", "/download/9/9.pdf")]
    claimed = spark.createDataFrame([("/download/9",)], "from_path string")
    assert [tuple(r) for r in responses.download_rules(found_, claimed).collect()] == [("/download/9/", "/download/9/9.pdf")]
    t = site_tables(d, spark.createDataFrame([("https://s.test/", "sitemap")], "url string, source string"), SITE)
    assert {r.url: r["round"] for r in t["pages"].collect()} == {"https://s.test/": 0, "https://s.test/a/": 1, "https://s.test/gone/": 1}
    assert [(r.url, r.lastmod) for r in t["sitemap"].collect()] == [("https://s.test/", "")]
    assert [r.path for r in search.search(t["index"], "apfel").collect()] == ["/a/"]
    assert (t["report"].first().pages_ok, t["report"].first().pages_failed) == (2, 1)


def test_first_writes_and_stub(spark):
    d = spark.createDataFrame([("b", 1, "p"), ("a", 1, "p"), ("c", 0, "q"), ("d", 0, None)], "url string, round int, rel_path string")
    assert {(r.url, r.rel_path) for r in responses.first_writes(d).collect()} == {("a", "p"), ("c", "q")}
    assert 'url=/a?&quot;&amp;"' in spark.range(1).select(responses.stub_page(F.lit('/a?"&')).alias("x")).first().x




def test_text_files(spark):
    files = spark.createDataFrame([("a.css", "p{background:url( '/i.png' )} @import \"/b.css\"; x{y:url(data:1)}"), ("b.js", "var a='/wp-content/x.js', b=\"/cdn-cgi/y\\\\\";"), ("c.html", "http://192.168.1.9:80/ http://localhost/ https://ok.test/ http://nas.local/")], "file string, text string")
    assert {r.ref for r in graph.css_refs(files.where("file = 'a.css'")).collect()} == {"/i.png", "/b.css"}
    assert {r.ref for r in graph.script_refs(files).collect()} == {"/wp-content/x.js", "/cdn-cgi/y"}
    assert {r.url for r in graph.private_urls(files, ("nas.local",)).collect()} == {"http://192.168.1.9:80", "http://localhost"}
    hosts = spark.createDataFrame([(h,) for h in ("10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.0.1", "192.169.0.1", "Localhost", "a.local", "10.example.com", "")], "h string")
    assert [r.p for r in hosts.select(graph.is_private(F.col("h")).alias("p")).collect()] == [True, True, False, True, False, True, True, False, False]
    assert graph.leftovers(files, "new.test", "ok.test").first().n == 1
    paths = spark.createDataFrame([("wp-json",), ("a/wp-login.php",), ("index.html",)], "path string")
    assert graph.dynamic_files(paths).count() == 2 and graph.has_homepage(paths).first()[0]
