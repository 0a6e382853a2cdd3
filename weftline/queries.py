"""Queries over the test tables, each with the SQL that gives the same rows.

Operators whose markup the pages table doesn't hold run on small VALUES tables,
which both engines share as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import rewrite
from weftline.functions import urls as U
from weftline.operators import cards, classify, graph, pages, results, search
from weftline.plans.cover import greedy_cover
from weftline.plans.crawl import crawl, written
from weftline.rules import Site, load_rules
from weftline.sources import responses, robots, sitemaps
from weftline.streaming.ingest import event_counts

RULES = load_rules()
SITE = Site("https://site.test", own_hosts=("alias.test",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parsed(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """The parsed pages: their signals, and what `parts` names besides."""
    return pages.parse_pages(table(spark, sf_dir, "pages"), parts=parts)


def _meta(rows: DataFrame) -> DataFrame:
    return rows.select("url", F.lit("").alias("save_url"), F.lit("").alias("error"), F.lit(False).alias("is_stub"), "lang")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.lit(None).cast("struct<t:string,e:string,i:string,l:string>").alias("slot")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), first.alias("title"), F.lit("").alias("desc"), "text", slot)


# --- pages ------------------------------------------------------------------


def page_search(spark, sf_dir):
    """Flagship: parse, index and search the captured pages."""
    docs = parsed(spark, sf_dir, "text").select(F.col("url").alias("path"), "title", F.col("description").alias("desc"), "text", F.struct(F.lit("").alias("t"), F.lit("").alias("e"), "date", "lang").cast("struct<t:string,e:string,i:string,l:string>").alias("slot"))
    return search.search(search.search_fields(docs), "the tion", lang="en", limit=50).select("path", "rank")


def language_counts(spark, sf_dir):
    return classify.language_counts(_meta(parsed(spark, sf_dir)))


def host_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(U.host_key(U.url_host(F.col("url"))).alias("host")).agg(F.count("*").alias("n"))


def extension_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(U.extension(U.url_path(F.col("url"))).alias("ext")).agg(F.count("*").alias("n"))


def page_signals(spark, sf_dir):
    return parsed(spark, sf_dir).select("url", "title", "lang", "has_title", "has_description", "has_viewport", "noindex", "canonical", "artifact", "search_form")


def page_links(spark, sf_dir):
    return graph.anchors(table(spark, sf_dir, "pages"))


def page_edges(spark, sf_dir):
    return pages.links(parsed(spark, sf_dir, "links")).where("kind = 'page' and tag = 'a'").select("src", "dst").distinct()


def link_kinds(spark, sf_dir):
    return graph.link_kinds(page_links(spark, sf_dir))


def link_in_degree(spark, sf_dir):
    return graph.in_degree(page_links(spark, sf_dir))


def dangling_links(spark, sf_dir):
    links = page_links(spark, sf_dir)
    files = links.where("length(href) <= 4").select(F.concat(F.substring("href", 2, 100), F.lit("/index.html")).alias("path"))
    return graph.missing_refs(links.select(F.col("url").alias("file"), F.col("href").alias("ref")), files).select("file", "ref")


def normalized_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", U.page_url(F.col("url"), RULES).alias("page"))


def skipped_query_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(U.url_query(F.col("url")) != "").select(F.regexp_replace("url", "#.*$", "").alias("url")).distinct()


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/ # english\nAllow: /en/*5\nDisallow: /*.html$\nAllow: /fr/\nDisallow: /fr/\nDisallow:\nCrawl-delay: 1,5\n"


def robots_verdict(spark, sf_dir):
    rules, _ = robots.parse_robots(ROBOTS)
    # A verdict is a URL's, however often it was captured.
    rows = table(spark, sf_dir, "pages").select("url").distinct().withColumn("path", U.url_path(F.col("url")))
    return robots.robots_verdict(rows, rules).select("url", "denied")


def host_language_prefixes(spark, sf_dir):
    rows = _meta(parsed(spark, sf_dir)).withColumn("host", U.host_key(U.url_host(F.col("url"))))
    return classify.language_prefixes(rows, by=("host",))


def noise_free_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(pages.noise_free(F.col("html"))).alias("digest"))


def reachable(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(r'<a\b[^>]*?\bhref="([^"]*)"'), F.lit(1))
    rows = table(spark, sf_dir, "pages").select(found.alias("h"))
    edges = rows.select(F.inline(F.arrays_zip(F.slice("h", 1, F.size("h")).alias("src"), F.slice("h", 2, F.size("h")).alias("dst")))).where("dst is not null").distinct()
    edges = written(edges)
    seeds = edges.where("src in ('/the', '/de')").select(F.col("src").alias("url"), F.lit("sitemap").alias("source"))
    return crawl(edges, seeds).select("url")


def page_text(spark, sf_dir):
    return parsed(spark, sf_dir, "text").select("url", "text", "whole_body", "date")


def rewritten_pages(spark, sf_dir):
    out = rewrite.rewrite_pages(table(spark, sf_dir, "pages"), Site("https://example.com"), staging=True, minify=True)
    return out.select("url", F.length("html").cast("long").alias("chars"), "error")


# --- documents --------------------------------------------------------------


def ranked_search(spark, sf_dir):
    docs = search.search_fields(_docs(spark, sf_dir))
    return search.search(docs, "licensed under the", limit=50).select("path", "rank")


def phrase_search(spark, sf_dir):
    docs = search.search_fields(_docs(spark, sf_dir))
    return search.search(docs, '"Licénsed under the"', limit=50).select("path", "rank")


def document_frequency(spark, sf_dir):
    return search.document_frequency(_docs(spark, sf_dir))


def rare_term(spark, sf_dir):
    return search.rare_term(written(search.document_frequency(_docs(spark, sf_dir))))


def cover_terms(spark, sf_dir):
    return greedy_cover(_docs(spark, sf_dir))


def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", U.clip(F.col("text"), 120).alias("snippet"))


def echo_split(spark, sf_dir):
    e = search.split_echo(F.col("text"), "the")
    return table(spark, sf_dir, "documents").where(e.isNotNull()).select("doc_id", F.length(e["before"]).cast("long").alias("before"), F.length(e["after"]).cast("long").alias("after"))


def majority_language(spark, sf_dir):
    return classify.majority(table(spark, sf_dir, "documents"), "lang")


# --- fixtures ---------------------------------------------------------------

PAGE_ROWS = """
  ('https://site.test/', '', 'text/html', 'sitemap', false, '', '', false, '', 'Wed, 21 Oct 2015 07:28:00 GMT'),
  ('https://site.test/a/', '', 'text/html', 'sitemap', false, 'https://www.site.test/a', '', false, '', 'bad'),
  ('https://site.test/b/', '', 'text/html', 'sitemap', true, '', '', false, '', ''),
  ('https://site.test/c/', '', 'text/html', 'link', false, '', '', false, '', ''),
  ('https://site.test/d/', '', 'text/html', 'sitemap', false, 'https://site.test/a/', '', false, '', ''),
  ('https://site.test/e/', '', 'text/html', 'sitemap', false, 'https://site.test/e/?x=1', '', false, '', ''),
  ('https://site.test/f/', '', 'text/html', 'sitemap', false, 'https://other.test/', '', false, '', ''),
  ('https://site.test/g/', 'HTTP 404', 'text/html', 'sitemap', false, '', '', false, '', ''),
  ('https://site.test/h/', '', 'application/pdf', 'sitemap', false, '', '', false, '', ''),
  ('https://site.test/i/', '', 'text/html', 'sitemap', false, '', '', true, '', ''),
  ('https://site.test/j/', '', 'text/html', 'link', true, '', 'wp-attachment', false, '', ''),
  ('https://site.test/k/', '', 'text/html', 'sitemap', false, '', '', false, 'https://site.test/a/', 'Sun, 06 Nov 1994 08:49:37 GMT')
"""
PAGE_COLUMNS = "url, error, content_type, source, noindex, canonical, artifact, is_stub, save_url, last_modified"


def _page_rows(spark: SparkSession) -> DataFrame:
    rows = spark.sql(f"select * from values {PAGE_ROWS} as t({PAGE_COLUMNS})")
    return rows.withColumn("alternates", F.create_map().cast("map<string,string>"))


def index_exclusion(spark, sf_dir):
    return _page_rows(spark).select("url", classify.index_exclusion(SITE).alias("sitemap"), classify.index_exclusion(SITE, "search").alias("search"))


def sitemap_entries(spark, sf_dir):
    return sitemaps.sitemap_entries(_page_rows(spark).withColumn("exclusion", classify.index_exclusion(SITE))).select("url", "lastmod")


REDIRECTS = """
  ('https://site.test/old/', 'https://site.test/new/', 301), ('https://site.test/old', 'https://site.test/new2/', 301),
  ('https://site.test/a', 'https://site.test/a/', 301), ('https://site.test/b/', 'https://site.test/b', 302),
  ('https://site.test/q?x=1', 'https://site.test/z/', 301), ('https://site.test/ext/', 'https://other.test/', 301),
  ('https://site.test/bad$/', 'https://site.test/n/', 301), ('https://site.test/t/', 'https://alias.test/u/?k=v', 301),
  ('https://site.test/old/', 'https://site.test/newer/', 301)
"""


def redirect_rules(spark, sf_dir):
    return responses.redirect_rules(spark.sql(f"select * from values {REDIRECTS} as t(from_url, to_url, status)"), SITE)


EMAILS = "('0a6b4a682469'), ('7b12151d143b1e031a160b171e551418'), ('zz'), ('0a'), ('5aff'), ('')"


def email_decode(spark, sf_dir):
    return spark.sql(f"select * from values {EMAILS} as t(code)").select("code", U.decoded_email(F.col("code")).alias("mail"))


B64 = "('aHR0cHM6Ly9zaXRlLnRlc3QvYS5wbmc='), ('L3dwLWNvbnRlbnQvYS5wbmc='), ('Ly9zaXRlLnRlc3QvYj9jPWQ_'), ('bm90IGEgdXJsIGF0IGFsbA=='), ('short'), ('!!!!!!!!!!')"


def b64_urls(spark, sf_dir):
    return spark.sql(f"select * from values {B64} as t(value)").select("value", U.b64_url_column(F.col("value")).alias("url"))


MOBILE = """
  ('u1', '<p>a</p><!-- 1 -->', '<p>a</p><!-- 2 -->', true, null), ('u2', '<p>a</p>', '<p>b</p>', true, '<p>a</p>'),
  ('u3', '<p>a</p>', '<p>b</p>', true, '<p>c</p>'), ('u4', '<p>a</p>', null, false, null), ('u5', '<p>a?ver=1</p>', '<p>a?ver=2</p>', true, null)
"""


def mobile_verdicts(spark, sf_dir):
    return classify.mobile_verdict(spark.sql(f"select * from values {MOBILE} as t(url, desktop, mobile, mobile_ok, control)")).select("url", "verdict")


SITEMAPS = """
  ('https://site.test/index.xml', 200, '<x:sitemapindex xmlns:x="s"><x:sitemap><x:loc>https://site.test/a.xml</x:loc></x:sitemap><x:sitemap><x:loc> https://www.site.test/b.xml </x:loc></x:sitemap><x:sitemap><x:loc>https://other.test/c.xml</x:loc></x:sitemap></x:sitemapindex>'),
  ('https://site.test/a.xml', 200, '<urlset xmlns:i="i"><url><loc>https://site.test/a/?b=1&amp;c=2</loc><i:image><i:loc>https://site.test/i.png</i:loc></i:image></url><url><loc><![CDATA[https://site.test/b/]]></loc></url></urlset>'),
  ('https://www.site.test/b.xml', 200, '<urlset><url><loc>https://other.test/x/</loc></url><url><loc>https://www.site.test/d/</loc></url></urlset>'),
  ('https://other.test/c.xml', 200, '<urlset><url><loc>https://site.test/never/</loc></url></urlset>'),
  ('https://site.test/gone.xml', 404, '<urlset><url><loc>https://site.test/never/</loc></url></urlset>'),
  ('https://site.test/bad.xml', 200, '<urlset><url>')
"""


def sitemap_walk(spark, sf_dir):
    rows = spark.sql(f"select * from values {SITEMAPS} as t(url, status, body)")
    roots = [f"https://site.test/{name}.xml" for name in ("index", "gone", "bad", "absent")]
    return sitemaps.walk(rows, roots, ("site.test",))


PAGES = """
  ('https://site.test/a/', '<html lang="en"><head><title> A </title><meta name="Description" content="d"><meta name="viewport" content="w"><link rel="canonical" href=" https://site.test/b/ "></head><body><a href="https://other.test/?s=x">s</a></body></html>'),
  ('https://site.test/b/', '<html><head><title></title><meta name="robots" content="NOINDEX, follow"></head><body class="attachment"><form role="search"></form></body></html>'),
  ('https://site.test/c/', '<html lang="de"><head><meta name="description" content=" "></head><body class="archive"><p class="no-results not-found">x</p><form><input name="s"></form></body></html>'),
  ('https://site.test/phpthumb_cache_1/d', '<html><body><a href="/?q=x">s</a></body></html>')
"""


def signal_fixture(spark, sf_dir):
    """What the captured pages never hold: descriptions, viewports, canonicals, robots, artifacts, searches on and off the site."""
    rows = pages.parse_pages(spark.sql(f"select * from values {PAGES} as t(url, html)"))
    return rows.select("url", "title", "lang", "has_title", "has_description", "has_viewport", "noindex", "canonical", "artifact", "search_form", "search_link")


LINKED = """
  ('https://site.test/', '<a href="/download/9/?x=1">d</a><a href="/Download/9">no</a><a href="https://site.test/download/9/">no</a>'),
  ('https://site.test/b/', '<a href="/download/8#a">e</a><img src="/download/9">'), ('https://site.test/c/', '<p>/download/9/</p>')
"""
ENDPOINTS = "('/download/9/', '/download/9/f.pdf'), ('/download/8', '/download/8/g.zip')"


def rewritten_downloads(spark, sf_dir):
    linked = spark.sql(f"select * from values {LINKED} as t(url, html)")
    return rewrite.rewrite_downloads(linked, spark.sql(f"select * from values {ENDPOINTS} as t(endpoint, file_path)")).select("url", "html", "n")


def image_sizes(spark, sf_dir):
    """Sizes of images, joined with the pages that show them: here every page of the table shows its own number."""
    rows = table(spark, sf_dir, "pages").groupBy("url").agg(F.pmod(F.min("page_id"), F.lit(7)).cast("string").alias("k"))
    shown = rows.select("url", F.concat(F.lit('<img src="/a.png"><img src="/i'), "k", F.lit('.png?v=1">')).alias("html"))
    sizes = spark.range(5).select(F.concat(F.lit("/i"), F.col("id").cast("string"), F.lit(".png")).alias("path"), (F.col("id") + 10).alias("width"), (F.col("id") + 20).alias("height"))
    return rewrite.size_images(shown, sizes).select("url", "html")


FILES = """
  ('a/index.html', '<link rel="canonical" href="https://site.test/a/"><a href="https://www.site.test/b/" title="https://site.test/">x</a><style>p{background:url(https://site.test/i.png)}</style>'),
  ('b/index.html', '<script type="application/ld+json">{"u": "https://site.test/"}</script><meta content="https://site.test/">'),
  ('c.css', 'p{background:url(//site.test/i.png)}'), ('d.js', 'var u = "https://other.test/"'), ('e.txt', 'https://site.test/')
"""


def origin_refs(spark, sf_dir):
    return graph.origin_refs(spark.sql(f"select * from values {FILES} as t(file, text)"), SITE)


def unresolved_locs(spark, sf_dir):
    """The captured URLs as a sitemap against a tree that holds the paths of three letters and fewer."""
    urls = table(spark, sf_dir, "pages").select("url")
    body = urls.select(F.concat(F.lit("<urlset><url><loc>"), F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</loc></url></urlset>")).alias("body"))
    files = urls.where(F.length(U.url_path(F.col("url"))) <= 7).select(F.concat(F.regexp_replace(U.url_path(F.col("url")), "^/+|/+$", ""), F.lit("/index.html")).alias("path"))
    return sitemaps.unresolved_locs(body, files)


FORMS = """
  ('u1', '<form role="search" action="/old"><a href="">go</a></form>'), ('u2', '<form action="/s/" method="GET"><input name="s"></form>'),
  ('u3', '<form action="/mail"><input name="m"></form>'), ('u4', '<p>form</p>')
"""


def wired_forms(spark, sf_dir):
    return results.wire_forms(spark.sql(f"select * from values {FORMS} as t(url, html)"), "/s/").select("url", "n")


def card_pages(spark, sf_dir):
    """The lists of links of the captured pages as cards, against an index of the paths of at most four characters."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("card"), F.regexp_extract("html", "(?s)<ul>(.*?)</ul>", 1).alias("html"))
    index = page_links(spark, sf_dir).where("length(href) <= 4 and href rlike '^/[a-z]+$'").select(F.col("href").alias("path"))
    return results.card_pages(rows, index)


def dead_card_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("card"), F.regexp_extract("html", "(?s)<ul>(.*?)</ul>", 1).alias("html"))
    files = page_links(spark, sf_dir).where("length(href) <= 4 and href rlike '^/[a-z]+$'").select(F.concat(F.substring("href", 2, 9), F.lit("/index.html")).alias("path"))
    return results.without_dead_links(rows, files).select("card", "n")


SLOTS = "('/a/', 'T', 'excerpt one'), ('/b/', 'U', ''), ('/x/', 'V', 'no page')"


def slot_index(spark, sf_dir):
    none = "cast(null as struct<t:string,e:string,i:string,l:string>) as slot"
    docs = spark.sql(f"select *, {none} from values ('/a/', 'A'), ('/b/', 'B'), ('/c/', 'C') as t(path, title)")
    slots = spark.sql(f"select path, named_struct('t', t, 'e', e, 'i', '', 'l', '') as slot from values {SLOTS} as s(path, t, e)")
    out = results.with_slots(docs, slots)
    snippet = results.snippet_length(out).first().snippet
    return out.select("path", "title", F.col("slot.t").alias("slot_title"), F.col("slot.e").alias("excerpt"), F.lit(snippet).alias("snippet"))


SVGS = "('a.svg', '<svg><!-- a --><![CDATA[<!-- b -->]]><g/></svg>'), ('b.svg', '<svg/>')"


def svg_files(spark, sf_dir):
    return results.svg_files(spark.sql(f"select * from values {SVGS} as t(file, text)"))


def named_hosts(spark, sf_dir):
    return results.named_hosts(table(spark, sf_dir, "pages").select(F.col("url").alias("html")))


def css_references(spark, sf_dir):
    css = "('a/b/c.css', 'p{background:url( \"../i.png\" )} @import \"/d.css\"; q{x:url(./e/../f.png?v=1)} r{y:url(data:1)}'), ('top.css', 'p{background:url(g.png)}')"
    return graph.css_refs(spark.sql(f"select * from values {css} as t(file, text)"))


def card_differences(spark, sf_dir):
    html = [f'<li class="post-{k}"><a href="/p{k}/">T{k}</a>{"<img src=x><b>i</b>" if k % 2 else ""}<span>by</span></li>' for k in range(4)]
    rows = spark.createDataFrame([("a", str(k), h) for k, h in enumerate(html)], "layout string, card string, html string")
    variable, optional = cards.differences(cards.walk_cards(rows))
    return variable.select("key", F.lit("variable").alias("what")).unionByName(optional.select("key", F.lit("optional").alias("what")))


# --- additions --------------------------------------------------------------


def hourly_events(spark, sf_dir):
    return event_counts(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        page_search, language_counts, host_counts, extension_counts, page_signals, page_links, page_edges, link_kinds, link_in_degree, dangling_links,
        normalized_urls, skipped_query_urls, robots_verdict, host_language_prefixes, noise_free_pages, reachable, page_text, rewritten_pages,
        ranked_search, phrase_search, document_frequency, rare_term, cover_terms, snippets, echo_split, majority_language,
        index_exclusion, sitemap_entries, redirect_rules, email_decode, b64_urls, mobile_verdicts, sitemap_walk, card_differences, hourly_events,
        signal_fixture, rewritten_downloads, image_sizes, origin_refs, unresolved_locs, css_references,
        wired_forms, card_pages, dead_card_links, slot_index, svg_files, named_hosts,
    )
}

_HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_KEY = rf"regexp_replace(lower({_HOST}), '^www\.', '')"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_FOLD = "replace(strip_accents(lower({0})), 'ß', 'ss')"
_LANG = "regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)"
_TITLE = "replace(replace(replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_LINKS = "SELECT url, unnest(regexp_extract_all(html, '<a\\b[^>]*?\\bhref=\"([^\"]*)\"', 1)) AS href FROM pages"
_TEXT = rf"""WITH a AS (SELECT url, {_TITLE} AS title, {_LANG} AS lang, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS t FROM pages),
        b AS (SELECT * REPLACE (regexp_replace(regexp_replace(t, '<(/h1|/p|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t) FROM a),
        c AS (SELECT * REPLACE (trim(regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS t) FROM b),
        texts AS (SELECT url, title, lang, rtrim(substr(t, 1, 2000)) AS text FROM c) """
_DYNAMIC = "(?i)" + "|".join(f"(?:{p})" for p in RULES.dynamic_paths)
_NOISE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?s)<!--.*?-->', '', 'g'),
  '(?i)(_wpnonce|nonce|csrf[\w-]*|token)(["'']?\s*[:=]\s*["''])[A-Za-z0-9+/=._-]{{6,}}(["''])', '\1\2\3', 'g'),
  '(?i)(name=["'']_wpnonce["'']\s+value=["''])[^"'']+', '\1', 'g'),
  '(?i)[?&](?:ver|v|t|cache|nocache)=[^\s"''&<>]+', '', 'g'), '\s+', ' ', 'g'))"""
_SEARCHED = f"""SELECT doc_id::VARCHAR AS path, {_FOLD.format("split_part(text, chr(10), 1)")} AS t, {_FOLD.format("text")} AS c FROM documents"""



def _cover_sql(rounds: int = 12) -> str:
    """The greedy cover, a round's best term and what it leaves open as two steps each."""
    out = [rf"""t0 AS MATERIALIZED (SELECT doc_id AS path, 0 AS pool, unnest(list_distinct(regexp_extract_all(lower(text), '\p{{L}}'))) AS term FROM documents
        UNION ALL SELECT path, 1, term FROM (SELECT doc_id AS path, unnest(list_distinct(regexp_extract_all({_FOLD.format("text")}, '\p{{L}}{{2,32}}'))) AS term FROM documents) WHERE length(term) BETWEEN 4 AND 24)"""]
    for k in range(1, rounds + 1):
        out.append(f"b{k} AS MATERIALIZED (SELECT {k} AS round, pool, term, count(*) AS n FROM t{k - 1} GROUP BY pool, term ORDER BY pool, n DESC, term LIMIT 1)")
        out.append(f"t{k} AS MATERIALIZED (SELECT * FROM t{k - 1} WHERE path NOT IN (SELECT path FROM t{k - 1} JOIN b{k} USING (pool, term)))")
    every = " UNION ALL ".join(f"SELECT * FROM b{k}" for k in range(1, rounds + 1))
    return "WITH " + ",\n        ".join(out) + f""", e AS ({every}), l AS (SELECT (SELECT count(DISTINCT doc_id) FROM documents) - (SELECT sum(n) FROM e) AS n)
        SELECT round::INT AS round, term, n::BIGINT AS covered FROM e UNION ALL SELECT NULL, NULL, n::BIGINT FROM l WHERE n > 0"""


SQL = {
    "cover_terms": _cover_sql(),
    "language_counts": f"SELECT lower(split_part(replace({_LANG}, '_', '-'), '-', 1)) AS \"primary\", count(*) AS n FROM pages WHERE {_LANG} <> '' GROUP BY 1",
    "host_counts": f"SELECT {_KEY} AS host, count(*) AS n FROM pages GROUP BY 1",
    "extension_counts": rf"SELECT lower(regexp_extract({_PATH}, '\.([^./]*)$', 1)) AS ext, count(*) AS n FROM pages GROUP BY 1",
    "page_signals": f"""SELECT url, {_TITLE} AS title, {_LANG} AS lang, {_TITLE} <> '' AS has_title, false AS has_description, false AS has_viewport,
        false AS noindex, '' AS canonical, '' AS artifact, false AS search_form FROM pages""",
    "page_links": _LINKS,
    "page_edges": rf"""SELECT DISTINCT url AS src, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/' || replace(url_encode(substr(href, 2)), '%2C', ',') || '/' AS dst
        FROM ({_LINKS}) WHERE href LIKE '/%'""",
    "link_kinds": f"SELECT 'relative' AS kind, count(*) AS n FROM ({_LINKS}) WHERE href LIKE '/%' AND href NOT LIKE '//%'",
    "link_in_degree": f"SELECT href, count(*) AS n_links, count(DISTINCT url) AS n_pages FROM ({_LINKS}) GROUP BY href",
    "dangling_links": rf"""WITH l AS ({_LINKS}), r AS (SELECT DISTINCT url AS file, href AS ref FROM l
          WHERE href LIKE '/%' AND href NOT LIKE '//%' AND NOT regexp_matches(href, '{_DYNAMIC}')),
        f AS (SELECT DISTINCT href AS ref FROM l WHERE length(href) <= 4)
        SELECT file, ref FROM r WHERE ref NOT IN (SELECT ref FROM f)""",
    "normalized_urls": rf"""SELECT url, CASE WHEN url NOT LIKE '%?%' AND NOT regexp_matches(CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END, '{_DYNAMIC}')
        THEN regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_HOST} || CASE WHEN {_PATH} = '' THEN '/' WHEN {_PATH} LIKE '%/' OR {_PATH} LIKE '%.html' THEN {_PATH} ELSE {_PATH} || '/' END
        END AS page FROM pages""",
    "skipped_query_urls": "SELECT DISTINCT regexp_replace(url, '#.*$', '') AS url FROM pages WHERE url LIKE '%?%'",
    "robots_verdict": rf"""WITH r(n, allow, rx) AS (VALUES (4, false, '^/en/'), (6, true, '^/en/.*5'), (8, false, '^/.*\.html$'), (4, true, '^/fr/'), (4, false, '^/fr/')),
        p AS (SELECT url, {_PATH} AS path FROM pages)
        SELECT url, coalesce(max(n) FILTER (WHERE NOT allow AND regexp_matches(path, rx)), -1) > coalesce(max(n) FILTER (WHERE allow AND regexp_matches(path, rx)), -1) AS denied
        FROM p, r GROUP BY url""",
    "host_language_prefixes": rf"""WITH p AS (SELECT {_KEY} AS host, lower(split_part({_LANG}, '-', 1)) AS lang, string_split(trim({_PATH}, '/'), '/') AS seg FROM pages WHERE {_LANG} <> ''),
        g AS (SELECT host, lang, count(DISTINCT coalesce(seg[1], '')) AS n1, min(seg[1]) AS s1, count(DISTINCT concat_ws('/', seg[1], coalesce(seg[2], ''))) AS n2, min(coalesce(seg[2], '')) AS s2 FROM p GROUP BY 1, 2),
        c AS (SELECT host, lang AS "primary", CASE WHEN n1 = 1 AND s1 <> '' AND regexp_full_match(s1, '(?i)[a-z]{{2,3}}(-[a-z0-9]{{2,8}})?') THEN '/' || s1 || '/'
              WHEN n2 = 1 AND s1 <> '' AND s2 <> '' AND regexp_full_match(s2, '(?i)[a-z]{{2,3}}(-[a-z0-9]{{2,8}})?') THEN '/' || s1 || '/' || s2 || '/'
              WHEN n1 = 1 AND s1 <> '' THEN '/' || s1 || '/' ELSE '/' END AS prefix FROM g),
        k AS (SELECT host FROM c GROUP BY host HAVING count(*) >= 2 AND count(DISTINCT prefix) = count(*))
        SELECT host, "primary", prefix FROM c WHERE host IN (SELECT host FROM k)""",
    "noise_free_pages": f"SELECT page_id, md5({_NOISE.format('html')}) AS digest FROM pages",
    "reachable": rf"""WITH RECURSIVE p AS (SELECT regexp_extract_all(html, '<a\b[^>]*?\bhref="([^"]*)"', 1) AS h FROM pages),
        i AS (SELECT h, unnest(range(1, len(h))) AS k FROM p), e AS (SELECT DISTINCT h[k] AS src, h[k + 1] AS dst FROM i),
        r(url) AS (SELECT DISTINCT src FROM e WHERE src IN ('/the', '/de') UNION SELECT dst FROM r JOIN e ON src = url)
        SELECT url FROM r""",
    "ranked_search": f"""WITH d AS ({_SEARCHED}) SELECT path, CASE WHEN contains(t, 'licensed under the') THEN 1 WHEN contains(t, 'licensed') AND contains(t, 'under') AND contains(t, 'the') THEN 2
        WHEN contains(t, 'licensed') OR contains(t, 'under') OR contains(t, 'the') THEN 3 WHEN contains(c, 'licensed under the') THEN 5 ELSE 6 END AS rank
        FROM d WHERE contains(c, 'licensed') AND contains(c, 'under') AND contains(c, 'the') ORDER BY rank, path LIMIT 50""",
    "phrase_search": f"""WITH d AS ({_SEARCHED}) SELECT path, CASE WHEN contains(t, 'licensed under the') THEN 1 ELSE 2 END AS rank
        FROM d WHERE contains(c, 'licensed under the') ORDER BY rank, path LIMIT 50""",
    "document_frequency": rf"""SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all({_FOLD.format("text")}, '\p{{L}}{{2,32}}'))) AS word FROM documents) GROUP BY word""",
    "rare_term": rf"""WITH f AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all({_FOLD.format("text")}, '\p{{L}}{{2,32}}'))) AS word FROM documents) GROUP BY word)
        SELECT word FROM f WHERE df = 1 AND length(word) >= 6
        ORDER BY CASE WHEN length(word) >= 8 AND regexp_full_match(word, '[\x00-\x7F]+') THEN 1 WHEN length(word) >= 8 THEN 2 ELSE 3 END, length(word) DESC, word LIMIT 1""",
    "snippets": """WITH d AS (SELECT doc_id, text, substr(text, 1, 120) AS h FROM documents),
        k AS (SELECT *, length(h) - strpos(reverse(h), ' ') AS pos, strpos(h, ' ') > 0 AS spaced FROM d)
        SELECT doc_id, CASE WHEN length(text) <= 120 THEN text WHEN spaced AND pos > 72 THEN substr(h, 1, pos) || '…' ELSE h || '…' END AS snippet FROM k""",
    "echo_split": """SELECT doc_id, length(text) - strpos(reverse(text), 'eht') - 2 AS before, strpos(reverse(text), 'eht') - 1 AS after FROM documents WHERE contains(text, 'the')""",
    "majority_language": "SELECT lang, count(*) AS n FROM documents WHERE lang <> '' GROUP BY lang ORDER BY n DESC, lang LIMIT 1",
    "index_exclusion": f"""WITH p({PAGE_COLUMNS}) AS (VALUES {PAGE_ROWS}),
        m AS (SELECT *, CASE WHEN regexp_matches(canonical, '^https://(www\\.)?site\\.test/') THEN
              coalesce(CASE WHEN canonical NOT LIKE '%?%' THEN rtrim(replace(canonical, '//www.', '//'), '/') || '/' END, '-') <> CASE WHEN save_url <> '' THEN save_url ELSE url END ELSE false END AS moved FROM p),
        k AS (SELECT *, CASE WHEN error <> '' OR content_type NOT LIKE '%html%' THEN 'not-a-page' WHEN is_stub THEN 'redirect-stub' WHEN artifact <> '' THEN artifact ELSE '' END AS a FROM m)
        SELECT url, CASE WHEN a <> '' THEN a WHEN source <> 'sitemap' THEN 'link-only' WHEN noindex THEN 'noindex' WHEN moved THEN 'canonical-mismatch' ELSE '' END AS sitemap,
        CASE WHEN a <> '' THEN a WHEN moved THEN 'canonical-mismatch' ELSE '' END AS search FROM k""",
    "sitemap_entries": f"""WITH p({PAGE_COLUMNS}) AS (VALUES {PAGE_ROWS}),
        k AS (SELECT *, CASE WHEN save_url <> '' THEN save_url ELSE url END AS target, coalesce(strftime(try_strptime(regexp_extract(last_modified, '^\\w{{3}},\\s*(.+) GMT$', 1), '%d %b %Y %H:%M:%S'), '%Y-%m-%d'), '') AS day FROM p
              WHERE error = '' AND content_type LIKE '%html%' AND NOT is_stub AND artifact = '' AND source = 'sitemap' AND NOT noindex),
        m AS (SELECT * FROM k WHERE NOT regexp_matches(canonical, '^https://(www\\.)?site\\.test/')
              OR coalesce(CASE WHEN canonical NOT LIKE '%?%' THEN rtrim(replace(canonical, '//www.', '//'), '/') || '/' END, '-') = target)
        SELECT target AS url, coalesce(arg_min(day, url) FILTER (WHERE day <> ''), '') AS lastmod FROM m GROUP BY target""",
    "redirect_rules": f"""WITH t(from_url, to_url, status) AS (VALUES {REDIRECTS}),
        u AS (SELECT to_url, regexp_extract(from_url, '^https://[^/]*([^?#]*)', 1) AS a, regexp_extract(to_url, '^https://[^/]*([^?#]*)', 1) AS b, regexp_extract(to_url, '(\\?[^#]+)', 1) AS q FROM t
              WHERE from_url NOT LIKE '%?%' AND regexp_matches(to_url, '^https://(site|alias)\\.test/'))
        SELECT a AS from_path, arg_min(b || q, to_url) AS to_ref FROM u
        WHERE rtrim(a, '/') <> rtrim(b, '/') AND NOT regexp_matches(a || b || q, '[\\s''"$\\\\{{}}]') GROUP BY a""",
    "email_decode": f"""WITH t(code) AS (VALUES {EMAILS}),
        b AS (SELECT code, CASE WHEN regexp_full_match(code, '(?:[0-9a-fA-F]{{2}}){{2,}}') THEN list_transform(range(0, (length(code) // 2)::INT), lambda i: ('0x' || substr(code, (2 * i + 1)::INT, 2))::INT) END AS x FROM t)
        SELECT code, CASE WHEN list_max(list_transform(x[2:], lambda v: xor(v, x[1]))) < 128 THEN array_to_string(list_transform(x[2:], lambda v: chr(xor(v, x[1])::INT)), '') END AS mail FROM b""",
    "b64_urls": f"""WITH t(value) AS (VALUES {B64}),
        d AS (SELECT value, CASE WHEN regexp_full_match(value, '[A-Za-z0-9+/_-]{{8,}}={{0,2}}') AND length(value) % 4 = 0 THEN decode(from_base64(translate(value, '-_', '+/'))) END AS url FROM t)
        SELECT value, CASE WHEN regexp_matches(url, '^(/|https?://)') THEN url END AS url FROM d""",
    "mobile_verdicts": f"""WITH t(url, desktop, mobile, mobile_ok, control) AS (VALUES {MOBILE}),
        n AS (SELECT url, mobile_ok, {_NOISE.format("desktop")} AS d, {_NOISE.format("mobile")} AS m, {_NOISE.format("control")} AS c FROM t)
        SELECT url, CASE WHEN NOT mobile_ok OR m IS NULL THEN 'check-failed' WHEN m = d THEN 'same' WHEN c IS NULL THEN 'check-failed' WHEN c <> d THEN 'dynamic' ELSE 'different' END AS verdict FROM n""",
    "sitemap_walk": f"""WITH RECURSIVE t(url, status, body) AS (VALUES {SITEMAPS}),
        d AS (SELECT url AS sitemap, regexp_matches(body, '^<(\\w+:)?sitemapindex') AS is_index,
              list_transform(regexp_extract_all(body, '<(?:\\w+:)?(?:url|sitemap)><(?:\\w+:)?loc>\\s*(?:<!\\[CDATA\\[)?([^<\\]]*)', 1), lambda x: trim(replace(x, '&amp;', '&'))) AS locs
              FROM t WHERE status = 200 AND regexp_matches(body, '</(\\w+:)?(sitemapindex|urlset)>$')),
        r(url, depth) AS (SELECT 'https://site.test/' || unnest(['index', 'gone', 'bad', 'absent']) || '.xml', 0
              UNION ALL SELECT l, depth + 1 FROM (SELECT unnest(locs) AS l, depth FROM r JOIN d ON d.sitemap = r.url WHERE is_index) WHERE regexp_matches(l, '^https://(www\\.)?site\\.test/')),
        f AS (SELECT unnest(locs) AS url, depth, d.sitemap, is_index FROM r JOIN d ON d.sitemap = r.url)
        SELECT url, depth, sitemap, CASE WHEN NOT regexp_matches(url, '^https://(www\\.)?site\\.test/') THEN CASE WHEN is_index THEN 'foreign-sitemap' ELSE 'foreign-page' END ELSE '' END AS note
        FROM f WHERE NOT is_index OR NOT regexp_matches(url, '^https://(www\\.)?site\\.test/')""",
    "signal_fixture": f"""WITH t(url, html) AS (VALUES {PAGES}),
        k AS (SELECT *, trim(regexp_extract(html, '<title>([^<]*)', 1)) AS title, trim(regexp_extract(html, '(?i)name="description" content="([^"]*)', 1)) AS d,
              regexp_extract(html, '<body class="([^"]*)', 1) AS c FROM t)
        SELECT url, title, regexp_extract(html, '<html lang="([^"]*)', 1) AS lang, title <> '' AS has_title, d <> '' AS has_description, html LIKE '%name="viewport" content="w"%' AS has_viewport,
        regexp_matches(html, '(?i)name="robots" content="[^"]*noindex') AS noindex, trim(regexp_extract(html, 'rel="canonical" href="([^"]*)', 1)) AS canonical,
        CASE WHEN url LIKE '%/phpthumb_cache%' THEN 'phpthumb-cache' WHEN c = 'attachment' THEN 'wp-attachment' WHEN c = 'archive' AND html LIKE '%class="no-results not-found"%' THEN 'empty-archive' ELSE '' END AS artifact,
        regexp_matches(html, '<form role="search"|<form><input name="[sq]"') AS search_form, regexp_matches(html, '<a href="(https://site\\.test)?/[^"]*[?&][sq]=') AS search_link FROM k""",
    "rewritten_downloads": f"""WITH t(url, html) AS (VALUES {LINKED}), m(endpoint, file_path) AS (VALUES {ENDPOINTS}),
        r AS (SELECT url, html, unnest(regexp_extract_all(html, '(?:href|src)="(/[^"]*)"', 1)) AS ref FROM t),
        k AS (SELECT r.*, file_path FROM r JOIN m ON rtrim(regexp_extract(ref, '^[^?#]*'), '/') = rtrim(endpoint, '/')),
        a AS (SELECT url, any_value(html) AS html, count(*) AS n, list(struct_pack(ref := ref, f := file_path)) AS c FROM k GROUP BY url)
        SELECT url, regexp_replace(list_reduce(list_prepend(html, list_transform(c, lambda x: x.ref || chr(1) || x.f)), lambda s, x: replace(s, '"' || split_part(x, chr(1), 1) || '"', '"' || split_part(x, chr(1), 2) || '"')),
               '(<img [^>]*[^/])>', '\\1/>', 'g') AS html, n FROM a""",
    "image_sizes": """SELECT url, '<img src="/a.png"/><img src="/i' || k || '.png?v=1" loading="lazy" decoding="async" width="' || (k + 10) || '" height="' || (k + 20) || '"/>' AS html
        FROM (SELECT url, min(page_id) % 7 AS k FROM pages GROUP BY url) WHERE k < 5""",
    "origin_refs": f"""WITH t(file, text) AS (VALUES {FILES}),
        a AS (SELECT file, unnest(regexp_extract_all(text, '<(a|link|img|script) [^>]*>')) AS e FROM t WHERE file LIKE '%.html'),
        b AS (SELECT file, e, unnest(regexp_extract_all(e, '(\\w+)="[^"]*(?:site|alias)\\.test', 1)) AS name FROM a WHERE NOT regexp_matches(e, 'rel="(canonical|alternate)"'))
        SELECT DISTINCT file, '<' || regexp_extract(e, '^<(\\w+)', 1) || ' ' || name || '=...>' AS place FROM b WHERE name NOT IN ('alt', 'title', 'placeholder')
        UNION ALL SELECT file, '<style> block' FROM t WHERE regexp_matches(text, '<style>[^<]*(site|alias)\\.test')
        UNION ALL SELECT file, regexp_extract(file, '[^.]*$') FROM t WHERE regexp_matches(file, '\\.(css|js)$') AND regexp_matches(text, '(site|alias)\\.test')""",
    "unresolved_locs": rf"""WITH p AS (SELECT DISTINCT CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS ref FROM pages),
        f AS (SELECT DISTINCT ltrim(trim({_PATH}, '/') || '/index.html') AS path FROM pages WHERE length({_PATH}) <= 7),
        c AS (SELECT ref, trim(ref, '/') AS bare, ref LIKE '%/' AS dir, regexp_matches(ref, '\.[^./]*$') AS ext FROM p)
        SELECT ref FROM c WHERE NOT CASE WHEN NOT dir AND ext THEN bare IN (SELECT path FROM f)
          WHEN dir THEN (CASE WHEN bare = '' THEN '' ELSE bare || '/' END || 'index.html') IN (SELECT path FROM f)
          ELSE bare IN (SELECT path FROM f) OR bare || '/index.html' IN (SELECT path FROM f) END""",
    "wired_forms": f"""WITH t(url, html) AS (VALUES {FORMS})
        SELECT url, (CASE WHEN html LIKE '%action="/s/"%' THEN 0 ELSE 1 END + CASE WHEN html ILIKE '%method="get"%' THEN 0 ELSE 1 END + CASE WHEN html LIKE '%<a href="">%' THEN 1 ELSE 0 END)::BIGINT AS n
        FROM t WHERE regexp_matches(html, '<form[^>]*role="search"|<input name="[sq]"') AND NOT (html LIKE '%action="/s/"%' AND html ILIKE '%method="get"%')""",
    "card_pages": f"""WITH l AS ({_LINKS}), i AS (SELECT DISTINCT href AS path FROM l WHERE length(href) <= 4 AND regexp_full_match(href, '/[a-z]+')),
        c AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), 'href="([^"]*)"', 1) AS h FROM pages),
        p AS (SELECT page_id, unnest(h) AS path, unnest(range(len(h))) AS pos FROM c)
        SELECT page_id::VARCHAR AS card, arg_min(path, pos) AS path FROM p JOIN i USING (path) GROUP BY page_id""",
    "dead_card_links": f"""WITH l AS ({_LINKS}), i AS (SELECT DISTINCT href AS path FROM l WHERE length(href) <= 4 AND regexp_full_match(href, '/[a-z]+')),
        p AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), 'href="([^"]*)"', 1)) AS path FROM pages)
        SELECT page_id::VARCHAR AS card, count(*) AS n FROM p WHERE path LIKE '/%' AND path NOT IN (SELECT path FROM i) GROUP BY page_id""",
    "slot_index": f"""WITH d(path, title) AS (VALUES ('/a/', 'A'), ('/b/', 'B'), ('/c/', 'C')), s(path, t, e) AS (VALUES {SLOTS})
        SELECT path, title, t AS slot_title, e AS excerpt, coalesce(greatest(180, least(600, max(length(nullif(e, ''))) OVER ())), 300)::INT AS snippet FROM d LEFT JOIN s USING (path)""",
    "svg_files": f"""WITH t(file, text) AS (VALUES {SVGS}), k AS (SELECT *, replace(text, '<!-- a -->', '') AS out FROM t)
        SELECT file, out AS text, (strlen(text) - strlen(out))::BIGINT AS saved FROM k""",
    "named_hosts": rf"""SELECT DISTINCT lower({_HOST}) AS host FROM pages WHERE regexp_matches(url, '^https?://[\w.-]+')""",
    "css_references": """SELECT * FROM (VALUES ('a/b/c.css', '/a/i.png'), ('a/b/c.css', '/d.css'), ('a/b/c.css', '/a/b/f.png?v=1'), ('top.css', '/g.png')) AS t(file, ref)""",
    "page_text": _TEXT + "SELECT url, text, false AS whole_body, '' AS date FROM texts",
    "page_search": _TEXT + f""", d AS (SELECT texts.url AS path, {_FOLD.format("title")} AS t, {_FOLD.format("text")} AS c FROM texts WHERE lang = 'en')
        SELECT path, CASE WHEN contains(t, 'the tion') THEN 1 WHEN contains(t, 'the') AND contains(t, 'tion') THEN 2 WHEN contains(t, 'the') OR contains(t, 'tion') THEN 3
        WHEN contains(c, 'the tion') THEN 5 ELSE 6 END AS rank FROM d WHERE (contains(t, 'the') OR contains(c, 'the')) AND (contains(t, 'tion') OR contains(c, 'tion'))
        ORDER BY rank, path LIMIT 50""",
    "hourly_events": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "card_differences": "SELECT * FROM (VALUES ('li@class', 'variable'), ('li/a0#0', 'variable'), ('li/a0@href', 'variable'), ('li/img0', 'optional'), ('li/b0', 'optional')) AS t(key, what)",
}
