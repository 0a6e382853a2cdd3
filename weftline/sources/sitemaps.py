"""Sitemaps as sources and as output.

`walk` follows sitemap indexes over a table of captured responses: one join a
level, bounded in depth and files; what a bound or a foreign host leaves out is
noted, not dropped in silence. Namespaces don't matter: elements are found by
their local names, a loc as a direct child of its entry.
"""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from weftline.functions.urls import host_key, iso_date, url_host, url_path

WELL_KNOWN = ("/wp-sitemap.xml", "/sitemap_index.xml", "/sitemap.xml")
MAX_DEPTH, MAX_FILES = 5, 200


def candidates(base: str, declared: list[str], extras: tuple[str, ...] = ()) -> list[str]:
    """Declared ones, then the well-known places, then extras; in order, without repeats."""
    return list(dict.fromkeys([*declared, *(base.rstrip("/") + p for p in WELL_KNOWN), *extras]))


DOCUMENT = StructType([StructField("kind", StringType()), StructField("locs", ArrayType(StringType())), StructField("alternates", ArrayType(StringType()))])


def read_sitemap(body: str | None) -> tuple[str, list[str], list[str]]:
    """(kind, locs, alternates) of a sitemap document; the kind is index, urlset or bad."""
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    try:
        root = ElementTree.fromstring((body or "").lstrip("\ufeff \t\r\n").encode())
    except ElementTree.ParseError:
        return "bad", [], []
    kind = {"sitemapindex": "index", "urlset": "urlset"}.get(local(root), "bad")
    entries = list(root) if kind != "bad" else []
    first = (next((c.text or "" for c in e if local(c) == "loc"), "").strip() for e in entries)
    links = (c.get("href", "").strip() for e in entries for c in e if local(c) == "link")
    return kind, [x for x in first if x], [x for x in links if x]


@F.pandas_udf(DOCUMENT)
def sitemap_document(body: pd.Series) -> pd.DataFrame:
    """`read_sitemap` as a column."""
    return pd.DataFrame([read_sitemap(b) for b in body], columns=["kind", "locs", "alternates"])


def walk(responses: DataFrame, roots: list[str], own_hosts: tuple[str, ...], max_depth: int = MAX_DEPTH, max_files: int = MAX_FILES) -> DataFrame:
    """(url, depth, sitemap, note): the pages that the sitemaps list, with an empty note, and what was left out.

    Notes: `foreign-page` and `foreign-sitemap` of other hosts, `cap` of sitemaps
    beyond `max_depth` levels or `max_files` files, taken level by level and in
    order of their URLs. `responses` has url, status and body (string). Only
    names of sitemaps reach the driver, `max_files` and one more a level at most.
    """
    spark = responses.sparkSession
    own = host_key(url_host(F.col("url"))).isin([h.lower().removeprefix("www.") for h in own_hosts])
    docs = responses.where("status = 200").select(F.col("url").alias("sitemap"), sitemap_document("body").alias("d")).select("sitemap", "d.kind", "d.locs")
    row = lambda d, note: d.select("url", F.lit(depth).alias("depth"), "sitemap", note.alias("note"))
    out = spark.createDataFrame([], "url string, depth int, sitemap string, note string")
    level, seen = spark.createDataFrame([(u, "") for u in dict.fromkeys(roots)], "url string, sitemap string"), []
    for depth in range(max_depth + 2):
        fresh = level.where(own).where(~F.col("url").isin(seen) if seen else F.lit(True))
        room = max_files - len(seen) if depth <= max_depth else 0
        names = [r.url for r in fresh.select("url").distinct().orderBy("url").limit(room + 1).collect()]
        if len(names) > room:
            out = out.unionByName(row(fresh.where(~F.col("url").isin(names[:room]) if room else F.lit(True)).dropDuplicates(["url"]), F.lit("cap")))
        names = names[:room]
        if not names:
            break
        seen += names
        here = docs.where(F.col("sitemap").isin(names))
        pages = here.where("kind = 'urlset'").select("sitemap", F.explode("locs").alias("url"))
        level = here.where("kind = 'index'").select("sitemap", F.explode("locs").alias("url"))
        out = out.unionByName(row(pages, F.when(own, "").otherwise("foreign-page"))).unionByName(row(level.where(~own), F.lit("foreign-sitemap")))
    return out


def unresolved_locs(sitemap: DataFrame, files: DataFrame) -> DataFrame:
    """(ref): paths of locs and alternates of generated sitemaps (`body`) that no file of the tree answers."""
    from weftline.operators.graph import unanswered

    d = sitemap_document("body")
    refs = sitemap.select(F.explode(F.concat(d["locs"], d["alternates"])).alias("loc"))
    path = F.when(url_path(F.col("loc")) == "", "/").otherwise(url_path(F.col("loc")))
    return unanswered(refs.select(path.alias("ref")).distinct(), files)


def sitemap_entries(meta: DataFrame) -> DataFrame:
    """(url, lastmod, alternates) of the generated sitemap, from classified pages (`exclusion` as of the sitemap scope).

    Several sources may save to one URL: the first non-empty date by source URL
    stays, of equal language tags the last, and alternates must be listed.
    """
    rows = meta.where("exclusion = ''").select(F.when(F.col("save_url") != "", F.col("save_url")).otherwise(F.col("url")).alias("target"), F.col("url").alias("source"), iso_date(F.col("last_modified")).alias("day"), "alternates")
    entries = rows.groupBy("target").agg(F.coalesce(F.min_by("day", F.when(F.col("day") != "", F.col("source"))), F.lit("")).alias("lastmod"))
    pairs = rows.select("target", "source", F.explode("alternates").alias("tag", "alt")).groupBy("target", "tag").agg(F.max_by("alt", "source").alias("alt"))
    listed = pairs.join(entries.select(F.col("target").alias("alt")), "alt", "left_semi")
    alts = listed.groupBy("target").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag", "alt")))).alias("alternates"))
    return entries.join(alts, "target", "left").select(F.col("target").alias("url"), "lastmod", F.coalesce("alternates", F.create_map().cast("map<string,string>")).alias("alternates"))


def exclusion_counts(meta: DataFrame) -> DataFrame:
    moved = (F.col("save_url") != "") & (F.col("save_url") != F.col("url"))
    reason = F.col("exclusion")
    others = ("", "noindex", "canonical-mismatch")
    return meta.agg(
        F.count_if(reason == "noindex").alias("noindex"),
        F.count_if(reason == "canonical-mismatch").alias("canonical_mismatch"),
        F.count_if(reason == "link-only").alias("link_discovered"),
        F.count_if(~reason.isin(*others, "link-only", "redirect-stub", "not-a-page")).alias("artifacts"),
        F.count_if((reason == "redirect-stub") | (moved & reason.isin(*others))).alias("redirected"),
    )


def _xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def sitemap_xml(entries: DataFrame, prefix: str) -> DataFrame:
    """(url, xml): the element of each entry. Sorted by url and between a urlset's tags, these are the file."""
    loc = lambda c: _xml(F.concat(F.lit(prefix), url_path(c)))
    quoted = lambda c: F.replace(_xml(c), F.lit('"'), F.lit("&quot;"))
    alts = F.transform(F.map_entries("alternates"), lambda e: F.concat(F.lit('    <xhtml:link rel="alternate" hreflang="'), quoted(e["key"]), F.lit('" href="'), quoted(F.concat(F.lit(prefix), url_path(e["value"]))), F.lit('"/>\n')))
    day = F.when(F.col("lastmod") != "", F.concat(F.lit("    <lastmod>"), F.col("lastmod"), F.lit("</lastmod>\n"))).otherwise(F.lit(""))
    return entries.select("url", F.concat(F.lit("  <url>\n    <loc>"), loc(F.col("url")), F.lit("</loc>\n"), F.array_join(alts, ""), day, F.lit("  </url>")).alias("xml"))


def retargeted(body: Column, base: str, target: str) -> Column:
    """An origin sitemap whose URLs point at another host."""
    return F.regexp_replace(body, rf"(?i)https?://(?:www\.)?\Q{base}\E(?=[/<\"'\s])", target.replace("$", "\\$"))
