"""Smaller checks over captured tables: soft 404s, warnings, collisions, probes of another search, variants."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.urls import host_key, url_host, url_path


def soft_404(probes: DataFrame) -> DataFrame:
    """(prefix, verdict) of captured nonsense URLs (prefix, status, html): themed, soft-404 (answered with 200) or missing."""
    verdict = F.when(F.col("status") == 200, "soft-404").when((F.col("status") == 404) & F.coalesce(F.col("html").rlike("(?i)<html"), F.lit(False)), "themed").otherwise("missing")
    return probes.select("prefix", verdict.alias("verdict"))


def warnings(outcomes: DataFrame, folded: DataFrame, least: int = 5) -> DataFrame:
    """(kind, detail): pages that the origin negotiates by request, and own hosts that many links name besides the base host."""
    negotiated = outcomes.where("negotiated and error = ''").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("negotiated-variants").alias("kind"), F.concat(F.col("n").cast("string"), F.lit(" pages")).alias("detail"))
    hosts = folded.where(F.col("n") >= least).select(F.lit("folded-host").alias("kind"), F.concat_ws(": ", "host", F.col("n").cast("string")).alias("detail"))
    return negotiated.unionByName(hosts)


def collision(files: DataFrame, path: str) -> DataFrame:
    """(path): files of the tree that a generated page at `path` would overwrite."""
    bare = path.strip("/")
    return files.where(F.col("path").isin(bare, f"{bare}/index.html")).select("path")


def search_path_error(path: str) -> str:
    """Why a search path can't be used, empty if it can."""
    parts = path.strip("/").split("/")
    if not path.startswith("/") or not path.endswith("/"):
        return "must begin and end with a slash"
    if path == "/":
        return "must not be the homepage"
    if "//" in path or any(p in (".", "..") for p in parts):
        return "must be a plain path"
    if not re.fullmatch(r"/[A-Za-z0-9._~/-]+/", path):
        return "must consist of unreserved characters"
    if parts[0] in ("wp-admin", "wp-content", "wp-includes", "wp-json") or parts[-1].endswith((".html", ".php")):
        return "must not be a reserved place"
    return ""


def offers_search(parsed: DataFrame, forced: bool = False) -> DataFrame:
    """One row: whether any page has a search form or links to a search."""
    return parsed.agg((F.coalesce(F.bool_or(F.col("search_form") | F.col("search_link")), F.lit(False)) | F.lit(forced)).alias("offers_search"))


def echoes(html: Column, term: str) -> Column:
    """Whether a results page names the term in its title, headline or breadcrumb."""
    parts = F.concat_ws(" ", F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1), F.regexp_extract(html, r'(?is)<[^>]*class="[^"]*breadcrumb[^"]*"[^>]*>(.*?)</(?:nav|div|ul|ol)>', 1))
    return F.contains(F.lower(parts), F.lit(term.lower()))


def next_probe(links: DataFrame, term: str, seen: tuple[str, ...] = ()) -> DataFrame:
    """(url): the next results page of the same term; a link marked as next comes before others."""
    rows = links.where(F.col("url").rlike(rf"[?&](s|q)=\Q{term}\E(&|$)") & ~F.col("url").isin(*seen) if seen else F.col("url").rlike(rf"[?&](s|q)=\Q{term}\E(&|$)"))
    marked = F.array_contains(F.split(F.lower(F.coalesce("rel", F.lit(""))), r"\s+"), "next") | F.lower(F.coalesce("class", F.lit(""))).rlike(r"(^|\s)next(\s|$)")
    return rows.orderBy(F.when(marked, 0).otherwise(1), "pos").limit(1).select("url")


def mobile_variants(verdicts: DataFrame) -> DataFrame:
    """(url, html) of the pages whose mobile form is worth keeping beside the desktop one."""
    return verdicts.where("verdict = 'different'").select("url", F.col("mobile").alias("html"))


def foreign_site_hosts(edges: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """(host, n): foreign hosts that serve the site's own kind of paths; likely the same site under another name."""
    dst = F.col("dst")
    rows = edges.where((F.col("kind") == "external") & url_path(dst).rlike("(?i)^/wp-(content|includes)/"))
    return rows.where(~host_key(url_host(dst)).isin(*own)).groupBy(host_key(url_host(dst)).alias("host")).agg(F.count("*").alias("n"))


def private_hosts(hosts: DataFrame, addresses: DataFrame) -> DataFrame:
    """(host) of `hosts` whose supplied addresses are all private and none a sinkhole's."""
    private = F.col("address").rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|169\.254\.|f[cd][0-9a-f]{2}:|fe80:)")
    known = addresses.groupBy("host").agg(F.bool_and(private).alias("private")).where("private").select("host")
    return hosts.join(known, "host", "left_semi")


def report_text(report: dict) -> str:
    """The report as text: counts first, then each list that isn't empty."""
    head = [f"{k.replace('_', ' ')}: {v}" for k, v in report.items() if not isinstance(v, list)]
    lists = [f"{k.replace('_', ' ')} ({len(v)}):\n" + "\n".join(f"  - {x}" for x in v) if v else f"{k.replace('_', ' ')}: none" for k, v in report.items() if isinstance(v, list)]
    return "\n".join(head) + "\n\n" + "\n\n".join(lists) + "\n"
