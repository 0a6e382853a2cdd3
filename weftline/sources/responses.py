"""Captured responses: fetch outcomes, redirects, downloads, first-write-wins storage.

A live crawl needs a global request rate and tasks that never repeat, which
Spark doesn't give; the engine works over a captured table instead:
`responses(url, status, headers map, body, history array<struct<url,status>>)`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.functions import urls as U
from weftline.rules import Site

SCHEMA = "url string, status int, headers map<string,string>, body binary, final_url string, history array<struct<url:string,status:int>>"


def header(name: str) -> Column:
    """A header by name in any case, empty if it isn't there."""
    return F.coalesce(F.get(F.map_values(F.map_filter("headers", lambda k, v: F.lower(k) == name.lower())), F.lit(0)), F.lit(""))


def body_text(responses: DataFrame) -> DataFrame:
    """`responses` with `text`: the body by declared charset, @charset rule, or UTF-8."""

    def run(bodies, kinds):
        return bodies.combine(kinds, lambda b, k: None if b is None else U.decode_body(bytes(b), k))

    decode = F.pandas_udf(run, StringType())
    return responses.withColumn("text", decode("body", header("content-type")))


def outcomes(responses: DataFrame, site: Site) -> DataFrame:
    """(url, status, final_url, content_type, last_modified, is_html, error, negotiated): what became of each fetch."""
    u = U.Urls(site)
    own = U.host_key(U.url_host(F.col("final_url"))).isin(sorted(u.own))
    kind = F.lower(F.trim(F.substring_index(header("content-type"), ";", 1)))
    vary = F.lower(header("vary"))
    error = (
        F.when(~own, F.concat(F.lit("redirected off-site to "), F.col("final_url")))
        .when(F.col("status").between(300, 399), F.lit("redirect loop or too many redirects"))
        .when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .otherwise(F.lit(""))
    )
    return responses.select(
        "url",
        "status",
        "final_url",
        kind.alias("content_type"),
        header("last-modified").alias("last_modified"),
        kind.contains("html").alias("is_html"),
        error.alias("error"),
        (vary.contains("accept-language") | vary.contains("cookie")).alias("negotiated"),
        vary.contains("user-agent").alias("varies_by_agent"),
    )


def asset_errors(responses: DataFrame) -> DataFrame:
    """(url, error) of assets that failed or that were answered with a page."""
    kind = F.lower(header("content-type"))
    asset = ~U.extension(U.url_path(F.col("url"))).isin("", "html", "htm", "php")
    error = F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string"))).when(kind.contains("text/html"), F.lit("got text/html for an asset"))
    return responses.where(asset).select("url", error.alias("error")).where("error is not null")


def redirects(responses: DataFrame) -> DataFrame:
    """(from_url, to_url, status): each hop of the histories, once; of repeats the last status stays."""
    hops = F.zip_with("history", F.concat(F.slice(F.transform("history", lambda h: h["url"]), 2, F.size("history")), F.array("final_url")), lambda h, to: F.struct(h["url"].alias("from_url"), to.alias("to_url"), h["status"].alias("status")))
    rows = responses.where(F.size("history") > 0).select(F.posexplode(hops).alias("pos", "hop")).select("pos", "hop.*")
    return rows.groupBy("from_url", "to_url").agg(F.max_by("status", "pos").alias("status"))


def redirect_rules(hops: DataFrame, site: Site) -> DataFrame:
    """(from_path, to_ref): rules that a server may apply; the first target by URL stays for each path."""
    u = U.Urls(site)
    path = lambda c: F.when(U.url_path(c) == "", F.lit("/")).otherwise(U.url_path(c))
    a, b = path(F.col("from_url")), path(F.col("to_url"))
    query = U.url_query(F.col("to_url"))
    rows = hops.where(U.host_key(U.url_host(F.col("to_url"))).isin(sorted(u.own)) & (U.url_query(F.col("from_url")) == ""))
    rows = rows.select("to_url", a.alias("a"), b.alias("b"), decoded_path(a).alias("from_path"), F.concat(U.canonical_path(b), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))).alias("to_ref"))
    rows = rows.where("not (b = a or b = concat(a, '/') or a = concat(b, '/'))").where(U.redirect_safe(F.col("from_path")) & U.redirect_safe(F.col("to_ref")))
    return rows.groupBy("from_path").agg(F.min_by("to_ref", "to_url").alias("to_ref"))


@F.pandas_udf(StringType())
def decoded_path(path):
    import unicodedata
    from urllib.parse import unquote

    return path.map(lambda p: unicodedata.normalize("NFC", unquote(p)) if isinstance(p, str) else None)


def stub_page(target: Column) -> Column:
    """A page that only leads on."""
    safe = F.replace(F.replace(F.replace(target, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
    return F.format_string('<!DOCTYPE html><html><head><meta charset="utf-8"><meta name="robots" content="noindex"><meta http-equiv="refresh" content="0; url=%s"></head><body></body></html>', safe)


def local_paths(rows: DataFrame, is_page: bool, url: str = "url") -> DataFrame:
    """`rows` with `rel_path`; null where the URL leaves the tree."""
    to = F.pandas_udf(lambda s: s.map(lambda x: U.local_path(x, is_page) if isinstance(x, str) else None), StringType())
    return rows.withColumn("rel_path", to(url))


def first_writes(files: DataFrame) -> DataFrame:
    """Of several sources of one path the first by (round, url) is written."""
    w = Window.partitionBy("rel_path").orderBy("round", "url")
    return files.where("rel_path is not null").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def downloads(responses: DataFrame, site: Site) -> DataFrame:
    """(endpoint, file_path) of files that extensionless endpoints serve."""
    name = F.pandas_udf(lambda d, k, p: d.to_frame("d").assign(k=k, p=p).apply(lambda r: U.attachment_filename(r.d, r.k, r.p), axis=1) if len(d) else d, StringType())
    path = U.url_path(F.col("url"))
    kind = F.lower(header("content-type"))
    rows = responses.where((U.extension(path) == "") & (F.col("status") == 200) & ~kind.rlike("html|css|javascript") & (kind != ""))
    rows = rows.select(path.alias("endpoint"), name(header("content-disposition"), header("content-type"), path).alias("name"))
    return rows.select("endpoint", F.concat(F.regexp_replace("endpoint", "/+$", ""), F.lit("/"), F.col("name")).alias("file_path"))


def download_rules(found: DataFrame, claimed: DataFrame) -> DataFrame:
    """(from_path, to_ref) with and without a slash at the end, but for paths that another rule claims."""
    bare = F.regexp_replace("endpoint", "/+$", "")
    both = found.select(F.explode(F.array(bare, F.concat(bare, F.lit("/")))).alias("from_path"), F.col("file_path").alias("to_ref"))
    return both.join(claimed.select("from_path"), "from_path", "left_anti").where(U.redirect_safe(F.col("from_path")) & U.redirect_safe(F.col("to_ref")))


def decomposed_url(url: str) -> str | None:
    """The same URL with its path in decomposed spelling, None where that is the same."""
    import unicodedata
    from urllib.parse import quote, unquote, urlsplit, urlunsplit

    parts = urlsplit(url)
    path = quote(unicodedata.normalize("NFD", unquote(parts.path)), safe="/")
    return None if path == parts.path else urlunsplit((parts.scheme, parts.netloc, path, "", ""))


def with_retries(responses: DataFrame) -> DataFrame:
    """`responses` in which a 404 takes the good answer of its decomposed spelling, if that was captured; the URL stays."""
    other = F.pandas_udf(lambda s: s.map(lambda x: decomposed_url(x) if isinstance(x, str) else None), StringType())
    names = [c for c in responses.columns if c != "url"]
    missed = F.when(F.col("status") == 404, other(F.when((F.col("status") == 404) & F.col("url").rlike(r"%|[^\x00-\x7F]"), F.col("url"))))
    good = responses.where(F.col("status") < 400).select(F.col("url").alias("__retry"), F.struct(*names).alias("__good"))
    rows = responses.withColumn("__retry", missed).join(good, "__retry", "left")
    return rows.select("url", *(F.when(F.col("__good").isNotNull(), F.col("__good")[c]).otherwise(F.col(c)).alias(c) for c in names))
