"""Which pages count: exclusion reasons, languages, site-wide names, templates of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.urls import host_key, page_url, url_host, url_path, url_query
from weftline.rules import Rules, Site, load_rules

META = (
    "url string, status int, final_url string, error string, title string, has_title boolean, has_description boolean, has_viewport boolean, "
    "noindex boolean, canonical string, content_type string, source string, mobile string, last_modified string, lang string, "
    "alternates map<string,string>, save_url string, is_stub boolean, artifact string"
)


def saved(meta_url: str = "url") -> Column:
    return F.when(F.col("save_url") != "", F.col("save_url")).otherwise(F.col(meta_url))


def canonical_mismatch(site: Site) -> Column:
    """A canonical of the own site that isn't the page itself; one with a query never is."""
    own = [h.lower().removeprefix("www.") for h in (site.base.split("://")[1], *site.own_hosts)]
    canonical = F.col("canonical")
    internal = canonical.rlike("^https?://") & host_key(F.regexp_replace(url_host(canonical), ":(80|443)$", "")).isin(own)
    target = F.when(url_query(canonical) == "", page_url(F.concat(F.lit(site.base), url_path(canonical)), site.rules))
    return internal & ~target.eqNullSafe(saved())


def index_exclusion(site: Site, scope: str = "sitemap") -> Column:
    """Why a page isn't listed, empty if it is; `scope` search ignores what only concerns search engines."""
    out = F.when((F.col("error") != "") | ~F.col("content_type").contains("html"), "not-a-page").when(F.col("is_stub"), "redirect-stub").when(F.col("artifact") != "", F.col("artifact"))
    if scope != "search":
        if site.sitemap_found and not site.include_linked:
            out = out.when(F.col("source") != "sitemap", "link-only")
        out = out.when(F.col("noindex"), "noindex")
    return out.when(canonical_mismatch(site), "canonical-mismatch").otherwise("")


def primary_language(lang: Column) -> Column:
    return F.lower(F.split_part(F.replace(lang, F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1)))


def _speaking(meta: DataFrame) -> DataFrame:
    return meta.where("error = '' and not is_stub and lang <> ''").withColumn("primary", primary_language(F.col("lang"))).where("primary <> ''")


def language_counts(meta: DataFrame) -> DataFrame:
    """(primary, n), most frequent first."""
    return _speaking(meta).groupBy("primary").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "primary")


def language_prefixes(meta: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(primary, prefix) of a site with one language per path; empty if it isn't laid out like that.

    `by` computes it for many sites at once. A language whose pages share their
    first segment, or their first two ending in a language code, has that prefix;
    any other has the root.
    """
    rows = _speaking(meta).withColumn("seg", F.split(F.trim(url_path(saved()), F.lit("/")), "/"))
    one, two = F.get("seg", F.lit(0)), F.get("seg", F.lit(1))
    code = "(?i)^[a-z]{2,3}(-[a-z0-9]{2,8})?$"
    g = rows.groupBy(*by, "primary").agg(
        F.count_distinct(F.coalesce(one, F.lit(""))).alias("n1"), F.min(F.coalesce(one, F.lit(""))).alias("s1"),
        F.count_distinct(F.concat_ws("/", one, F.coalesce(two, F.lit("")))).alias("n2"), F.min(F.coalesce(two, F.lit(""))).alias("s2"),
    )
    shared1, shared2 = (F.col("n1") == 1) & (F.col("s1") != ""), (F.col("n2") == 1) & (F.col("s1") != "") & (F.col("s2") != "")
    first = F.concat(F.lit("/"), F.col("s1"), F.lit("/"))
    prefix = F.when(shared1 & F.col("s1").rlike(code), first).when(shared2 & F.col("s2").rlike(code), F.concat(first, F.col("s2"), F.lit("/"))).when(shared1, first).otherwise("/")
    g = g.select(*by, "primary", prefix.alias("prefix"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # one row a language
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    g = g.withColumn("n", F.count("*").over(whole)).withColumn("kinds", F.size(F.collect_set("prefix").over(whole)))
    return g.where("n >= 2 and kinds = n").select(*by, "primary", "prefix")


def page_language_settings(pages: DataFrame, settings: DataFrame, default: str) -> DataFrame:
    """`pages` with `setting`: that of the whole tag, else of the primary language, else the default."""
    tag = F.lower(F.replace("lang", F.lit("_"), F.lit("-")))
    a, b = (settings.select(F.col("key").alias(f"k{k}"), F.col("setting").alias(f"s{k}")) for k in (1, 2))
    out = pages.join(F.broadcast(a), tag == F.col("k1"), "left").join(F.broadcast(b), primary_language(F.col("lang")) == F.col("k2"), "left")
    return out.withColumn("setting", F.coalesce("s1", "s2", F.lit(default))).drop("k1", "s1", "k2", "s2")


def by_prefix(pages: DataFrame, prefixes: DataFrame) -> DataFrame:
    """`pages` with `primary` of the longest prefix of their path. Prefixes are one a language, so they become one expression."""
    listed = sorted(((r.prefix, r.primary) for r in prefixes.select("prefix", "primary").collect()), key=lambda x: (-len(x[0]), x))
    out = F.lit(None).cast("string")
    for prefix, primary in reversed(listed):
        out = F.when(url_path(F.col("url")).startswith(prefix), F.lit(primary)).otherwise(out)
    return pages.withColumn("primary", out)


def majority(rows: DataFrame, value: str, prefer: str | None = None) -> DataFrame:
    """(value, n): the most frequent non-empty value; ties go to `prefer`, then to the smallest."""
    counts = rows.where(F.col(value) != "").groupBy(value).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.col(value) != F.lit(prefer or ""), value).limit(1)


def report(meta: DataFrame, site: Site) -> DataFrame:
    """One row: counts and sorted lists of what needs attention."""
    ok = F.col("error") == ""
    page = ok & F.col("content_type").contains("html") & ~F.col("is_stub")
    urls = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("url"))))
    return meta.agg(
        F.count_if(ok).alias("pages_ok"), F.count_if(~ok).alias("pages_failed"), urls(page & ~F.col("has_title")).alias("without_title"),
        urls(page & ~F.col("has_description")).alias("without_description"), urls(page & ~F.col("has_viewport")).alias("without_viewport"),
        urls(ok & F.col("noindex")).alias("noindex"), urls(ok & canonical_mismatch(site)).alias("canonical_mismatch"),
        F.count_if(ok & (F.col("source") == "link")).alias("link_only"),
    )


def exit_code(failed: int, missing: int, strict: bool) -> int:
    """0 clean, 1 findings under a strict policy, 2 nothing exported is left to the caller."""
    return int(strict and bool(failed or missing))


def mobile_verdict(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """`pages` (url, desktop, mobile, mobile_ok, control) with `verdict`; bodies are compared without noise, that of the vendor profiles included."""
    from weftline.operators.pages import noise_free

    bare = lambda name: noise_free(F.col(name), (rules or load_rules()).noise_patterns)
    same = bare("mobile") == bare("desktop")
    moving = F.col("control").isNotNull() & (bare("control") != bare("desktop"))
    verdict = F.when(~F.col("mobile_ok") | F.col("mobile").isNull(), "check-failed").when(same, "same").when(F.col("control").isNull(), "check-failed").when(moving, "dynamic").otherwise("different")
    return pages.withColumn("verdict", verdict)
