"""One site from captured responses to an index, a sitemap and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import classify
from weftline.operators.pages import parse_pages
from weftline.operators.search import search_docs, search_fields
from weftline.plans.crawl import crawl, written
from weftline.rules import Site
from weftline.sources.responses import body_text, outcomes
from weftline.sources.sitemaps import sitemap_entries


def site_tables(responses: DataFrame, seeds: DataFrame, site: Site) -> dict[str, DataFrame]:
    """parsed, pages (reached from the seeds), meta, sitemap, index (with folded fields) and report."""
    fetched = written(outcomes(responses, site))
    html = body_text(responses.select("url", "headers", "body")).select("url", F.col("text").alias("html"))
    parsed = written(parse_pages(html.join(fetched.where("is_html and error = ''").select("url"), "url", "left_semi"), site))
    edges = parsed.select(F.col("url").alias("src"), F.inline("links")).where("kind = 'page'").select("src", "dst").distinct()
    pages = crawl(edges, seeds)
    p = parsed.drop("error", "links").withColumnRenamed("url", "p_url")
    f = fetched.withColumnRenamed("url", "f_url")
    meta = pages.join(f, pages["url"] == f["f_url"]).join(p, pages["url"] == p["p_url"], "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    flag = lambda c: F.coalesce(c, F.lit(False))
    meta = meta.select(
        "url", "status", "final_url", text("error").alias("error"), text("title").alias("title"), *(flag(c).alias(c) for c in ("has_title", "has_description", "has_viewport", "noindex")),
        text("canonical").alias("canonical"), "content_type", "source", F.lit("").alias("mobile"), "last_modified", text("lang").alias("lang"), "alternates",
        F.lit("").alias("save_url"), F.lit(False).alias("is_stub"), text("artifact").alias("artifact"),
    )
    meta = written(meta)
    index = search_docs(meta.withColumn("exclusion", classify.index_exclusion(site, "search")), parsed)
    listed = meta.withColumn("exclusion", classify.index_exclusion(site)).withColumn("alternates", F.coalesce("alternates", F.create_map().cast("map<string,string>")))
    return {"parsed": parsed, "pages": pages, "meta": meta, "sitemap": sitemap_entries(listed), "index": search_fields(index), "report": classify.report(meta, site)}
