"""What a static results page and the last pass over an exported tree need, as joins and row changes.

Fragments and pages change row by row in Arrow batches; which links are dead,
which page a card is about and which slide has layers are joins.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions import rewrite
from weftline.functions.urls import Urls, canon_path
from weftline.operators.graph import ABSOLUTE, unanswered
from weftline.rules import Site

#: Characters of a snippet: the longest excerpt, within these bounds, or the usual number without any.
SNIPPET = (180, 600, 300)


def _changed(rows: DataFrame, change, key: str = "url", more: tuple[str, ...] = ()) -> DataFrame:
    """(key, html, n) of rows (key, html, more) that `change(html, row)` = (html, n) changes."""
    schema = pa.schema([(key, pa.string()), ("html", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                html, n = change(r["html"] or "", r)
                if n:
                    out.append({key: r[key], "html": html, "n": n})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.select(key, "html", *more).mapInArrow(run, f"{key} string, html string, n long")


# --- the tree and its files -------------------------------------------------


def output_tree(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("html", "css", "js")) -> DataFrame:
    """(file, text) of the text files below a folder, named by their path in it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(kinds) + "}").load(folder)
    root = folder.split("://")[-1].rstrip("/") + "/"
    return files.select(F.substring_index("path", root, -1).alias("file"), F.decode("content", "utf-8").alias("text"))


def raw_files(responses: DataFrame) -> DataFrame:
    """(url, body) of good answers of page URLs that aren't pages: they are written as they came."""
    from weftline.sources.responses import header

    kind = F.lower(F.coalesce(header("content-type"), F.lit("")))
    return responses.where((F.col("status") < 400) & ~kind.contains("html")).select("url", "body")


def text_assets(files: DataFrame, site: Site) -> DataFrame:
    """(url, text, links) of JSON and manifest files (url, text): own URLs made root-relative, and listed as (kind, url)."""
    schema = pa.schema([("url", pa.string()), ("text", pa.string()), ("links", pa.list_(pa.struct([("kind", pa.string()), ("url", pa.string())])))])

    def run(batches):
        u = Urls(site)
        for batch in batches:
            rows = [{"url": r["url"], "text": u.rehost(r["text"] or ""), "links": [{"kind": k, "url": x} for k, x in u.swept(r["text"] or "")]} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("url", "text").mapInArrow(run, "url string, text string, links array<struct<kind:string,url:string>>")


def svg_files(files: DataFrame) -> DataFrame:
    """(file, text, saved) of SVG files without comments, those of CDATA sections kept."""
    text = F.regexp_replace("text", r"(<!\[CDATA\[[\s\S]*?\]\]>)|<!--[\s\S]*?-->", "$1")
    return files.select("file", text.alias("text"), (F.octet_length("text") - F.octet_length(text)).cast("long").alias("saved"))


def named_hosts(html: DataFrame) -> DataFrame:
    """(host) that the text of a homepage names in absolute URLs, lower case, with port; joined with addresses these tell private names."""
    found = F.regexp_extract_all("html", F.lit(ABSOLUTE), F.lit(0))
    return html.select(F.explode(found).alias("u")).select(F.lower(F.regexp_replace("u", "^[a-zA-Z]+://", "")).alias("host")).distinct()


# --- rewiring pages ---------------------------------------------------------


def _is_search(form: H.Node) -> bool:
    return form.get("role").lower() == "search" or any(i.get("name") in ("s", "q") for i in form.find("input"))


def wire_form(html: str, path: str) -> tuple[str, int]:
    """A page whose search forms ask `path` by GET, decoys without address included; how many attributes that took."""
    root, n = H.parse(html), 0
    for form in filter(_is_search, root.find("form")):
        want = [(form, "action", path, form.get("action")), (form, "method", "get", form.get("method").lower())]
        want += [(a, "href", path, a.get("href")) for a in form.find("a") if not a.get("href").strip()]
        for node, name, value, old in want:
            if old != value:
                node.attrs[name], n = value, n + 1
    return H.serialize(root), n


def wire_forms(pages: DataFrame, path: str) -> DataFrame:
    """(url, html, n) of the pages whose search forms had to change."""
    rows = pages.where(F.col("html").rlike("(?i)<form"))
    return _changed(rows, lambda html, _: wire_form(html, path))


def minify_inline(html: str) -> tuple[str, int]:
    """A page without comments outside text areas, its style text and scripts minified; how many characters that saves."""
    root = H.parse(html)
    for n in [root, *root.walk()]:
        if n.tag != "textarea":
            n.children = [c for c in n.children if not (isinstance(c, tuple) and c[0].startswith("<!--"))]
        kind = n.get("type").strip().lower()
        script = n.tag == "script" and not n.get("src") and (kind in ("", "module") or "javascript" in kind or "ecmascript" in kind)
        if n.tag == "style" or script:
            text = "".join(n.strings())
            n.children = [rewrite.unwrap_script(text) if script else rewrite.minify_css(text)] if text else []
        if "/*" in n.get("style") or "<!--" in n.get("style"):
            n.attrs["style"] = rewrite.minify_css(n.get("style"))
    out = H.serialize(root)
    return out, max(0, len(html) - len(out))


def minified(pages: DataFrame) -> DataFrame:
    """(url, html, n) of pages that `minify_inline` makes shorter."""
    return _changed(pages, lambda html, _: minify_inline(html))


# --- harvested cards --------------------------------------------------------


def card_links(cards: DataFrame) -> DataFrame:
    """(card, pos, path): root-relative link paths of cards (card, html) in document order, a card that is a link included."""
    schema = pa.schema([("card", pa.string()), ("pos", pa.int32()), ("path", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                refs = (a.get("href").partition("#")[0].partition("?")[0] for a in H.parse(r["html"]).find("a"))
                paths = [canon_path(x) for x in refs if x.startswith("/") and not x.startswith("//")]
                rows += [{"card": r["card"], "pos": k, "path": p} for k, p in enumerate(paths)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return cards.select("card", "html").mapInArrow(run, "card string, pos int, path string")


def card_pages(cards: DataFrame, index: DataFrame) -> DataFrame:
    """(card, path): the page a card is about, the first of its links that the index (path) holds."""
    found = card_links(cards).join(index.select("path").distinct(), "path")
    return found.groupBy("card").agg(F.min_by("path", "pos").alias("path"))


def without_dead_links(fragments: DataFrame, files: DataFrame, key: str = "card") -> DataFrame:
    """(key, html, n) of fragments that lose the address of links which no exported file answers; tag, classes and text stay."""
    raw = F.regexp_extract_all("html", F.lit(r"""(?i)<a\b[^>]*?\shref\s*=\s*["'](/[^/"'][^"']*|/)["']"""), F.lit(1))
    refs = fragments.select(key, F.explode(F.array_distinct(raw)).alias("raw")).withColumn("ref", F.regexp_replace("raw", "[?#].*$", ""))
    dead = refs.join(unanswered(refs.select("ref").distinct(), files), "ref").groupBy(key).agg(F.collect_set("ref").alias("dead"))

    def change(html: str, row: dict) -> tuple[str, int]:
        root, n, gone = H.parse(html), 0, set(row["dead"])
        for a in root.find("a"):
            if a.get("href").partition("#")[0].partition("?")[0] in gone:
                del a.attrs["href"]
                n += 1
        return H.serialize(root), n

    return _changed(fragments.join(dead, key), change, key, ("dead",))


def with_slots(docs: DataFrame, slots: DataFrame) -> DataFrame:
    """The index with the harvested slot (path, slot) of each page in place of its own."""
    held = slots.select("path", F.col("slot").alias("harvested"))
    return docs.join(held, "path", "left").withColumn("slot", F.coalesce("harvested", "slot")).drop("harvested")


def snippet_length(docs: DataFrame) -> DataFrame:
    """(snippet): how long the results page's snippets are."""
    low, high, usual = SNIPPET
    longest = F.max(F.when(F.col("slot.e") != "", F.length("slot.e")))
    return docs.agg(F.coalesce(F.greatest(F.lit(low), F.least(F.lit(high), longest)), F.lit(usual)).cast("int").alias("snippet"))


# --- sliders ----------------------------------------------------------------


def hydrated_sliders(blobs: DataFrame, objects: DataFrame) -> DataFrame:
    """(url, blob, n) of sliders (url, slider_id, blob) whose lazy slides get the layers of the complete object (slider_id, object)."""
    schema = pa.schema([("url", pa.string()), ("blob", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    blob, full = json.loads(r["blob"]), json.loads(r["object"])
                    n = rewrite.hydrate_slides(blob, full)
                except (ValueError, AttributeError, TypeError):  # not the JSON of a slider: it stays as it is
                    continue
                if n:
                    out.append({"url": r["url"], "blob": rewrite.script_json(blob), "n": n})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = blobs.select("url", "slider_id", "blob").join(objects.select("slider_id", "object").dropDuplicates(["slider_id"]), "slider_id")
    return rows.select("url", "blob", "object").mapInArrow(run, "url string, blob string, n long")
