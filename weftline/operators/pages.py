"""Parsing captured pages once: signals, text and links in one pass.

`parse_pages` is a mapInArrow, so Catalyst can't split it and evaluate it twice;
write its result and build everything else on that. A page that can't be parsed
gives a row with `error`, never a failed task.
"""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions.urls import Urls, b64_url, srcset
from weftline.rules import Rules, Site, load_rules

LINK = pa.struct([("pos", pa.int32()), ("tag", pa.string()), ("attr", pa.string()), ("rel", pa.string()), ("ref", pa.string()), ("kind", pa.string()), ("dst", pa.string())])
_TEXT = ("url", "title", "description", "canonical", "lang", "site_name", "date", "artifact", "text", "error")
_FLAGS = ("has_title", "has_description", "has_viewport", "noindex", "search_form", "search_link", "whole_body")
SCHEMA = pa.schema([*((n, pa.string()) for n in _TEXT), *((n, pa.bool_()) for n in _FLAGS), ("alternates", pa.map_(pa.string(), pa.string())), ("links", pa.list_(LINK))])
PARSED = ", ".join(
    [*(f"{n} string" for n in _TEXT), *(f"{n} boolean" for n in _FLAGS), "alternates map<string,string>", "links array<struct<pos:int,tag:string,attr:string,rel:string,ref:string,kind:string,dst:string>>"]
)

# References in style text and refresh tags.
_CSS_URL = re.compile(r"""url\(\s*["']?\s*([^"')\s][^"')]*)""", re.I)
_CSS_IMPORT = re.compile(r"""@import\s+(?:"([^"]+)"|'([^']+)')""", re.I)
_REFRESH = re.compile(r"""\burl\s*=\s*["']?([^"']+)""", re.I)


def css_refs(css: str) -> list[str]:
    """What style text loads by url() or @import."""
    return _CSS_URL.findall(css) + [a or b for a, b in _CSS_IMPORT.findall(css)]
# Schemes that navigate nowhere.
NOWHERE = ("data:", "mailto:", "tel:", "javascript:", "#")


def route(u: Urls, page: str, tag: str, rel: set[str], ref: str) -> list[tuple[str, str]]:
    """(kind, url) of one candidate: page, asset, external, query (skipped), or nothing."""
    ref = ref.strip()
    if not ref or ref.startswith(NOWHERE):
        return []
    url = u.resolved(page, ref)
    if not u.internal(url):
        return [("external", url)] if urlsplit(url).netloc else []
    url = u.based(url)
    if tag == "a" and not u.asset(url):
        found = u.page(url)
        if found:
            return [("page", found)]
        out = [("query", url)] if urlsplit(url).query else []
        bare = u.page(url.partition("?")[0]) if out else None
        return out + ([("page", bare)] if bare else [])
    if tag == "link" and rel & {"amphtml", "next", "prev"}:
        found = u.page(url)
        return [("page", found)] if found else []
    if tag == "link" and rel & {"canonical", "alternate", "shortlink", "pingback", "wlwmanifest", "edituri"}:
        return []
    return [] if u.dynamic.search(urlsplit(url).path) else [("asset", url)]


def candidates(root: H.Node, rules: Rules):
    """(tag, attr, rel, ref) of everything in a page that may be a URL; attr `text` marks text to be swept."""
    special = {*rules.url_attrs, *rules.srcset_attrs, *rules.page_url_attrs, *rules.b64_url_attrs, "style", "rel", "class", "id"}
    for n in root.walk():
        rel = " ".join(n.words("rel"))
        for a in rules.url_attrs:
            if value := n.get(a):
                if a in rules.css_url_attrs and "url(" in value:
                    yield from (("style", a, "", m) for m in _CSS_URL.findall(value))
                else:
                    yield n.tag, a, rel, value
        for a in rules.srcset_attrs:
            yield from (("img", a, rel, url) for url, _ in srcset(n.get(a)) if url)
        for a in rules.page_url_attrs:
            if n.get(a):
                yield "a", a, rel, n.get(a)
        for a in rules.b64_url_attrs:
            if n.get(a):
                url = b64_url(n.get(a))
                yield ("img", a, rel, url) if url else (n.tag, "text", "", n.get(a))
        yield from (("style", "style", "", m) for m in _CSS_URL.findall(n.get("style")))
        if n.tag == "meta":
            if (n.get("property") or n.get("name")).lower() in ("og:image", "og:image:url", "twitter:image"):
                yield "meta-img", "content", "", n.get("content")
            if n.get("http-equiv").lower() == "refresh" and (m := _REFRESH.search(n.get("content"))):
                yield "a", "refresh", "", m[1].strip()
        else:
            yield from ((n.tag, "text", "", v) for a, v in n.attrs.items() if a not in special and v)
        if n.tag == "style":
            css = "".join(n.strings())
            yield from (("style", "css", "", m) for m in css_refs(css))
        if n.tag == "script":
            yield "script", "text", "", "".join(n.strings())


# Body classes of pages that a content system makes by itself.
ATTACHMENT_CLASSES = {"attachment", "attachment-template-default", "single-attachment"}
NOTHING_FOUND = {"no-results", "not-found"}
_CLASS = r"""\sclass\s*=\s*["']([^"']*)["']"""
_ANY_CLASS = re.compile(_CLASS, re.I)
# A body tag without a class is taken too, so that none is scanned twice, however many there are.
_BODY = re.compile(rf"<body(?:[^>]*?{_CLASS}|[^>]*)", re.I)


def artifact(url: str, html: str) -> str:
    """What machine-made page this is: image cache, attachment page, empty archive; empty for none. The whole page counts, however long its head."""
    if re.search(r"/phpthumb_cache[^/]*/", url, re.I):
        return "phpthumb-cache"
    own = set(next((m[1] for m in _BODY.finditer(html) if m[1] is not None), "").lower().split())
    if own & ATTACHMENT_CLASSES or any(re.fullmatch(r"attachmentid-\d+", c) for c in own):
        return "wp-attachment"
    return "empty-archive" if "archive" in own and any(set(m[1].lower().split()) >= NOTHING_FOUND for m in _ANY_CLASS.finditer(html)) else ""


#: The dear parts of a parse, which a reader of signals alone can do without.
PARTS = ("links", "text")


def parse_page(url: str, html: str | None, site: Site | None = None, rules: Rules | None = None, limit: int = 2000, parts: tuple[str, ...] = PARTS) -> dict:
    """Everything the operators ask of one page; without a site, the page's own host is the site. Of PARTS, those not in `parts` stay empty."""
    base = urlsplit(url)
    site = site or Site(f"{base.scheme}://{base.netloc}", rules=rules or load_rules())
    u, root = Urls(site), H.parse(html)
    links = []
    for tag, attr, rel, ref in candidates(root, site.rules) if "links" in parts else ():
        found = u.swept(ref) if attr == "text" else route(u, url, tag, set(rel.split()), ref)
        links.extend({"pos": len(links) + i, "tag": tag, "attr": attr, "rel": rel, "ref": "" if attr == "text" else ref, "kind": kind, "dst": dst} for i, (kind, dst) in enumerate(found))
    alternates: dict[str, str] = {}
    for n in root.find("link"):
        if "alternate" in n.words("rel") and (tag := n.get("hreflang").strip()) and u.internal(n.get("href").strip()) and (dst := u.page(u.based(n.get("href").strip()))):
            alternates.setdefault(tag, dst)
    content = H.content_root(root)
    text = H.visible_text(content if content is not None else H.body_of(root), limit) if "text" in parts else ""
    return {"url": url, **H.signals(root, lambda ref: u.internal(u.resolved(url, ref))), "artifact": artifact(url, html or ""), "text": text, "whole_body": content is None, "alternates": list(alternates.items()), "links": links, "error": ""}


def parse_pages(pages: DataFrame, site: Site | None = None, url: str = "url", html: str = "html", limit: int = 2000, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """One row per page with the columns of PARSED; Catalyst can't prune a parse, so `parts` says which of PARTS are wanted."""
    rules = site.rules if site else load_rules()

    def run(batches):
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    rows.append(parse_page(a.as_py() or "", b.as_py(), site, rules, limit, parts))
                except Exception as e:  # noqa: BLE001  a page can hold anything; it is marked, the run goes on
                    rows.append({"url": a.as_py(), "error": f"{type(e).__name__}: {e}"[:500]})
            for k in range(0, len(rows), 500):
                yield pa.RecordBatch.from_pylist(rows[k : k + 500], schema=SCHEMA)

    return pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, PARSED)


def links(parsed: DataFrame) -> DataFrame:
    """The edges: (src, pos, tag, attr, rel, ref, kind, dst)."""
    return parsed.select(F.col("url").alias("src"), F.inline("links"))


def title_suffix(titles: DataFrame, site_name: str) -> DataFrame:
    """(suffix, n): the most frequent separator and site name at the end of titles; ties go to the smallest."""
    tail = F.lit(None).cast("string")
    for sep in reversed(SEPARATORS):
        whole = sep + site_name
        tail = F.when(F.col("title").endswith(whole) & (F.length("title") > len(whole)), F.lit(whole)).otherwise(tail)
    return titles.select(tail.alias("suffix")).where("suffix is not null").groupBy("suffix").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "suffix").limit(1)


# What themes put between a title and the site's name.
SEPARATORS = (" - ", " – ", " — ", " | ", " · ", " » ", " :: ", " / ")


def strip_suffix(title: Column, suffix: str) -> Column:
    if not suffix:
        return title
    return F.when(title.endswith(suffix) & (F.length(title) > len(suffix)), F.rtrim(F.substring(title, F.lit(1), F.length(title) - len(suffix)))).otherwise(title)


# What differs between two captures of one page, and what is put in its place, in order.
NOISE = (
    (r"(?s)<!--.*?-->", ""),
    (r"""(?i)(_wpnonce|nonce|csrf[\w-]*|token)(["']?\s*[:=]\s*["'])[A-Za-z0-9+/=._-]{6,}(["'])""", "$1$2$3"),
    (r"""(?i)(name=["']_wpnonce["']\s+value=["'])[^"']+""", "$1"),
    (r"""(?i)[?&](?:ver|v|t|cache|nocache)=[^\s"'&<>]+""", ""),
)


def noise_free(html: Column, extra: tuple[tuple[str, str], ...] = ()) -> Column:
    """HTML without comments, nonces, version queries and spare white space, for comparing two captures."""
    out = html
    for pattern, to in (*NOISE, *extra):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(out, r"\s+", " "))
