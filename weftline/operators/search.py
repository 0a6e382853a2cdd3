"""Ranked site search, its index, and the terms that probe another search.

Fields and terms are folded by the same function. Matching is by substring, the
rank is a case over the terms, the order rank, date string descending, path.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.functions.html import fold

DOCS = "path string, title string, desc string, text string, slot struct<t:string,e:string,i:string,l:string>"
RESULTS = 50
MAX_TERMS = 8


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda s: fold(s) if isinstance(s, str) else None)


def folded(text: Column) -> Column:
    """Lower case, no combining marks, sharp s as ss; null stays null.

    Texts of Latin-1 letters are folded by built-in expressions, only others go
    to Python.
    """
    marked = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    plain = F.replace(F.translate(F.lower(text), marked, "aaaaaaceeeeiiiinooooouuuuyy"), F.lit("ß"), F.lit("ss"))
    other = text.rlike(r"[^\x00-\xFF]")
    return F.when(other, _folded(F.when(other, text))).otherwise(plain)


def query_terms(query: str) -> tuple[str, list[str]]:
    """(sentence, terms): a wholly quoted query is one phrase; no terms means the sentence itself."""
    sentence = fold(query.strip())
    phrase = re.fullmatch(r'\s*"([^"]+)"\s*', query)
    terms = [fold(phrase[1])] if phrase else [t for t in re.split(r"[^\w]+", fold(query)) if t][:MAX_TERMS]
    return sentence, terms or [sentence]


def search_fields(docs: DataFrame) -> DataFrame:
    """`docs` with folded f_title, f_excerpt, f_content: compute once, write, and search many times."""
    first = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b), F.lit(""))
    return docs.withColumns({"f_title": folded(first("slot.t", "title")), "f_excerpt": folded(first("slot.e", "desc")), "f_content": folded(F.coalesce("text", F.lit("")))})


def search(docs: DataFrame, query: str, lang: str = "", limit: int = RESULTS) -> DataFrame:
    """(path, rank, date) of the documents of `search_fields` that answer a query, best first."""
    sentence, terms = query_terms(query)
    title, excerpt, content = F.col("f_title"), F.col("f_excerpt"), F.col("f_content")
    has = lambda c, t: F.contains(c, F.lit(t))
    rows = docs
    if lang:
        own = F.coalesce(F.col("slot.l"), F.lit(""))
        rows = rows.where((own == "") | (own == lang))
    for t in terms:
        rows = rows.where(has(title, t) | has(excerpt, t) | has(content, t))
    if len(terms) < 2:
        rank = F.when(has(title, terms[0]), 1).otherwise(2)
    else:
        rank = F.when(has(title, sentence), 1)
        if len(terms) < 7:
            every = any_ = None
            for t in terms:
                every = has(title, t) if every is None else every & has(title, t)
                any_ = has(title, t) if any_ is None else any_ | has(title, t)
            rank = rank.when(every, 2).when(any_, 3)
        rank = rank.when(has(excerpt, sentence), 4).when(has(content, sentence), 5).otherwise(6)
    day = F.coalesce(F.col("slot.i"), F.lit(""))
    rows = rows.select("path", rank.alias("rank"), F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}"), day).otherwise("").alias("date"))
    return rows.orderBy("rank", F.desc("date"), "path").limit(limit)


def search_docs(meta: DataFrame, parsed: DataFrame, suffix: str = "") -> DataFrame:
    """The index (DOCS) of classified pages (`exclusion` as of the search scope): the first source of each saved URL."""
    from weftline.functions.urls import url_path
    from weftline.operators.classify import saved
    from weftline.operators.pages import strip_suffix

    rows = meta.where("exclusion = ''").withColumn("target", saved())
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("url"))).where("n = 1")
    page = parsed.select(F.col("url").alias("p_url"), F.col("title").alias("p_title"), F.col("description"), "text", F.col("date"), F.col("lang").alias("p_lang"))
    rows = first.join(page, first["url"] == page["p_url"])
    title = strip_suffix(F.col("p_title"), suffix)
    slot = F.struct(title.alias("t"), F.col("description").alias("e"), F.col("date").alias("i"), F.split_part(F.lower("p_lang"), F.lit("-"), F.lit(1)).alias("l"))
    return rows.select(url_path(F.col("target")).alias("path"), F.col("p_title").alias("title"), F.col("description").alias("desc"), "text", slot.alias("slot"))


def index_json(docs: DataFrame, lang: str = "") -> DataFrame:
    """(path, doc): each document as a positional JSON array, sorted by path when collected."""
    parts = [F.to_json(F.array(F.coalesce(c, F.lit("")))) for c in ("path", "title", "desc", "text")]
    inner = [F.substring(p, F.lit(2), F.length(p) - 2) for p in parts]
    return docs.select("path", F.concat(F.lit("["), F.concat_ws(",", *inner, F.to_json("slot")), F.lit("]")).alias("doc"))


def words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(path, word): the folded words of a document, each once; runs of letters are cut at 32."""
    found = F.regexp_extract_all(folded(F.col(text)), F.lit(r"\p{L}{2,32}"), F.lit(0))
    return docs.select("path", F.explode(F.array_distinct(found)).alias("word"))


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    return words(docs, text).groupBy("word").agg(F.count("*").alias("df"))


def rare_term(df: DataFrame) -> DataFrame:
    """(word): the longest word of a single document, ASCII and of eight letters before others, ties alphabetical."""
    n, w = F.length("word"), F.col("word")
    tier = F.when((n >= 8) & w.rlike("^[\\x00-\\x7F]+$"), 1).when(n >= 8, 2).when(n >= 6, 3)
    return df.where("df = 1").select("word", tier.alias("tier"), n.alias("n")).where("tier is not null").orderBy("tier", F.desc("n"), "word").limit(1).select("word")


def split_echo(text: Column, term: str) -> Column:
    """(before, after) around the last occurrence of a term, null without one."""
    at = F.length(text) - F.length(F.substring_index(text, term, -1)) - len(term)
    return F.when(F.contains(text, F.lit(term)), F.struct(F.substring(text, F.lit(1), at).alias("before"), F.substring_index(text, term, -1).alias("after")))
