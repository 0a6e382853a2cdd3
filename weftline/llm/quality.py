"""Quality rules: a threshold table compiled into one projection.

`METRICS` names a Spark expression for each measure, `RULES` is the table of
bounds over them. `score_quality` compiles both into plain projections: no
shuffle, no user function, no state, so it scales with the scan.

Defined results: a null text counts as empty; an empty text has no words, so
every measure is 0 and the base rule rejects it; repeated rows and ties are
each judged on their own; an empty table gives an empty table; other columns
of the input pass through untouched, except those named like an output, which
are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import anchored, spaced_words, table, whole_text

WINDOW = 8

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "le la les de des et un une du en que est pour qui dans par sur au plus ce pas avec sont il "
    "el los las y del se por con no su para es al lo como más o pero sus una"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes when low <= metric <= high; bounds are inclusive, None is open."""

    name: str
    metric: str
    low: float | None
    high: float | None


#: The method's own table. Wide on purpose: ordinary prose passes every row of it.
RULES = (
    Rule("length", "n_words", 20, 1_000_000),
    Rule("word_length", "mean_word_chars", 2.0, 16.0),
    Rule("symbols", "symbol_ratio", None, 0.25),
    Rule("shouting", "upper_ratio", None, 0.6),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("letters", "letter_word_ratio", 0.6, None),
    Rule("lines", "dup_line_ratio", None, 0.4),
)


def _adjacent(pairs: Column, key: str) -> Column:
    """Those of sorted `pairs` that have a neighbour of equal `key`."""
    same = lambda x, other: F.coalesce(other[key] == x[key], F.lit(False))
    return F.filter(pairs, lambda x, k: same(x, F.get(pairs, k - 1)) | same(x, F.get(pairs, k + 1)))


def _confirmed(pairs: Column, words: Column) -> Column:
    """Whether all neighbours of equal hash stand for equal windows of `words`."""
    window = lambda x: F.slice(words, x["i"] + 1, WINDOW)
    met = lambda x, before: F.coalesce(before["h"] != x["h"], F.lit(True)) | (window(before) == window(x))
    return ~F.exists(F.transform(pairs, lambda x, k: met(x, F.get(pairs, k - 1))), lambda ok: ~ok)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the measures appended.

    Windows are compared by 64-bit hashes; those whose hash repeats are confirmed
    by comparing neighbours of equal hash word by word. Only a text in which that
    fails, as two different windows share a hash, has its windows built as
    strings, so the counts are exact.
    """
    steps = docs.drop(*(c for c in docs.columns if c.startswith("__q_")))
    steps = steps.withColumn("__q_t", whole_text(text))
    steps = steps.withColumns(
        {
            "__q_words": spaced_words(F.col("__q_t")),
            "__q_lines": F.filter(F.split("__q_t", "\n"), lambda x: x.rlike(r"\S")),
        }
    )
    words, lines = F.col("__q_words"), F.col("__q_lines")
    steps = steps.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "__q_n": F.size(words),
            "__q_hash": F.transform(words, lambda w: F.xxhash64(w)),
        }
    )
    n, hashes = F.col("__q_n"), F.col("__q_hash")
    none = F.array().cast("array<bigint>")
    steps = steps.withColumn(
        "__q_wh",
        F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))).otherwise(none),
    )
    hashed = F.sort_array(F.transform("__q_wh", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    steps = steps.withColumn("__q_pairs", F.when(F.size(F.array_distinct("__q_wh")) < F.size("__q_wh"), hashed))
    steps = steps.withColumn("__q_dups", _adjacent(F.col("__q_pairs"), "h"))
    dups = F.col("__q_dups")
    windows = F.sort_array(F.transform(dups, lambda x: F.struct(F.concat_ws(" ", F.slice(words, x["i"] + 1, WINDOW)).alias("w"), x["i"].alias("i"))))
    steps = steps.withColumn("__q_odd", F.when(~_confirmed(dups, words), windows))
    places = lambda pairs: F.array_sort(F.transform(pairs, lambda x: x["i"]))
    steps = steps.withColumn("__q_at", F.coalesce(places(_adjacent(F.col("__q_odd"), "w")), places(dups)))
    at = F.col("__q_at")
    covered = F.aggregate(F.transform(at, lambda p, k: F.coalesce(F.least(F.lit(WINDOW), F.get(at, k + 1) - p), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
    t = F.col("__q_t")
    steps = steps.withColumns(
        {
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "__q_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
            "n_lines": F.size(lines).cast("long"),
            "n_stop_words": F.size(F.array_intersect(words, F.array(*map(F.lit, dict.fromkeys(STOP_WORDS))))).cast("long"),
            "__q_lw": F.regexp_count(t, F.lit(r"\p{L}\S*")),
        }
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    steps = steps.withColumns(
        {
            "mean_word_chars": share(F.col("word_chars"), n),
            "symbol_ratio": share(F.col("n_symbols"), n),
            "upper_ratio": share(F.col("__q_upper"), F.col("word_chars")),
            "letter_word_ratio": share(F.col("__q_lw"), n),
            "dup_line_ratio": share(F.col("n_dup_lines"), F.size(lines)),
        }
    )
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "mean_word_chars", "symbol_ratio", "upper_ratio", "letter_word_ratio", "dup_line_ratio")
    steps = steps.withColumns({m: anchored(F.col(m)) for m in measures})
    return steps.drop(*(c for c in steps.columns if c.startswith("__q_")))


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rows of the table that a measured document violates."""
    out = []
    for r in rules:
        m = F.col(r.metric)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (m < r.low)
        if r.high is not None:
            bad = bad | (m > r.high)
        out.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*out))


def score_quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with all measures, `base_failed`, `failed` (violated rules) and `kept`."""
    out = measure(docs, text)
    out = out.withColumns(
        {
            "base_failed": (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30),
            "failed": failed_rules(rules),
        }
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT rid, unnest(range(1, greatest(len(w) - 6, 1))) AS i, w FROM d),
k AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS v FROM g),
p AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, v) AS n FROM k) WHERE n > 1),
c AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS covered
      FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM p) GROUP BY rid),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
         coalesce(covered, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words,
         len(list_filter(list_distinct(w), lambda x: list_contains(string_split('__STOPS__', ' '), x))) AS n_stop
  FROM d LEFT JOIN c USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       (n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words AND n_words <= 1000000
        AND word_chars / n_words BETWEEN 2 AND 16 AND n_symbols / n_words <= 0.25 AND n_upper / word_chars <= 0.6
        AND n_stop >= 2 AND n_letter_words / n_words >= 0.6
        AND CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END <= 0.4) AS kept
FROM m
""".replace("__STOPS__", " ".join(dict.fromkeys(STOP_WORDS)))
