"""License scans: ordered signature rules gated by keywords.

Each text goes through three gates: a few substrings that the keywords of all
rules contain, each rule's own keywords in the lower-cased text (a keyword of
every cut has to be there, which leaves few rules a text), then the rule's
pattern. A detection is suppressed when its
interval lies within that of a detection of the same or a stronger rank (of
equal intervals the earlier rule stays). All of this happens inside the row, so
there is no shuffle and no skew.

Defined results: a null text counts as empty and gives no detection; repeated
rows are each scanned; an empty table gives an empty table; input columns pass
through, except those named like an output, which are replaced.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import license_rules
from weftline.llm.common import anchored, blocks, spans, table, whole_text

# Words are maximal runs outside these characters once A-Z is lower case; patterns here keep A-Z instead.
BREAK = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"  # all else, written out: Java matches a negated class of ranges many times slower
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

RULE = "array<struct<id:int,rank:int,score:double,label:string,kind:string,cuts:array<array<int>>,pattern:string>>"
FOUND = "array<struct<start:int,end:int,id:int,rank:int,score:double,label:string,kind:string>>"


def _phrase(words: str) -> str:
    return f"[{BREAK}]+".join(words.split())


def _whole(body: str) -> str:
    return f"(?i)(?<!{WORD})(?:{body})(?!{WORD})"


BASE = _whole("|".join(_phrase(p) for _, p in PHRASES))


def _keep(found: Column) -> Column:
    """Drop detections contained in one of the same or a stronger rank; one ordered pass, in blocks."""
    order = F.sort_array(F.transform(found, lambda d: F.struct(d["start"], (-d["end"]).alias("e"), d["rank"], d["id"], d.alias("d"))))
    ranks = license_rules.RANKS
    none = F.struct(*(F.lit(-1).alias(f"m{k}") for k in ranks))

    def furthest(block: Column) -> Column:
        """The largest end of each rank in a block."""
        return F.struct(*(F.coalesce(F.array_max(F.transform(F.filter(block, lambda x: x["rank"] == k), lambda x: -x["e"])), F.lit(-1)).alias(f"m{k}") for k in ranks))  # noqa: B023

    def carry(a: Column, block: Column) -> Column:
        """Each block with the ends of all blocks before it."""
        own = furthest(block)
        return F.struct(
            F.struct(*(F.greatest(a["at"][f"m{k}"], own[f"m{k}"]).alias(f"m{k}") for k in ranks)).alias("at"),
            F.array_append(a["out"], F.struct(a["at"].alias("at"), block.alias("block"))).alias("out"),
        )

    def step(a: Column, x: Column) -> Column:
        d = x["d"]
        inside = reduce(or_, ((d["rank"] >= k) & (a["at"][f"m{k}"] >= d["end"]) for k in ranks))
        return F.struct(
            F.struct(*(F.when(d["rank"] == k, F.greatest(a["at"][f"m{k}"], d["end"])).otherwise(a["at"][f"m{k}"]).alias(f"m{k}") for k in ranks)).alias("at"),
            F.when(inside, a["out"]).otherwise(F.array_append(a["out"], d)).alias("out"),
        )

    ends = "struct<" + ",".join(f"m{k}:int" for k in ranks) + ">"
    item = f"struct<start:int,e:int,rank:int,id:int,d:{FOUND[6:-1]}>"
    zero = F.struct(none.alias("at"), F.array().cast(f"array<struct<at:{ends},block:array<{item}>>>").alias("out"))
    dealt = F.aggregate(blocks(order), zero, carry, lambda a: a["out"])
    each = F.transform(dealt, lambda b: F.aggregate(b["block"], F.struct(b["at"].alias("at"), F.array().cast(FOUND).alias("out")), step, lambda a: a["out"]))
    return F.flatten(each)


def detect(docs: DataFrame, text: str = "text", rules: tuple[dict, ...] | None = None) -> DataFrame:
    """`docs` with `detections`: kept (start, end, id, rank, score, label, kind) in order of start.

    `rules` are those of `license_rules.rules` unless given.
    """
    own = rules is None
    rules = license_rules.rules() if own else rules
    known = sorted({k for r in rules for c in r["cuts"] for k in c})
    number = {k: i for i, k in enumerate(known)}
    data = [r | {"cuts": [[number[k] for k in c] for c in r["cuts"]]} for r in rules]
    listed = F.from_json(F.lit(json.dumps(data)), RULE)
    words = F.from_json(F.lit(json.dumps(known)), "array<string>")
    t, low = F.col("__l_t"), F.col("__l_low")
    out = docs.withColumn("__l_t", whole_text(text)).withColumn("__l_low", F.lower("__l_t"))
    if own:
        out = out.withColumn("__l_low", F.when(reduce(or_, (F.contains(low, F.lit(g)) for g in license_rules.GATE)), low))
    out = out.withColumn("__l_k", F.filter(F.transform(words, lambda k, i: F.when(F.contains(low, k), i)), lambda i: i.isNotNull()))

    def asked(have: Column) -> Column:
        return F.filter(listed, lambda r: F.forall(r["cuts"], lambda c: F.arrays_overlap(c, have)))

    def hits(r: Column) -> Column:
        return F.transform(
            spans(t, r["pattern"]),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), *(r[c].alias(c) for c in ("id", "rank", "score", "label", "kind"))),
        )

    # a lambda's argument is evaluated once
    out = out.withColumn("__l_c", F.when(low.isNotNull(), F.get(F.transform(F.array("__l_k"), asked), F.lit(0))))
    out = out.withColumn("__l_f", F.when(F.size("__l_c") > 0, F.flatten(F.transform("__l_c", hits))))
    out = out.withColumn("detections", F.when(F.col("__l_f").isNotNull(), _keep(F.col("__l_f"))).otherwise(F.array().cast(FOUND)))
    return out.drop("__l_t", "__l_low", "__l_k", "__l_c", "__l_f")


def count_words(text: Column) -> Column:
    """The number of words. Each word, with what breaks it off, becomes one letter, so no array of words is built."""
    marks = F.regexp_replace(text, f"[{BREAK}]*+{WORD}++(?:[{BREAK}]++\\z)?+", "w")
    return F.when(text.rlike(WORD), F.length(marks)).otherwise(F.lit(0))


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with detections, word counts, base phrase places, labels and a score.

    `first_word` and `last_word` are the smallest and largest start of a base
    phrase in words, null without one. `score` is the largest confidence of
    what was found, 0 without anything.
    """
    count = count_words
    t = F.col("__s_t")
    out = detect(docs, text).withColumn("__s_t", whole_text(text))
    gate = F.contains(F.lower(t), F.lit("license")) | t.rlike(f"(?i){_phrase('cc by nc')}")
    out = out.withColumns({"n_words": count(t).cast("long"), "__s_p": F.when(gate, F.when(t.rlike(BASE), F.split(t, BASE, -1)))})
    out = out.withColumn("__s_h", F.when(F.col("__s_p").isNotNull(), F.regexp_extract_all(t, F.lit(BASE), F.lit(0))))
    pieces, held = F.col("__s_p"), F.col("__s_h")
    base = F.array_compact(F.array(*(F.when(pieces.isNotNull() & t.rlike(_whole(_phrase(p))), F.lit(label)) for label, p in PHRASES)))
    out = out.withColumns(
        {
            "n_base": F.coalesce(F.size(held), F.lit(0)).cast("long"),
            "first_word": F.when(pieces.isNotNull(), count(F.get(pieces, F.lit(0)))).cast("long"),
            "last_word": F.when(pieces.isNotNull(), F.col("n_words") - count(F.element_at(pieces, -1)) - count(F.element_at(held, -1))).cast("long"),
            "__s_b": F.array_sort(base),
        }
    )
    found = F.col("detections")
    return out.withColumns(
        {
            **{c: anchored(F.col(c)) for c in ("detections", "n_words", "n_base", "first_word", "last_word")},
            "base_labels": anchored(F.array_join("__s_b", ",")),
            "labels": anchored(F.array_join(F.array_sort(F.array_distinct(F.concat("__s_b", F.transform(found, lambda d: d["label"])))), ",")),
            "score": anchored(F.greatest(F.coalesce(F.array_max(F.transform(found, lambda d: d["score"])), F.lit(0.0)), F.when(F.size("__s_b") > 0, F.lit(0.9)).otherwise(F.lit(0.0)))),
        }
    ).drop("__s_t", "__s_p", "__s_h", "__s_b")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").cast("long").alias("n_detections"))
