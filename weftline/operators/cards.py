"""Result cards: what varies between them, and the template that gives them back.

Cards come as their positions (key, kind, value), see functions.html. The
comparison is relational; only the template of a layout needs a tree.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.html import Node, card_positions, parse

POSITION = "layout string, card string, key string, kind string, value string"


def walk_cards(cards: DataFrame) -> DataFrame:
    """(layout, card, key, kind, value) of cards (layout, card, html)."""
    import pyarrow as pa

    schema = pa.schema([(n, pa.string()) for n in ("layout", "card", "key", "kind", "value")])

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                top = next((c for c in parse(r["html"]).children if isinstance(c, Node)), None)
                rows += [{"layout": r["layout"], "card": r["card"], "key": k, "kind": t, "value": v} for k, t, v in (card_positions(top) if top else [])]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return cards.select("layout", "card", "html").mapInArrow(run, POSITION)


def differences(positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variable, optional): (layout, key) of values that differ or are missing in a card, and of elements that some cards lack.

    Of nested optional elements only the outermost counts, and a value below an
    optional element isn't variable but absent.
    """
    n = positions.groupBy("layout").agg(F.count_distinct("card").alias("n"))
    seen = positions.groupBy("layout", "kind", "key").agg(F.count_distinct("card").alias("cards"), F.count_distinct("value").alias("values")).join(n, "layout")
    lacking = seen.where("kind = 'el' and cards < n").select("layout", "key")
    outer = lacking.select("layout", F.col("key").alias("top"))
    # an ancestor is a prefix of the key, so each key asks for its own prefixes: an equi-join
    steps = lambda d: d.withColumn("top", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("key", "/"))), lambda k: F.array_join(F.slice(F.split(F.regexp_replace("key", "[@#].*$", ""), "/"), 1, k), "/"))))
    inside = steps(lacking).where("top <> key").join(outer, ["layout", "top"], "left_semi").select("layout", "key").distinct()
    optional = lacking.join(inside, ["layout", "key"], "left_anti")
    loose = seen.where("kind <> 'el' and (values > 1 or cards < n)").select("layout", "key")
    tops = optional.select("layout", F.col("key").alias("top"))
    below = steps(loose).join(tops, ["layout", "top"], "left_semi").select("layout", "key").distinct()
    return loose.join(below, ["layout", "key"], "left_anti"), optional


def make_template(card_html: str, variable: set[str], optional: set[str]) -> str:
    """A card with {{key}} for each variable value and {{?key}}…{{/key}} around each optional element."""
    top = next(c for c in parse(card_html).children if isinstance(c, Node))
    out: list[str] = []
    todo: list = [(top, top.tag)]
    while todo:
        c, at = todo.pop()
        if isinstance(c, str):
            out.append("{{" + at + "}}" if at in variable else c)
            continue
        attrs = "".join(f' {k}="{"{{" + f"{at}@{k}" + "}}" if f"{at}@{k}" in variable else v}"' for k, v in c.attrs.items())
        out.append(("{{?" + at + "}}" if at in optional else "") + f"<{c.tag}{attrs}>")
        seen, below = Counter(), []
        for x in c.children:
            if isinstance(x, Node):
                below.append((x, f"{at}/{x.tag}{seen[x.tag]}"))
                seen[x.tag] += 1
            elif isinstance(x, str):
                below.append((x, f"{at}#{seen['#']}" if x.strip() else ""))
                seen["#"] += bool(x.strip())
        todo.append((f"</{c.tag}>" + ("{{/" + at + "}}" if at in optional else ""), ""))
        todo.extend(reversed(below))
    return "".join(out)


def render(template: str, values: dict[str, str], present: set[str]) -> str:
    """A template with a card's values; optional elements it lacks are cut."""
    for key in re.findall(r"\{\{\?([^}]+)\}\}", template):
        inner = re.search(re.escape("{{?" + key + "}}") + r"([\s\S]*?)" + re.escape("{{/" + key + "}}"), template)
        if inner:
            template = template[: inner.start()] + (inner[1] if key in present else "") + template[inner.end() :]
    return re.sub(r"\{\{([^}?/][^}]*)\}\}", lambda m: values.get(m[1], ""), template)


def templates(cards: DataFrame) -> DataFrame:
    """(layout, template, variable, optional): one template per layout, made from its fullest card."""
    positions = walk_cards(cards)
    variable, optional = differences(positions)
    size = cards.join(positions.groupBy("layout", "card").agg(F.count("*").alias("n")), ["layout", "card"])
    sample = size.groupBy("layout").agg(F.max_by("html", F.struct("n", "card")).alias("html"))
    keys = lambda d, name: d.groupBy("layout").agg(F.sort_array(F.collect_set("key")).alias(name))
    none = F.array().cast("array<string>")
    rows = sample.join(keys(variable, "variable"), "layout", "left").join(keys(optional, "optional"), "layout", "left")
    rows = rows.select("layout", "html", F.coalesce("variable", none).alias("variable"), F.coalesce("optional", none).alias("optional"))

    @F.pandas_udf("string")
    def build(html: pd.Series, v: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([make_template(h, set(x), set(y)) for h, x, y in zip(html, v, o, strict=True)])

    return rows.select("layout", build("html", "variable", "optional").alias("template"), "variable", "optional")
