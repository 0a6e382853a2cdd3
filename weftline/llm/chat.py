"""Chat formatting: a role machine, a declarative template, loss segments.

`format_conversations` gathers the turns of a conversation in order, walks the
role machine over them and emits text segments with a loss flag each.
`read_back` parses formatted strings again. Both are DataFrame expressions.

Control strings inside texts and roles are broken by an escape character, so no
marker of the template can occur in escaped text; `unescape` undoes it.

Defined results: a null text counts as empty, a null role as an empty role; a
null turn sorts first; repeated rows and equal turns are each kept, ordered by
(turn, role, text); rows without a conv_id are one conversation; an empty table
gives an empty table; extra columns of the input are not carried. A conversation
is one row of the result, so its texts have to fit in a task, however many rows
name it; no other group is formed, and no task holds two at once. Turn order
violations don't drop a conversation: `valid` is false and `problem` says which
turn broke the order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Markers around a turn; `{role}` stands for the escaped role. `loss` names the roles that are learnt.

    `control` lists the strings that may not occur in a text: each is broken
    after its first character. `moves` is the role machine: from a state, the
    roles that may follow; `final` are the states a conversation may end in.
    """

    start: str = "<|"
    middle: str = "|>\n"
    end: str = "</s>\n"
    loss: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: tuple[str, ...] = ("assistant",)


def _java(s: str) -> str:
    return "".join(c if c.isalnum() or c in "_ " else f"\\{c}" for c in s)


def escape(text: Column, template: Template) -> Column:
    """Reversible: escape characters are doubled, control strings get one after their first character."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    body = "|".join(f"{_java(c[0])}(?={_java(c[1:])})" for c in template.control)
    return F.regexp_replace(out, f"({body})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _machine(template: Template, turns: Column) -> Column:
    """(state, problem): problem is the number of the first turn that the machine refuses, -1 without one."""
    allowed = F.array(*(F.lit(f"{a}\n{b}") for a, bs in template.moves.items() for b in bs))

    def step(a: Column, t: Column) -> Column:
        ok = F.array_contains(allowed, F.concat_ws("\n", a["state"], t["role"]))
        return F.struct(
            t["role"].alias("state"),
            F.when((a["problem"] < 0) & ~ok, a["n"]).otherwise(a["problem"]).alias("problem"),
            (a["n"] + 1).alias("n"),
        )

    return F.aggregate(turns, F.struct(F.lit("").alias("state"), F.lit(-1).alias("problem"), F.lit(0).alias("n")), step)


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, valid, problem, segments, formatted); segments are (text, loss), formatted is their concatenation."""
    t = template or Template()
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    out = out.withColumn("__m", _machine(t, F.col("turns")))
    parts = lambda x: F.array(
        F.struct(F.concat(F.lit(t.start), escape(x["role"], t), F.lit(t.middle)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(x["text"], t).alias("text"), x["role"].isin(*t.loss).alias("loss")),
        F.struct(F.lit(t.end).alias("text"), F.lit(False).alias("loss")),
    )
    out = out.withColumn("segments", F.flatten(F.transform("turns", parts)))
    m = F.col("__m")
    return out.select(
        "conv_id",
        ((m["problem"] < 0) & m["state"].isin(*t.final)).alias("valid"),
        m["problem"].alias("problem"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """`formatted` with `turns`: (role, text, loss), parsed from the string alone; the template says which roles are learnt."""
    t = template or Template()
    pieces = F.filter(F.split("formatted", _java(t.end)), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.instr(p, t.middle)
        role = unescape(F.substring(p, F.lit(len(t.start) + 1), at - (len(t.start) + 1)))
        return F.struct(role.alias("role"), unescape(F.substring(p, at + len(t.middle), F.length(p))).alias("text"), role.isin(*t.loss).alias("loss"))

    return formatted.withColumn("turns", F.transform(pieces, turn))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = read_back(format_conversations(rows))
    learnt = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "")
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(text, '\', '\\'), '|>', '|#>') AS a FROM c),
f AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(a, '<|', '<#|'), '<s>', '<#s>'), '</s>', '<#/s>'), '[INST]', '[#INST]'),
         '[/INST]', '[#/INST]'), '<<SYS>>', '<#<SYS>>'), '<</SYS>>', '<#</SYS>>') AS escaped FROM e),
g AS (SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
             lead(0) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS last FROM f)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(escaped) + length(role) + 10)::BIGINT AS formatted_chars,
       bool_and((before, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')))
         AND max(CASE WHEN last THEN role END) = 'assistant' AS valid
FROM g GROUP BY conv_id
"""
