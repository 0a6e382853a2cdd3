"""Secret scans over a trigram inverted index.

1. `trigrams.query` turns each rule's pattern into a Boolean query.
2. One pass over the texts finds the trigrams that any query names (no other can
   affect an answer), and runs the rules without mandatory trigrams, which scan
   every text. What it finds is written once; a text is written only if its
   trigrams complete a query, so no other text travels.
3. `postings` are (trigram, row) of what was written; `candidates` intersects
   them: a row's postings meet as bits of a few 64-bit words (partial aggregation
   keeps one row per text and task), and a rule is a candidate where one
   conjunction of its query is complete.
4. The join with the candidates says which rules are verified on which text, with
   the patterns themselves.

Rows are keyed by (doc_id, 64-bit hash of the text), so repeated doc_ids don't
mix, and the join is split by adaptive execution where rows repeat.

Defined results: a null text counts as empty; a null doc_id is a value like
any other; repeated rows each give their result; an empty table gives an empty
table; other input columns pass through, except those named like an output.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import trigrams
from weftline.llm.common import anchored, cut, spans, table, whole_text

SPAN = "array<struct<start:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """`least` characters are asked of group `group` (0: the match); shorter matches are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base kinds, in their order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: The method's own kinds.
MORE = (
    Rule("access_temp", r"ASIA[A-Z0-9]{16,}"),
    Rule("git_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("git_pat", r"github_pat_[A-Za-z0-9_]{22,}"),
    Rule("lab_token", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pay_key", r"[prs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("package_token", r"(?:npm_|pypi-)[A-Za-z0-9_-]{36,}"),
    Rule("url_login", r"://[^\s/:@]+:([^\s/:@]+)@", 1, 3),
)
RULES = BASE + MORE
LANE = 63


class Index:
    """What the rules ask of the index: the trigrams, and per rule the conjunctions as bit words."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = {r.kind: trigrams.query(r.pattern) for r in rules}
        self.scanned = [r for r in rules if frozenset() in self.queries[r.kind]]
        self.indexed = [r for r in rules if r not in self.scanned]
        self.terms = sorted({t for r in self.indexed for c in self.queries[r.kind] for t in c})
        self.lanes = max(1, -(-len(self.terms) // LANE))

    def masks(self, clause: frozenset[str]) -> list[int]:
        at = {t: i for i, t in enumerate(self.terms)}
        out = [0] * self.lanes
        for t in clause:
            out[at[t] // LANE] |= 1 << at[t] % LANE
        return out

    def satisfied(self, lanes: list[Column]) -> Column:
        """Kinds whose query the bit words satisfy. The queries are data, so the plan stays small however many there are."""
        data = [{"kind": r.kind, "clauses": [self.masks(c) for c in self.queries[r.kind]]} for r in self.indexed]
        queries = F.from_json(F.lit(json.dumps(data)), "array<struct<kind:string,clauses:array<array<bigint>>>>")

        def met(c: Column) -> Column:
            return reduce(and_, (lane.bitwiseAND(F.get(c, F.lit(k))) == F.get(c, F.lit(k)) for k, lane in enumerate(lanes)))

        return F.transform(F.filter(queries, lambda q: F.exists(q["clauses"], met)), lambda q: q["kind"])

    def posted(self, text: Column) -> Column:
        """The numbers of the indexed trigrams of a text."""
        terms = F.from_json(F.lit(json.dumps(self.terms)), "array<string>")
        # a lambda's argument is evaluated once; a column named in a lambda may be written out in it by Catalyst
        each = lambda low: F.filter(F.transform(terms, lambda t, i: F.when(F.contains(low, t), i)), lambda i: i.isNotNull())
        return F.get(F.transform(F.array(F.lower(text)), each), F.lit(0))

    def lanes_of(self, terms: Column) -> Column:
        """The bit words of an array of trigram numbers."""
        one = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(t, F.lit(LANE)))
        bit = lambda t, k: F.when(F.floor(t / LANE) == k, one(t)).otherwise(F.lit(0).cast("long"))
        zero = F.array(*(F.lit(0).cast("long") for _ in range(self.lanes)))
        return F.aggregate(terms, zero, lambda a, t: F.array(*(F.get(a, F.lit(k)).bitwiseOR(bit(t, k)) for k in range(self.lanes))))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """`docs` with the row key of the index: `__k_id`, `__k_hash` and the whole text `__k_t`."""
    return docs.withColumns({"__k_id": F.col(doc_id), "__k_t": whole_text(text)}).withColumn("__k_hash", F.xxhash64("__k_t"))


def postings(rows: DataFrame) -> DataFrame:
    """The postings (term, __k_id, __k_hash) of keyed rows with `__k_terms`, term being the number of a trigram in `Index.terms`."""
    return rows.select("__k_id", "__k_hash", F.explode("__k_terms").alias("term"))


def candidates(posted: DataFrame, index: Index | None = None) -> DataFrame:
    """(__k_id, __k_hash, kinds): the rules to verify, from intersecting the postings."""
    index = index or Index()
    bit = F.expr(f"shiftleft(1L, cast(term % {LANE} as int))")
    lanes = [F.bit_or(F.when(F.floor(F.col("term") / LANE) == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"lane{k}") for k in range(index.lanes)]
    met = posted.groupBy("__k_id", "__k_hash").agg(*lanes)
    met = met.select("__k_id", "__k_hash", index.satisfied([F.col(f"lane{k}") for k in range(index.lanes)]).alias("kinds"))
    return met.where(F.size("kinds") > 0)


def _found(rule: Rule, text: Column) -> Column:
    hits = spans(text, F.lit(rule.pattern))
    held = lambda s: F.length(F.regexp_extract(s["text"], rule.pattern, rule.group) if rule.group else s["text"])
    hits = F.filter(hits, lambda s: held(s) >= rule.least) if rule.least > 1 else hits
    return F.transform(hits, lambda s: F.struct(s["start"], F.lit(rule.kind).alias("kind"), s["end"]))


def _maybe(rule: Rule, text: Column) -> Column:
    """Cheap refusal before the offsets are worked out."""
    if rule.kind == "hex":
        return text.rlike(r"[0-9a-f]{24}")
    return text.rlike(rule.pattern)


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, index: Index | None = None) -> DataFrame:
    """The columns `carry` of `docs` (all unless given) with `secrets`: array of (start, kind, end) in order of start, then kind as listed."""
    index = index or Index()
    carry = [c for c in (docs.columns if carry is None else carry) if c != "secrets"]
    none = F.array().cast(SPAN)
    rows = keyed(docs, doc_id, text)
    t = F.col("__k_t")
    scanned = [F.when(_maybe(r, t), _found(r, t)).otherwise(none) for r in index.scanned]
    rows = rows.select(*carry, "__k_id", "__k_hash", "__k_t", (F.concat(*scanned) if scanned else none).alias("__k_all"), index.posted(t).alias("__k_terms"))
    rows = rows.withColumn("__k_lanes", index.lanes_of(F.col("__k_terms")))
    met = index.satisfied([F.get("__k_lanes", F.lit(k)) for k in range(index.lanes)])
    rows = cut(rows.withColumn("__k_v", F.when(F.size(met) > 0, t)).drop("__k_t", "__k_lanes"), "posted")
    found = candidates(postings(rows), index)
    hit = found.select(F.col("__k_id").alias("__c_id"), F.col("__k_hash").alias("__c_hash"), F.col("kinds").alias("__c_kinds"))
    rows = rows.drop("__k_terms").join(hit, F.col("__k_id").eqNullSafe(F.col("__c_id")) & (F.col("__k_hash") == F.col("__c_hash")), "left")
    v = F.col("__k_v")
    checked = [F.when(F.array_contains("__c_kinds", r.kind) & _maybe(r, v), _found(r, v)).otherwise(none) for r in index.indexed]
    order = F.array(*(F.lit(r.kind) for r in index.rules))
    every = F.transform(F.concat("__k_all", *checked), lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("o"), s["end"], s["kind"].alias("kind")))
    out = F.transform(F.sort_array(every), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return rows.select(*carry, anchored(out).alias("secrets"))


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", index: Index | None = None) -> DataFrame:
    """`docs` with `secrets`."""
    return find_secrets(docs, doc_id, text, None, index)


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def redact(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with every found span replaced; overlapping spans give one mark."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        start = F.greatest(a["at"], s["start"])
        piece = F.when(s["start"] >= a["at"], F.array(F.substring(text, a["at"] + 1, start - a["at"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], piece).alias("out"))

    joined = F.aggregate(found, zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, joined).otherwise(text)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_secrets(docs, carry=["doc_id"])
    found = F.col("secrets")
    base = [r.kind for r in BASE]
    return out.select(
        "doc_id",
        *(of_kind(found, k).alias(f"n_{k}") for k in base),
        F.sha2(listed(F.filter(found, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(found).alias("spans"),
    )


def _sql(rule: Rule) -> str:
    """(rid, s, kind, o, e) of one rule: matches and the pieces between them give the offsets."""
    pattern = rule.pattern.replace("'", "''")
    held = f"regexp_extract(h, '{pattern}', {rule.group})"
    return f"""
  SELECT rid, s, '{rule.kind}' AS kind, {RULES.index(rule)} AS o, s + length(h) AS e FROM (
    SELECT rid, h, list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT rid, m, g, unnest(m) AS h, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT rid, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM d WHERE regexp_matches(t, '{pattern}'))))
  WHERE length({held}) >= {rule.least}"""


OP3_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),\nf AS ("
    + "\n  UNION ALL".join(map(_sql, RULES))
    + """),
x AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, o) FILTER (o < 3) AS base,
        string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, o) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN x USING (rid)
"""
)
