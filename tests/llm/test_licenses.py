import re
from re import _constants as C
from re import _parser

import pytest

from weftline.llm import license_rules, licenses
from weftline.llm.keywords import keywords

BREAKS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = BREAKS.findall((text or "").translate(LOWER))
    starts, labels = [], set()
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def parsed(pattern):
    return _parser.parse(re.sub(r"\(\?<=.*?\{0,8\}\)", "", pattern.removeprefix("(?i)")))


def sample(parts, rng):
    """A text that a parsed pattern matches, if what is looked around for holds."""
    out = ""
    for op, arg in parts:
        if op is C.LITERAL:
            out += chr(arg)
        elif op is C.SUBPATTERN:
            out += sample(arg[3], rng)
        elif op is C.BRANCH:
            out += sample(rng.choice(arg[1]), rng)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            out += "".join(sample(arg[2], rng) for _ in range(max(arg[0], 0)))
        elif op is C.IN:
            kind, value = arg[-1] if arg[0][0] is not C.NEGATE else (C.LITERAL, ord("x"))
            out += {C.CATEGORY_SPACE: "\n", C.CATEGORY_DIGIT: "1", C.CATEGORY_WORD: "x"}[value] if kind is C.CATEGORY else chr(value if kind is C.LITERAL else value[0])
    return out


def test_base_against_brute_force(spark, odd_docs):
    docs = odd_docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "1 as kept", "'y' as labels"))
    rows = licenses.scan_licenses(docs).select("text", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r)[1:6] == brute(r.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1


def test_suppression_and_ranks(spark):
    text = "SPDX-License-Identifier: GPL-2.0-or-later\nLicensed under the Apache License, Version 2.0 (https://www.apache.org/licenses/LICENSE-2.0). MIT License"
    got = licenses.detect(spark.createDataFrame([(text,)], "text string")).first().detections
    assert [(d.label, d.kind) for d in got] == [("gpl-2", "tag"), ("apache-2", "notice"), ("apache-2", "address"), ("mit", "name")]
    for d in got:
        assert not any(e is not d and e["start"] <= d["start"] and d["end"] <= e["end"] and e["rank"] <= d["rank"] for e in got)


@pytest.mark.parametrize("text", ["CC BY-NC 4.0", "GNU General Public License, version 3", "released under the BSD 3-Clause license", "see https://unlicense.org", "in the public domain", "MPL 2.0", "do what the fuck you\nwant to", "W3C software notice", "All rights\nreserved"])
def test_gate_lets_names_through(spark, text):
    assert any(g in text.lower() for g in license_rules.GATE)
    assert licenses.detect(spark.createDataFrame([(text,)], "text string")).first().detections


def test_gates_follow_from_the_patterns():
    """Some choice of keywords covers every pattern, each holding a substring of the gate; none repeats a group without bound."""
    for r in license_rules.rules():
        assert r["cuts"], r["pattern"]
        assert keywords(r["pattern"].removeprefix("(?i)"), lambda k: any(g in k for g in license_rules.GATE)), r["pattern"]
        assert not re.search(r"\)[*+]", r["pattern"]), r["pattern"]


@pytest.mark.parametrize("pattern, want", [(r"a\s+licen[cs]e", {"license", "licence"}), (r"(?:MIT|Expat)x?", {"mit", "expat"}), (r"a?b*", set()), (r"(?:ab)?cd", {"cd"})])
def test_keywords(pattern, want):
    assert keywords(pattern) == want


def test_every_keyword_is_in_a_match(spark):
    """A match of each rule, made from its pattern, passes both gates and is found."""
    import random

    rng = random.Random(1)
    texts = []
    for r in license_rules.rules():
        text = sample(parsed(r["pattern"]), rng)
        assert all(any(k in text.lower() for k in c) for c in r["cuts"]), (r["pattern"], text)
        texts.append((r["id"], r["label"], text))
    rows = licenses.detect(spark.createDataFrame(texts, "id int, label string, text string").repartition(4)).collect()
    assert not [(r.id, r.text) for r in rows if not r.detections]


def test_odd_expressions_and_long_texts(spark):
    chained = "SPDX-License-Identifier: " + "a OR " * 20_000
    texts = [chained, chained + "MIT", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", "GFDL-1.3" + "-a" * 50_000, "x " * 500_000 + "MIT License", "MIT License, " * 5000]
    got = [r.detections for r in licenses.detect(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    assert got[0] == [] and {d.label for d in got[1]} == {"mit"}
    assert [d.label for d in got[2]] == ["bsd-3"] or {d.label for d in got[2]} >= {"mit", "apache-2", "bsd-3"}
    assert [(d.start, d.end, d.label) for d in got[4]] == [(1_000_000, 1_000_011, "mit")]
    assert [(d.start, d.end) for d in got[5]] == [(13 * k, 13 * k + 11) for k in range(5000)]


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("do what the fuck you want to", "wtfpl"),
        ("do what the fuck you\nwant to", "wtfpl"),
        ("see http://www.wtfpl.net", "wtfpl"),
        ("released in the public\ndomain", "public-domain"),
        ("NCSA open\nsource license", "ncsa"),
    ],
)
def test_keywords_are_in_wrapped_texts(spark, text, label):
    assert label in {d.label for d in licenses.detect(spark.createDataFrame([(text,)], "text string")).first().detections}


def test_every_rule_is_its_own_and_many():
    rules = license_rules.rules()
    assert len(rules) > 500 and [r["id"] for r in rules] == list(range(len(rules)))
    assert len({r["pattern"] for r in rules}) == len(rules)


def test_empty_table(spark, odd_docs):
    assert licenses.scan_licenses(odd_docs.where("doc_id > 99")).collect() == []
