"""Boolean trigram queries of regular expressions.

`query(pattern)` parses a pattern and returns its query in disjunctive normal
form: a set of conjunctions, each a set of lower-case trigrams. Every match
contains all trigrams of at least one conjunction. An empty conjunction means
that the pattern has no mandatory trigrams, so every text is a candidate.

The derivation carries, for each part of the pattern, the set of strings it can
match exactly while that set is small, and flushes the trigrams of these
strings whenever the set stops being exact or grows too large.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

MAX_STRINGS = 24
MAX_CLAUSES = 48

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _and(a: Query, b: Query) -> Query:
    out = {x | y for x in a for y in b}
    return _minimal(out) if len(out) <= MAX_CLAUSES else min(a, b, key=lambda q: (q == ANY, len(q)))


def _minimal(clauses) -> Query:
    return frozenset(x for x in clauses if not any(y < x for y in clauses))


def _of_strings(strings: set[str]) -> Query:
    return _minimal({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _class(items) -> set[str] | None:
    """The lower-case members of a character class, None if there are many."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(parts) -> tuple[set[str] | None, Query]:
    """(the exact strings, or None; the query of what isn't covered by them)."""
    exact: set[str] | None = {""}  # of the run since the last flush
    whole, clauses = True, ANY

    def flush() -> None:
        nonlocal exact, clauses, whole
        clauses, whole, exact = _and(clauses, _of_strings(exact)), False, {""}

    for op, arg in parts:
        more: set[str] | None = None
        inner: Query = ANY
        if op is C.LITERAL:
            more = {chr(arg).lower()}
        elif op is C.IN:
            more = _class(arg)
        elif op is C.SUBPATTERN:
            more, inner = _walk(arg[3])
        elif op is C.BRANCH:
            each = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in each):
                more = set().union(*(s for s, _ in each))
            else:
                inner = _minimal(set().union(*(_and(q, _of_strings(s)) if s is not None else q for s, q in each)))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            s, q = _walk(body)
            if s is not None and high == 1:
                more = s | {""} if low == 0 else s
            elif low:
                inner = q if s is None else _of_strings(s)
                if s is not None and len(s) == 1 and low > 1:
                    inner = _of_strings({next(iter(s)) * low})
        elif op is C.AT or op is C.ASSERT or op is C.ASSERT_NOT:
            more = {""}
        if more is not None and len(joined := {a + b for a in exact for b in more}) <= MAX_STRINGS:
            exact = joined
            continue
        flush()
        if more is not None and len(more) <= MAX_STRINGS:
            exact = set(more)
        clauses = _and(clauses, inner)
    if whole:
        return exact, ANY
    return None, _and(clauses, _of_strings(exact))


def query(pattern: str) -> Query:
    strings, clauses = _walk(_parser.parse(re.sub(r"^\(\?i\)", "", pattern)))
    return clauses if strings is None else _of_strings(strings)
