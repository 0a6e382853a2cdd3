"""Keywords of regular expressions: sets of literals, of each of which every match holds at least one.

`cuts(pattern)` walks the parsed pattern. A run of literals is a keyword; each
part of a sequence gives a set of its own, a choice joins the sets of its
branches. The best set is the one whose shortest keyword is longest. All in
lower case.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from re import _constants as C
from re import _parser

Keywords = frozenset[str]


MOST = 16


def _choices(parts, accept: Callable[[str], bool]) -> list[Keywords]:
    """Every set of keywords that one part of a sequence gives on its own."""
    out: list[Keywords] = []
    run = {""}

    def close() -> None:
        nonlocal run
        if run != {""}:
            out.append(frozenset(run))
        run = {""}

    for op, arg in parts:
        if op in (C.ASSERT, C.ASSERT_NOT, C.AT):
            continue
        few: set[str] = set()  # all that this part can be, if it is one of a few characters
        if op is C.LITERAL:
            few = {chr(arg).lower()}
        elif op is C.IN and all(kind is C.LITERAL for kind, _ in arg):
            few = {chr(c).lower() for _, c in arg}
        if few and len(run) * len(few) <= MOST:
            run = {a + b for a in run for b in few}
            continue
        close()
        if op is C.SUBPATTERN:
            out += _choices(arg[3], accept)
        elif op is C.BRANCH:
            best = [_best(_choices(branch, accept), accept) for branch in arg[1]]
            if all(best):
                out.append(frozenset().union(*best))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0]:
            out += _choices(arg[2], accept)
        elif few:
            out.append(frozenset(few))
    close()
    return out


def _best(found: list[Keywords], accept: Callable[[str], bool]) -> Keywords:
    found = [x for x in found if all(map(accept, x))]
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=frozenset())


def _plain(pattern: str) -> str:
    """Without lookbehinds of a range, which Python's parser doesn't know."""
    return re.sub(r"\(\?<=.*?\{0,\d+\}\)", "", pattern)


def cuts(pattern: str, least: int = 3) -> list[Keywords]:
    """All sets of keywords of at least `least` letters, the best first; without any, nothing can be ruled out."""
    found = {x for x in _choices(_parser.parse(_plain(pattern)), bool) if min(map(len, x)) >= least}
    return sorted(found, key=lambda x: (-min(map(len, x)), len(x), sorted(x)))


def keywords(pattern: str, accept: Callable[[str], bool] = bool) -> Keywords:
    """The best keywords of a pattern that `accept` allows; empty if there are none."""
    return _best(_choices(_parser.parse(_plain(pattern)), accept), accept)
