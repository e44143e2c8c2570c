"""Boolean trigram queries from regular expressions.

A query is a disjunction of conjunctions: a list of trigram sets, of which a text
must hold all of at least one set. ``None`` stands for a rule without mandatory
trigrams. All trigrams are lower-case, so that they serve case-blind rules too.
"""

from __future__ import annotations

from re import _constants as sre
from re import _parser as parser

#: Alternatives beyond this number, or wider character classes, end a literal.
MAX_ALTERNATIVES = 64


def _literals(tree) -> list[list[str]]:
    """Alternatives, each a list of literal runs that every match contains in order."""
    found: list[list[str]] = [[""]]  # a run stays open at its end

    def cut(runs: list[str]) -> list[str]:
        return runs if runs[-1] == "" else [*runs, ""]

    def joined(a: list[str], b: list[str]) -> list[str]:
        return [*a[:-1], a[-1] + b[0], *b[1:]]

    for kind, arg in tree:
        if kind is sre.LITERAL:
            part = [[chr(arg).lower()]]
        elif kind is sre.IN and len(arg) <= 8 and all(k is sre.LITERAL for k, _ in arg):
            part = [[x] for x in sorted({chr(a).lower() for _, a in arg})]
        elif kind is sre.SUBPATTERN:
            part = _literals(arg[-1])
        elif kind is sre.BRANCH:
            part = [x for option in arg[1] for x in _literals(option)]
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            once = _literals(inner)
            if (low, high) == (0, 1):
                part = [[""], *once]
            elif low == 0:
                part = [["", ""]]
            else:
                part = once
                for _ in range(min(low, 3) - 1):
                    part = [joined(a, b) for a in part for b in once][: MAX_ALTERNATIVES + 1]
                if (low, high) != (min(low, 3),) * 2:
                    part = [cut(x) for x in part]
                    part = [x if len(x) > 1 else [*x, ""] for x in part]
        elif kind is sre.AT:
            part = [[""]]
        else:
            part = [["", ""]]
        crossed = [joined(a, b) for a in found for b in part]
        if len(crossed) > MAX_ALTERNATIVES:
            crossed = [cut(a) for a in found]
        found = crossed
    return found


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The query of a pattern, without clauses that another one implies."""
    clauses = {
        frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2))
        for runs in _literals(parser.parse(pattern))
    }
    if not clauses or frozenset() in clauses:
        return None
    least = [c for c in clauses if not any(other < c for other in clauses)]
    return sorted(least, key=sorted)
