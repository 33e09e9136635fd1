"""Literal factors of regular expressions: text that every match must contain.

A pattern's parse tree gives *clauses*, sets of literals of which every match
holds at least one: a run of plain characters is a clause of one literal, a
repetition counts if it occurs at least once, and an alternation gives one
clause if each branch has one.  A pattern is then found only in texts that hold
one q-gram of each literal of a clause, whichever q-gram and clause are chosen.

Everything is compared with ASCII letters in lower case.  Under a
case-insensitive flag the letters i, k and s are not used, since non-ASCII
letters fold to them, and other letters are.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from re import IGNORECASE, _constants, _parser  # the parse tree of Python's own patterns

Q = 3  # least characters of an index key
LENGTHS = (3, 5, 8)  # of index keys; a literal has keys of the greatest length it holds


def _lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def _usable(char: str, folded: bool) -> bool:
    return " " <= char <= "~" and not (folded and char in "iksIKS") or char in "\t\n"


def _clauses(tree, folded: bool) -> list[frozenset[str]]:
    out, run = [], []

    def flush():
        if run:
            out.append(frozenset(["".join(run)]))
            run.clear()

    for op, arg in tree:
        if op is _constants.LITERAL and _usable(chr(arg), folded):
            run.append(chr(arg))
            continue
        flush()
        if op is _constants.SUBPATTERN:
            _, added, removed, inner = arg
            out += _clauses(inner, bool((folded or added & IGNORECASE) and not removed & IGNORECASE))
        elif op is _constants.ATOMIC_GROUP:
            out += _clauses(arg, folded)
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT) and arg[0] >= 1:  # not sent to the tasks as values
            out += _clauses(arg[2], folded)
        elif op is _constants.BRANCH:
            best = [max(_long(_clauses(branch, folded)), key=_strength, default=None) for branch in arg[1]]
            if all(best):
                out.append(frozenset().union(*best))
    flush()
    return out


def _strength(clause: frozenset[str]) -> tuple[int, int]:
    return min(map(len, clause)), -len(clause)


def _long(clauses):
    return [c for c in clauses if min(map(len, c)) >= Q]


def required_clauses(pattern: str, ignore_case: bool = False) -> list[frozenset[str]]:
    """Clauses of literals of at least ``Q`` characters; none if the pattern
    has no such literal or is no Python pattern."""
    try:
        tree = _parser.parse(pattern)
    except Exception:  # the JVM may accept what Python does not: no factors then
        return []
    return _long(_clauses(tree, ignore_case or bool(tree.state.flags & IGNORECASE)))


@dataclass(frozen=True)
class Factors:
    """Index keys of one pattern; a text without any of them has no match.
    ``literal`` must stand in the text as it is, if not empty."""

    keys: tuple[str, ...]
    literal: str


def grams(literal: str) -> set[str]:
    """The q-grams of a literal, of the greatest of ``LENGTHS`` it holds."""
    q = max(n for n in LENGTHS if n <= len(literal))
    return {_lower(literal)[i:i + q] for i in range(len(literal) - q + 1)}


def exact_literal(pattern: str, clauses: list[frozenset[str]], ignore_case: bool = False) -> str:
    """The longest literal that every text with a match holds as it is, or ''."""
    singles = [s for c in clauses if len(c) == 1 for s in c]
    return max(singles, key=len, default="") if not ignore_case and "(?" not in pattern else ""


def index_keys(patterns: list[str], ignore_case: bool = False) -> list[Factors]:
    """For every pattern its rarest keys: of each literal the q-gram that the
    fewest patterns contain, of all clauses the one with the fewest such
    patterns.  A pattern without a clause has no keys."""
    clauses = [required_clauses(p, ignore_case) for p in patterns]
    users = Counter(g for cs in clauses for g in set().union(*(grams(s) for c in cs for s in c)))
    out = []
    for pattern, cs in zip(patterns, clauses):
        choices = []
        for c in cs:
            keys = sorted({min(grams(s), key=lambda g: (users[g], g)) for s in c})
            choices.append((sum(users[k] for k in keys), len(keys), keys))
        out.append(Factors(tuple(min(choices)[2]) if choices else (), exact_literal(pattern, cs, ignore_case)))
    return out
