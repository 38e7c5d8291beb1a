"""Cheap conditions that a text must meet before a pattern can match it.

A pattern's parse tree tells literals of which any match holds one; a search for these in the lower-cased text costs a
small part of the pattern's. Where a tree tells none, there is no gate, so a gate never changes what matches.
"""

from __future__ import annotations

import re
from functools import lru_cache

_parser = re._parser  # the standard library's parser of patterns
_constants = re._constants
#: A gate of more literals costs more than it saves.
MOST = 160
#: Literals of fewer characters are in most texts.
LEAST = 2


def _product(heads: list[str], tails: list[str]) -> list[str] | None:
    return [h + t for h in heads for t in tails] if len(heads) * len(tails) <= 64 else None


def _exact(node) -> list[str] | None:
    """All strings that a part of a pattern can match, lower-cased, where these are few."""
    op, arg = node
    if op == _constants.LITERAL:
        return [chr(arg).lower()] if arg < 128 else None
    if op == _constants.IN:
        if all(o == _constants.LITERAL and a < 128 for o, a in arg) and len(arg) <= 4:
            return sorted({chr(a).lower() for _, a in arg})
        return None
    if op == _constants.SUBPATTERN:
        return _exact_all(arg[-1])
    if op == _constants.BRANCH:
        found = [_exact_all(x) for x in arg[1]]
        return None if any(x is None for x in found) else sorted({s for x in found for s in x})
    if op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and arg[1] <= 1:
        inner = _exact_all(arg[2])
        return None if inner is None else sorted({*inner, *([""] if arg[0] == 0 else [])})
    if op in (_constants.AT, _constants.ASSERT, _constants.ASSERT_NOT):
        return [""]
    return None


def _exact_all(nodes) -> list[str] | None:
    out: list[str] | None = [""]
    for node in nodes:
        part = _exact(node)
        out = None if part is None else _product(out, part)
        if out is None:
            return None
    return out


def _needed(nodes) -> list[list[str]]:
    """Sets of literals; a match of the sequence holds one of each set."""
    sets: list[list[str]] = []
    run: list[str] = [""]

    def end() -> None:
        nonlocal run
        if all(run):
            sets.append(run)
        run = [""]

    for node in nodes:
        op, arg = node
        part = _exact(node)
        joined = _product(run, part) if part is not None else None
        if joined is not None:
            run = joined
            continue
        end()
        if part is not None:
            run = part
        elif op == _constants.SUBPATTERN:
            sets += _needed(arg[-1])
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT, getattr(_constants, "POSSESSIVE_REPEAT", None)) and arg[0] >= 1:
            sets += _needed(arg[2])
        elif op == _constants.BRANCH:
            each = [_best(_needed(x)) for x in arg[1]]
            if all(each):
                sets.append(sorted({s for x in each for s in x}))
    end()
    return sets


def _minimal(literals: list[str]) -> list[str]:
    """Without those that hold another."""
    return [s for s in literals if not any(t != s and t in s for t in literals)]


def _best(sets: list[list[str]]) -> list[str] | None:
    """The set that holds of the fewest texts, by the length of its shortest literals and their number."""
    sets = [s for s in map(_minimal, sets) if s and len(s) <= MOST and min(map(len, s)) >= 1]
    return max(sets, key=lambda s: (min(min(map(len, s)), 4), -len(s))) if sets else None


@lru_cache(None)
def stems(pattern: str) -> tuple[str, ...] | None:
    """Lower-case literals of which any match of the pattern holds one, whatever its case; None where none are told."""
    found = _best(_needed(_parser.parse(re.sub(r"^\(\?[a-z]+\)", "", pattern))))
    return tuple(sorted(found)) if found and all(len(s) >= LEAST or not s.isalnum() for s in found) else None


def _is_digit(nodes) -> bool:
    (op, arg), *more = nodes
    return not more and op == _constants.IN and arg in ([(_constants.CATEGORY, _constants.CATEGORY_DIGIT)], [(_constants.RANGE, (48, 57))])


def _digits(nodes) -> int:
    found = [0]
    for op, arg in nodes:
        if op == _constants.SUBPATTERN:
            found.append(_digits(arg[-1]))
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and arg[0] >= 1:
            found.append(arg[0] if _is_digit(arg[2]) else _digits(arg[2]))
        elif op == _constants.BRANCH:
            found.append(min(map(_digits, arg[1])))
    return max(found)


@lru_cache(None)
def digits(pattern: str) -> int:
    """Digits that stand one after another in any match."""
    return _digits(_parser.parse(re.sub(r"^\(\?[a-z]+\)", "", pattern)))


def quoted(text: str) -> str:
    """A string as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Sieved(str):
    """The name of a lower-cased text beside which lies held: which of the literals stand in it (held_sql). Whether it
    holds one of them is asked of these few words and not of the text; other literals are looked for in the text."""

    def __new__(cls, low: str, held: str, literals: frozenset[str]):
        self = super().__new__(cls, low)
        self.held, self.literals = held, literals
        return self

    def knows(self, pattern: str) -> bool:
        """Whether held tells that the pattern cannot match."""
        found = stems(pattern)
        return bool(found) and self.literals.issuperset(found)


@lru_cache(None)
def literals(patterns: tuple[str, ...]) -> frozenset[str]:
    """All literals that the gates of patterns look for."""
    return frozenset(s for p in patterns for s in stems(p) or ())


#: Stands between the literals in held, and in none of them.
_APART = "\x01"


def _trie(words: set[str]) -> str:
    """A pattern for the longest of the words that stands at a place; each letter of a text is looked at once a place."""
    branches = []
    for first in sorted({w[0] for w in words if w}):
        rest = {w[1:] for w in words if w[:1] == first}
        branches.append((first if first.isalnum() else f"\\x{ord(first):02x}") + (_trie(rest) if rest != {""} else ""))
    if not branches:
        return ""
    return branches[0] if len(branches) == 1 and "" not in words else f"(?:{'|'.join(branches)})" + ("?" if "" in words else "")


@lru_cache(None)
def _any_of(words: frozenset[str]) -> str:
    return _trie(set(words))


def held_sql(low: str, words: frozenset[str]) -> str:
    """SQL for those of the words that stand in a text named low, found in one pass: at each place the longest, which
    holds the others of that place, so held contains a word just if the text does."""
    words = frozenset(w for w in words if _APART not in w)
    return f"array_join(array_distinct(regexp_extract_all({low}, {quoted(f'(?=({_any_of(words)}))')}, 1)), '{_APART}')" if words else f"substring({low}, 1, 0)"


def holds_none(low: Sieved, patterns: list[str]) -> str:
    """SQL for whether held tells of all these patterns that none can match."""
    return f"not rlike({low.held}, {quoted(_any_of(literals(tuple(patterns))))})"


def may_match(low: str, pattern: str) -> str | None:
    """SQL for whether the lower-cased text named low holds what the pattern needs; None where nothing is known."""
    if found := stems(pattern):
        held = low.held if isinstance(low, Sieved) and low.knows(pattern) else low
        return "(" + " or ".join(f"contains({held}, {quoted(s)})" for s in found) + ")"
    n = digits(pattern)
    return f"rlike({low}, '[0-9]{{{n}}}')" if n else None


def gated(text: str, pattern: str, flagged: str, low: str | None = None) -> str:
    """SQL for whether text (a column or a lambda's variable, by name) matches flagged, which is pattern with flags.

    low names the text in lower case; without it there is no gate. Expressions of hundreds of literals are written as
    SQL text, as that reaches Spark in one call.
    """
    gate = may_match(low, pattern) if low else None
    match = f"rlike({text}, {quoted(flagged)})"
    return f"({gate} and {match})" if gate else match
