"""Words without which a rule's texts can't match: a cheap test of the raw record before it is flattened and searched.

A pattern is taken apart by Python's own parser. Of a sequence its longest word counts, of alternatives each one's. Words hold
letters, underscores, hyphens and @ only, which JSON writes as they are and which no two leaves of a record share.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser as parser

#: Letters that a word may have, and the fewest of them, but for a word with an @.
LETTERS, LEAST = re.compile(r"[A-Za-z_@-]"), 3
_WORD = re.compile(r"[A-Za-z_@-]+")
_REPEATS = (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT)


def _good(word: str) -> bool:
    return len(word) >= LEAST or "@" in word


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two sets of alternatives the one whose shortest word is longer."""
    if a is None or b is None:
        return a if b is None else b
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


#: Spellings of a word that has a choice of letters in it.
SPELLINGS = 64


def _letters(op, value) -> list[str] | None:
    """The letters that an element stands for, if it is one of a few."""
    if op is sre.LITERAL and LETTERS.match(chr(value)):
        return [chr(value)]
    if op is sre.IN and all(o is sre.LITERAL and LETTERS.match(chr(v)) for o, v in value):
        return [chr(v) for _, v in value]
    return None


def _needed(tree) -> frozenset[str] | None:
    best, words = None, {""}
    for op, value in [*tree, (None, None)]:
        letters = _letters(op, value)
        if letters and len(words) * len(letters) <= SPELLINGS:
            words = {w + c for w in words for c in letters}
            continue
        if all(map(_good, words)):
            best = _better(best, frozenset(w.lower() for w in words))
        words, found = set(letters or [""]), None
        if op is sre.SUBPATTERN:
            found = _needed(value[-1])
        elif op is sre.ATOMIC_GROUP:
            found = _needed(value)
        elif op is sre.BRANCH:
            parts = [_needed(p) for p in value[1]]
            found = frozenset().union(*parts) if all(p is not None for p in parts) else None
        elif op in _REPEATS and value[0] > 0:
            found = _needed(value[2])
        best = _better(best, found)
    return best


def of_pattern(pattern: str) -> frozenset[str] | None:
    """Words of which a match of the pattern holds one, in lower case; None if it may match without any."""
    return _needed(parser.parse(pattern))


def of_text(text: str) -> frozenset[str] | None:
    """The same for a text that is searched as it is."""
    words = [w.lower() for w in _WORD.findall(text) if _good(w)]
    return frozenset([max(words, key=len)]) if words else None


def of_leaf(operator: str, value) -> frozenset[str] | None:
    """The same for a leaf of a condition; None for tests that say something of a text without a match."""
    name = operator.removesuffix("_any")
    make = of_pattern if name == "regex" else of_text if name in ("contains", "equals", "startswith", "endswith") else None
    found = [make(x) for x in (value if operator.endswith("_any") else [value])] if make else [None]
    return None if any(f is None for f in found) else frozenset().union(*found)
