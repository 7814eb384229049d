"""Records as plain text: the leaves of a JSON value, a line each."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Collection

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Levels that are followed; what lies deeper is an ellipsis.
DEPTH = 24


def leaves(value, depth: int = 0) -> str:
    """A string as it is; a mapping's key and value joined by an equals sign, or a line feed if the value has several lines."""
    if depth > DEPTH:
        return "..."
    if isinstance(value, dict):
        parts = ((k, leaves(v, depth + 1)) for k, v in value.items())
        return "\n".join(k + ("\n" if "\n" in text else " = ") + text for k, text in parts)
    if isinstance(value, list):
        return "\n".join(leaves(v, depth + 1) for v in value)
    if isinstance(value, bool):
        return "true" if value else "false"
    return "" if value is None else str(value)


def _one(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return leaves(json.loads(text))
    except (ValueError, RecursionError):
        return text


#: Letters that a search without case takes for a plain one, in UTF-8, and the plain ones.
_FOLDED = {"\u0130": b"i", "\u0131": b"i", "\u017f": b"s", "\u212a": b"k"}
#: The same and plain ones, written as numbers.
_NUMBERED = re.compile(rb"\\u(00[2-7]|013[01]|017f|212a)")


def grouped(words: Collection[str]) -> dict[str, list[str]]:
    """Words by a part that they share: a sign or the shortest word in them. Texts without the part hold none of its words."""
    out: dict[str, list[str]] = {}
    for w in sorted(words):
        out.setdefault(min((k for k in ("_", "@", "-", *words) if k in w), key=len), []).append(w)
    return out


def held(text: str, groups: dict[str, list[str]]) -> list[str]:
    """The words that the JSON of a record may hold; one that writes plain letters as numbers may hold any."""
    data = text.encode("utf-8", "replace").lower()
    if not text.isascii():
        for letter, plain in _FOLDED.items():
            data = data.replace(letter.encode(), plain)
    if b"\\u" in data and _NUMBERED.search(data):
        return [w for ws in groups.values() for w in ws]
    # a character a byte is searched fastest
    data = data.decode("latin-1")
    return [w for part, ws in groups.items() if part in data for w in ws if w in data]


def text_views(words: Collection[str] | None):
    """Of the JSON of a payload and of a raw record: their leaves, and which words in lower case the two may hold. A record that
    holds none isn't taken apart. Without words all are, and their list is null. Recursion of any shape has no built-in function."""
    searched = None if words is None else grouped(words)

    def one(payload: str | None, raw: str | None) -> tuple:
        if searched is None:
            return _one(payload), _one(raw), None
        found = held(f"{payload or ''}\n{raw or ''}", searched)
        return (_one(payload), _one(raw), found) if found else (None, None, found)

    @pandas_udf("payload string, raw string, words array<string>")
    def views(payloads: pd.Series, raws: pd.Series) -> pd.DataFrame:
        # None and not NaN for what is absent
        rows = [one(p if isinstance(p, str) else None, r if isinstance(r, str) else None) for p, r in zip(payloads, raws)]
        return pd.DataFrame(rows, columns=["payload", "raw", "words"], dtype=object)

    return views


def _sorted(text: str | None, **options) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, **options)
    except (ValueError, RecursionError):
        return None


@pandas_udf(StringType())
def canonical(values: pd.Series) -> pd.Series:
    """JSON with sorted keys, numbers and Unicode as they are; null for what isn't JSON. VARIANT would rewrite numbers."""
    return values.map(lambda v: _sorted(v, ensure_ascii=False), na_action="ignore")


def _custody_hash(text: str | None) -> str | None:
    try:
        record = json.loads(text)
        record.pop("sha256", None)
    except (AttributeError, TypeError, ValueError):
        return None
    return hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@pandas_udf(StringType())
def custody_hash(values: pd.Series) -> pd.Series:
    """The SHA-256 of a custody record without its own hash, as compact JSON with sorted keys."""
    return values.map(_custody_hash, na_action="ignore")
