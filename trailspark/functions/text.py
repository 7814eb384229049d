"""Functions of text: commands, hosts, paths, hidden characters, globs and times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in their usual order: zero-width characters and joiners, marks and isolates that reorder text, the soft hyphen.
HIDDEN = (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069, 0x00AD)
#: The first and last tag character, which are invisible and can spell ASCII.
TAGS = (0xE0000, 0xE007F)
#: A character class of both, for Java and Python.
HIDDEN_CLASS = "".join(map(chr, HIDDEN)) + "-".join(map(chr, TAGS))


def first_word(command: Column) -> Column:
    """The first word that isn't an assignment before a command; null if there is none."""
    words = F.filter(F.split(F.trim(command), r"\s+"), lambda w: (w != "") & ~F.rlike(w, F.lit(r"^[A-Za-z_][A-Za-z0-9_]*=")))
    return F.get(words, F.lit(0))


def host_of(url: Column) -> Column:
    """The host of a URL, lower-cased, without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def hidden_characters(text: Column) -> Column:
    """array<struct<code, n>> of the hidden characters that a text holds, by code point; tag characters count as their first one."""
    tag = "-".join(map(chr, TAGS))
    # the few characters that are left are counted, not the text's own
    only = F.regexp_replace(text, F.lit(f"[^{HIDDEN_CLASS}]+"), F.lit(""))
    less = lambda t, c: F.char_length(t) - F.char_length(F.translate(t, chr(c), ""))
    tags = lambda t: F.char_length(t) - F.char_length(F.regexp_replace(t, F.lit(f"[{tag}]"), F.lit("")))
    number = lambda code, n: F.struct(F.lit(code).alias("code"), n.cast("int").alias("n"))
    every = lambda t: F.array(*[number(c, less(t, c)) for c in sorted(HIDDEN)], number(TAGS[0], tags(t)))
    counted = F.filter(_let(only, every), lambda x: x["n"] > 0)
    none = F.array().cast("array<struct<code: int, n: int>>")
    # most texts hold none, and one search says so
    return F.when(text.isNull(), F.lit(None)).when(F.rlike(text, F.lit(f"[{HIDDEN_CLASS}]")), counted).otherwise(none)


def uri_as_path(uri: Column) -> Column:
    """The path of a file: URI, decoded; a plus sign stays one. Other text is returned as it is."""
    path = F.try_url_decode(F.replace(F.regexp_replace(uri, r"^file://[^/]*", ""), F.lit("+"), F.lit("%2B")))
    drive = F.regexp_replace(path, r"^/([A-Za-z]:)", "$1")
    return F.when(F.startswith(uri, F.lit("file://")), F.coalesce(drive, uri)).otherwise(uri)


def relative_path(path: Column, folder: Column) -> Column:
    inside = F.startswith(path, F.concat(folder, F.lit("/")))
    return F.when(inside, F.substr(path, F.char_length(folder) + 2)).otherwise(path)


_GLOB_TOKEN = re.compile(r"\*\*|[*?/\\]|[^*?/\\]+")
_GLOB_MEANING = {"**": ".*", "*": r"[^/\\]*", "?": r"[^/\\]", "/": r"[/\\]", "\\": r"[/\\]"}


def glob_regex(glob: str) -> str:
    """A Java pattern for a glob: * within a segment, ** across, ?, either separator, no case, the whole text."""
    return r"(?is)\A" + "".join(_GLOB_MEANING.get(t) or re.escape(t) for t in _GLOB_TOKEN.findall(glob)) + r"\z"


def literal_length(glob: str) -> int:
    return len(re.sub(r"[*?]", "", glob))


#: Seconds of the first and last moment with a year of four digits.
_EPOCH_RANGE = (-62_135_596_800, 253_402_300_799)


def normalise_ts(value: Column) -> Column:
    """struct<ts_utc, ts_precision, note> of a time written as ISO 8601 or as a number of seconds or milliseconds.

    A time without a zone is read as UTC and noted, and so is the unit of a number; zero, numbers beyond the years 1
    to 9999 and what can't be read give absent. Whole seconds claim no more than seconds, in either unit. The
    session's time zone has to be UTC.
    """
    text = F.trim(value.cast("string"))
    parts = [F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(?::(\d{2}))?(?:\.(\d{1,9}))?(Z|[+-]\d{2}:?\d{2})?$", i) for i in range(1, 6)]
    day, minute, second, fraction, zone = parts
    digits = F.rpad(F.substring(fraction, 1, 6), 6, "0")
    offset = F.when(zone.isin("", "Z"), F.lit("+00:00")).otherwise(F.regexp_replace(zone, r"^([+-]\d{2}):?(\d{2})$", "$1:$2"))
    iso = F.try_to_timestamp(F.concat(day, F.lit("T"), minute, F.lit(":"), F.when(second == "", "00").otherwise(second), F.lit("."), digits, offset), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    number = F.when(F.rlike(text, F.lit(r"^-?\d+(\.\d+)?$")), text.try_cast("decimal(38,9)"))
    millis = F.abs(number) > F.lit(100_000_000_000)
    seconds = F.when(millis, number / 1000).otherwise(number)
    inside = (seconds >= _EPOCH_RANGE[0]) & (seconds <= _EPOCH_RANGE[1])
    epoch = F.timestamp_micros(F.when(inside, F.round(seconds * 1_000_000)).cast("long"))
    shown = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    none = F.lit(None).cast("string")
    make = lambda ts, precision, note: F.struct(ts.alias("ts_utc"), precision.alias("ts_precision"), note.alias("note"))
    precision = F.when(second == "", "minute").when(fraction == "", "second").otherwise("exact")
    digits_only = F.rlike(text, F.lit(r"^-?\d+(\.\d+)?$"))
    unit = F.when(millis, "read as epoch milliseconds").otherwise("read as epoch seconds")
    return (
        F.when(number == 0, make(none, F.lit("absent"), F.lit("zero is no time")))
        .when(inside, make(shown(epoch), F.when(seconds == F.floor(seconds), "second").otherwise("exact"), unit))
        .when(digits_only, make(none, F.lit("absent"), F.lit("a number beyond the range of times")))
        .when(iso.isNotNull(), make(shown(iso), precision, F.when(zone == "", F.lit("no zone, read as UTC"))))
        .otherwise(make(none, F.lit("absent"), F.when(F.coalesce(text, F.lit("")) != "", F.lit("not a time"))))
    )


def remote_uri(uri: Column) -> Column:
    """Whether a URI names a file elsewhere: another scheme than file, or a file on a named host."""
    scheme, host = F.lower(F.regexp_extract(uri, "^([A-Za-z][A-Za-z0-9+.-]+):", 1)), F.lower(F.regexp_extract(uri, "^file://([^/]*)", 1))
    return F.coalesce(~scheme.isin("", "file") | ~host.isin("", "localhost"), F.lit(False))


#: The keys of a message body, in the order they are looked for.
TEXT_KEYS = ("text", "thinking", "content", "display", "message")


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(value: Column, depth: int = 5) -> Column:
    """The text of a message body as a VARIANT: a string, a list of bodies on lines of their own, or an object's first text key.

    Bodies nested deeper than `depth` come out as JSON, and so do objects without a text key.
    """

    def inner(v: Column, left: int) -> Column:
        said = F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
        if left == 0:
            return said
        found = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "variant") for k in TEXT_KEYS])
        listed = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: ~F.is_variant_null(x))
        # one level down for both, so that the expression grows with the depth and not with its power
        below = F.when(_is(v, "ARRAY"), listed).when(_is(v, "OBJECT") & found.isNotNull(), F.array(found))
        joined = F.array_join(F.transform(below, lambda x: inner(x, left - 1)), "\n")
        return F.when(v.isNull() | F.is_variant_null(v), F.lit("")).otherwise(F.coalesce(joined, said))

    return _let(value, lambda v: inner(v, depth))


def number_of(value: Column) -> Column:
    """A VARIANT as a number; strings of a number count, booleans don't."""
    return F.when(~_is(value, "BOOLEAN"), F.trim(F.try_variant_get(value, "$", "string")).try_cast("double"))


def decode_segments(path: Column) -> Column:
    """A path with %XX decoded segment by segment; a segment that isn't validly encoded stays as it is."""
    one = lambda s: F.when(F.rlike(s, F.lit("^([^%]|%[0-9A-Fa-f]{2})*$")), F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)).otherwise(s)
    return F.array_join(F.transform(F.split(path, "/"), one), "/")


def fish_unescape(text: Column) -> Column:
    """A command of a fish history: \\n is a line feed and two backslashes are one, in a single pass."""
    mark = "\uE000"
    held = F.replace(text, F.lit("\\\\"), F.lit(mark))
    return F.replace(F.replace(held, F.lit("\\n"), F.lit("\n")), F.lit(mark), F.lit("\\"))


def project_of(path: Column, roots: Column) -> Column:
    """The first of the roots (array) that a path lies below, as it is written; null if none. Either separator and case count alike."""
    folded = lambda p: F.lower(F.translate(p, "\\", "/"))
    below = lambda r: (F.rtrim(folded(r), F.lit("/")) != "") & F.startswith(folded(path), F.concat(F.rtrim(folded(r), F.lit("/")), F.lit("/")))
    return F.get(F.filter(roots, below), F.lit(0))


def user_from_path(path: Column) -> Column:
    """The user whose home a path lies in; null if it lies in none."""
    plain = F.translate(path, "\\", "/")
    name = F.regexp_extract(plain, r"(?i)^(?:[a-z]:)?/(?:Users|home|var/home)/([^/]+)(?:/|$)", 1)
    return F.when(F.rlike(plain, F.lit("^/root(/|$)")), "root").when((name != "") & ~F.lower(name).isin("public", "shared", "default"), name)


def project_from_folder(name: Column) -> Column:
    """A path from a folder name in which separators became dashes; dashes of the path itself can't be told apart."""
    return F.when(F.rlike(name, F.lit("^[A-Za-z]--")), F.concat(F.substring(name, 1, 1), F.lit(":/"), F.replace(F.substring(name, 4, 1 << 20), F.lit("-"), F.lit("/")))).otherwise(F.replace(name, F.lit("-"), F.lit("/")))
