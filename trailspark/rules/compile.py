"""Conditions of rules as Columns.

A condition is {"all" | "any" | "none": [conditions]} or {"field": selector, operator: value}, with ignore_case beside
the operator if need be. A selector names a column (`text` is payload.text, `provenance.sha256` the file's hash), a path
in the payload or the raw record, or a text view. `[]` fans out; a list without it is read through. What is absent is an
empty list, never null, so every leaf is true or false.

Columns of conditions read what `prepared` adds: the payload and the raw record parsed once, and the text views, which
are their leaves line by line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions.flatten import text_views
from trailspark.functions.text import glob_regex
from trailspark.rules import literals
from trailspark.schema import EVENT_COLUMNS

#: DOTALL, Unicode classes, and $ and ^ that see line feeds only.
JAVA_FLAGS = "(?sUd)"
TEXT_VIEWS = ("payload_text", "raw_text", "event_text")
PROVENANCE = {"bundle_uuid": "bundle_uuid", "original_path": "original_path", "sha256": "file_sha256", "artifact_id": "artifact_id", "locator": "locator"}
_STEP = r"[A-Za-z_][A-Za-z0-9_-]*(\[\])?"
_SELECTOR = re.compile(rf"^(payload|raw)(\.{_STEP})*$")


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    return ("(?iu)" if ignore_case else "") + JAVA_FLAGS + re.sub(r"\\Z", r"\\z", pattern)


def every_leaf(tree: dict) -> list[tuple[str, str, object]]:
    """(field, operator, value) of all leaves, whatever group they stand in."""
    found = [x for k in GROUPS for t in tree.get(k, []) for x in every_leaf(t)]
    return found + [(tree["field"], k, v) for k, v in tree.items() if "field" in tree and k not in ("field", *GROUPS, *MODIFIERS)]


def words_of(trees: list[dict]) -> frozenset[str] | None:
    """Words of which a record's text holds one if any test of a text view holds; None if a test may hold without."""
    found = [literals.of_leaf(k, v) for t in trees for f, k, v in every_leaf(t) if f in TEXT_VIEWS]
    return None if any(f is None for f in found) else frozenset().union(*found)


def may_hold(words: frozenset[str]) -> Column:
    """Whether a record may hold one of the words, as found once a row; true where nobody looked."""
    return F.coalesce(F.arrays_overlap("_words", F.array(*[F.lit(w) for w in sorted(words)])), F.lit(True))


def prepared(events: DataFrame, fields: set[str], trees: list[dict] | None = None) -> DataFrame:
    """events with the columns that these selectors read, each made once a row."""
    out = events
    for c in ("payload_json", "raw_json"):
        if c not in events.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    parsed = {f"_{r}": F.try_parse_json(f"{r}_json") for r in ("payload", "raw") if any(f == "text" or re.split(r"[.]", f)[0] == r for f in fields)}
    if "text" in fields:
        parsed["_payload"] = F.try_parse_json("payload_json")
    if fields & set(TEXT_VIEWS):
        # a text without the words that all its tests need is as good as none: it isn't flattened
        words = words_of(trees) if trees else None
        out = out.withColumn("_views", text_views(words)("payload_json", "raw_json"))
        parsed |= {"_payload_text": F.col("_views.payload"), "_raw_text": F.col("_views.raw"), "_words": F.col("_views.words")}
        whole = F.concat(F.coalesce("_views.payload", F.lit("")), F.lit("\n"), F.coalesce("_views.raw", F.lit("")))
        parsed |= {"_event_text": whole} if "event_text" in fields else {}
        parsed |= {"_may_hold": F.size("_views.words") > 0} if words is not None else {}
        return out.withColumns(parsed).drop("_views")
    return out.withColumns(parsed) if parsed else out


def is_list(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), F.lit(False))


def _items(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def _present(values: str) -> str:
    return f"filter({values}, p -> p IS NOT NULL AND NOT coalesce(is_variant_null(p), true))"


def _walk(values: str, step: str) -> str:
    """The values at one step from an array of VARIANTs; a list on the way is read through."""
    name, fan = step.removesuffix("[]"), step.endswith("[]")
    get = lambda v: f"try_variant_get({v}, '$[\\'{name}\\']', 'variant')"
    listed = lambda v: f"coalesce(startswith(schema_of_variant({v}), 'ARRAY'), false)"
    items = lambda v: f"coalesce(try_variant_get({v}, '$', 'array<variant>'), CAST(array() AS array<variant>))"
    through = _present(f"transform({items('v')}, i -> {get('i')})")
    # what is read through a list stays together, as a list, unless the step fans out
    if fan:
        spread = f"flatten(transform({_present(f'array({get("v")})')}, g -> CASE WHEN {listed('g')} THEN {_present(items('g'))} ELSE array(g) END))"
        return f"flatten(transform({values}, v -> CASE WHEN {listed('v')} THEN {through} ELSE {spread} END))"
    return _present(f"transform({values}, v -> CASE WHEN {listed('v')} THEN CASE WHEN size({through}) > 0 THEN to_variant_object({through}) END ELSE {get('v')} END)")


def values_at(selector: str) -> Column:
    """array<variant> of the values at a path in the payload or the raw record, written as SQL: one text, not a call for each part."""
    root, *steps = selector.split(".")
    found = _present(f"array(_{root})")
    for step in steps:
        found = _walk(found, step)
    return F.expr(found)


def resolve(selector: str) -> Column:
    """array<string> of the values at a selector: strings as they are, other values as JSON."""
    selector = "payload.text" if selector == "text" else selector
    if selector == "event_text":
        return F.array("_event_text")
    if selector in TEXT_VIEWS:
        return F.array(F.coalesce(f"_{selector}", F.lit("")))
    if selector.startswith("provenance.") and selector[11:] in PROVENANCE:
        selector = PROVENANCE[selector[11:]]
    if selector in EVENT_COLUMNS:
        return F.array_compact(F.array(F.col(selector)))
    if not _SELECTOR.match(selector):
        raise ValueError(f"not a selector: {selector}")
    if re.fullmatch(r"(payload|raw)(\.[A-Za-z_][A-Za-z0-9_]*)", selector):
        # one plain key, as most rules have
        value = F.try_variant_get(f"_{selector.split('.')[0]}", f"$.{selector.split('.')[1]}", "string")
        return F.array_compact(F.array(value))
    return F.transform(values_at(selector), lambda v: F.try_variant_get(v, "$", "string"))


def _any(values: Column, test) -> Column:
    return F.coalesce(F.exists(values, lambda v: F.coalesce(test(v), F.lit(False))), F.lit(False))


def _number(v: Column) -> Column:
    return F.trim(v).try_cast("double")


def length_of(selector: str) -> Column:
    """array<int> of the lengths at a selector: characters of a text, members of a list or an object."""
    selector = "payload.text" if selector == "text" else selector
    if not _SELECTOR.match(selector):
        return F.transform(resolve(selector), lambda v: F.char_length(v))
    text = lambda v: F.char_length(F.try_variant_get(v, "$", "string"))
    members = lambda v: F.size(F.map_keys(F.try_variant_get(v, "$", "map<string, variant>")))
    return F.transform(values_at(selector), lambda v: F.when(is_list(v), F.size(_items(v))).otherwise(F.coalesce(members(v), text(v))))


def _folded(test):
    return lambda v, x, i: test(F.lower(v), F.lit(x.lower())) if i else test(v, F.lit(x))


#: Tests of a text by name: value, wanted, whether case is ignored.
TEXT = {
    "regex": lambda v, x, i: F.rlike(v, F.lit(java_regex(x, i))),
    "contains": _folded(F.contains),
    "equals": _folded(lambda v, x: v == x),
    "startswith": _folded(F.startswith),
    "endswith": _folded(F.endswith),
    "glob": lambda v, x, i: F.rlike(v, F.lit(glob_regex(x))),
}
#: Tests that compare lower-cased texts if case is ignored.
FOLDING = ("contains", "equals", "startswith", "endswith")
NUMBERS = {
    "gt": lambda v, x: _number(v) > x,
    "gte": lambda v, x: _number(v) >= x,
    "lt": lambda v, x: _number(v) < x,
    "lte": lambda v, x: _number(v) <= x,
}
LENGTHS = {"length_gt": lambda n, x: n > x, "length_gte": lambda n, x: n >= x, "length_lt": lambda n, x: n < x}
MODIFIERS = ("ignore_case",)
GROUPS = ("all", "any", "none")


def test_of(operator: str, value, ignore_case: bool | None = None):
    """The test of a text operator for one value, or None; words are compared without case unless told otherwise, patterns and globs aren't."""
    name = operator.removesuffix("_any")
    if name not in TEXT:
        return None
    folded = ignore_case if ignore_case is not None else name not in ("regex", "glob")
    wanted = value if operator.endswith("_any") else [value]

    def one_of(v: Column, folded: bool, texts: list[str]) -> Column:
        out = F.lit(False)
        for x in texts:
            out = out | F.coalesce(TEXT[name](v, x, folded), F.lit(False))
        return out

    if folded and name in FOLDING:
        # the value is folded once, however many texts it is compared with
        return lambda v: F.exists(F.array(F.lower(v)), lambda low: one_of(low, False, [x.lower() for x in wanted]))
    return lambda v: one_of(v, folded, wanted)


def within_words(field: str, operator: str, value, found: Column, otherwise: Column) -> Column:
    """What a leaf finds in a text view; otherwise where the text holds none of the words that it needs: they are looked up once a row."""
    words = literals.of_leaf(operator, value) if field in TEXT_VIEWS else None
    return found if words is None else F.when(may_hold(words), found).otherwise(otherwise)


def leaf(field: str, operator: str, value, ignore_case: bool | None = None) -> Column:
    if operator in LENGTHS:
        return _any(length_of(field), lambda n: LENGTHS[operator](n, value))
    values = resolve(field)
    if operator == "exists":
        return (F.size(values) > 0) == bool(value)
    if operator == "count_gte":
        return F.size(values) >= value
    if operator in NUMBERS:
        return _any(values, lambda v: NUMBERS[operator](v, value))
    return within_words(field, operator, value, _any(values, test_of(operator, value, ignore_case)), F.lit(False))


def check(tree, at: str = "match") -> None:
    """Raise ValueError for what a condition may not say."""
    if not isinstance(tree, dict):
        raise ValueError(f"{at}: not a mapping")
    groups = [k for k in GROUPS if k in tree]
    if groups:
        if len(tree) > 1 or not isinstance(tree[groups[0]], list) or not tree[groups[0]]:
            raise ValueError(f"{at}: a group holds one of {GROUPS}, with a list of conditions")
        for i, part in enumerate(tree[groups[0]]):
            check(part, f"{at}.{groups[0]}[{i}]")
        return
    operators = [k for k in tree if k not in ("field", *MODIFIERS)]
    if len(operators) != 1 or not isinstance(tree.get("field"), str):
        raise ValueError(f"{at}: a leaf needs a field and one operator, not {sorted(tree)}")
    operator, value = operators[0], tree[operators[0]]
    name = operator.removesuffix("_any")
    known = tree["field"] in (*TEXT_VIEWS, *EVENT_COLUMNS, "text") or tree["field"].removeprefix("provenance.") in PROVENANCE or _SELECTOR.match(tree["field"])
    if not known:
        raise ValueError(f"{at}: not a selector: {tree['field']}")
    if operator == "exists" and not isinstance(value, bool):
        raise ValueError(f"{at}: exists is true or false")
    if operator in NUMBERS or operator in LENGTHS or operator == "count_gte":
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError(f"{at}: {operator} takes a number")
    elif name in TEXT:
        wanted = value if operator.endswith("_any") else [value]
        if not isinstance(wanted, list) or not wanted or not all(isinstance(x, str) for x in wanted):
            raise ValueError(f"{at}: {operator} takes text")
        if name == "regex":
            for x in wanted:
                try:
                    re.compile(x)
                except re.error as e:
                    raise ValueError(f"{at}: {e}") from e
    elif operator != "exists":
        raise ValueError(f"{at}: unknown operator {operator}")


def condition(tree: dict) -> Column:
    out = F.lit(True)
    for key, value in tree.items():
        if key in ("all", "any", "none"):
            parts = [condition(t) for t in value]
            joined = F.lit(key == "all")
            for p in parts:
                joined = (joined & p) if key == "all" else (joined | p)
            out = out & (~joined if key == "none" else joined)
        elif key not in ("field", *MODIFIERS):
            out = out & leaf(tree["field"], key, value, tree.get("ignore_case"))
    return out


def leaves(tree: dict) -> list[tuple[str, str, object, bool | None]]:
    """(field, operator, value, ignore_case) of all leaves that state something, those under none left out."""
    found = [x for k in ("all", "any") for t in tree.get(k, []) for x in leaves(t)]
    return found + [(tree["field"], k, v, tree.get("ignore_case")) for k, v in tree.items() if "field" in tree and k not in ("field", *GROUPS, *MODIFIERS)]


def fields(tree: dict) -> set[str]:
    """The selectors of a condition."""
    return {f for k in GROUPS for t in tree.get(k, []) for f in fields(t)} | ({tree["field"]} if "field" in tree else set())
