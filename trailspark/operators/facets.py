"""Facets: child tables of events, from arrays in the payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions.text import first_word

#: The facets, their fields, their keys and what stands in for a missing key.
FACETS = {
    "files": ("path string, operation string, bytes bigint", ("path", "operation"), {"operation": "unknown"}),
    "commands": ("command string, executable string, cwd string, exit_code int", ("command",), {}),
    "network": ("host string, url string, method string", ("host", "url"), {"url": ""}),
    "mcp": ("server string, tool string", ("server", "tool"), {"tool": ""}),
    "models": ("model string, input_tokens bigint, output_tokens bigint, cost double", ("model",), {}),
    "permissions": ("mode string, decision string, subject string", ("mode", "decision", "subject"), {"decision": "unknown"}),
    "instructions": ("path string, scope string", ("path", "scope"), {"scope": "unknown"}),
}


def _objects(name: str, fields: list[tuple[str, str]]) -> Column:
    """array<struct> of a facet's objects: one object is a list of one, a text names a path, and a text in a list is every key."""
    value = F.try_variant_get(F.try_parse_json("payload_json"), f"$.{name}", "variant")
    shape = lambda v, kind: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))
    text = lambda v: F.try_variant_get(v, "$", "string")
    made = lambda field: F.struct(*[field(k, kind).cast(kind).alias(k) for k, kind in fields])
    typed = lambda v: made(lambda k, kind: F.try_variant_get(v, f"$.{k}", kind))
    named = lambda v, keys: made(lambda k, kind: text(v) if k in keys else F.lit(None))
    each = lambda v: F.when(shape(v, "OBJECT"), typed(v)).when(shape(v, "STRING"), named(v, ("path", "command", "host", "server")))

    def rows(v: Column) -> Column:
        listed = F.array_compact(F.transform(F.try_variant_get(v, "$", "array<variant>"), each))
        return F.when(shape(v, "ARRAY"), listed).when(shape(v, "OBJECT"), F.array(typed(v))).when(shape(v, "STRING"), F.array(named(v, ("path",))))

    # parsed once a row, and only where the payload has the word
    return F.when(F.contains("payload_json", F.lit(f'"{name}"')), F.get(F.transform(F.array(value), rows), F.lit(0)))


def facet(events: DataFrame, name: str, keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """The facet rows of events, once for each event and key; shapes other than a list of objects give coarser rows, not errors.

    Events are taken to be distinct, as appends leave them; of an event's objects with equal keys the first counts.
    """
    declared, keys, defaults = FACETS[name]
    fields = [tuple(f.strip().split(" ")) for f in declared.split(",")]
    filled = F.transform(_objects(name, fields), lambda o: F.struct(*[(F.coalesce(o[k], F.lit(defaults[k])) if k in defaults else o[k]).alias(k) for k, _ in fields]))
    key = lambda o: F.struct(*[o[k] for k in keys])
    first = lambda listed: F.filter(listed, lambda o, i: o[keys[0]].isNotNull() & (F.array_position(F.transform(listed, key), key(o)) == i + 1))
    one = F.when(F.size(filled) == 1, F.filter(filled, lambda o: o[keys[0]].isNotNull())).otherwise(F.get(F.transform(F.array(filled), first), F.lit(0)))
    rows = events.select(*keep, F.explode(one).alias("f")).select(*keep, "f.*")
    if name == "commands":
        rows = rows.withColumn("executable", F.coalesce("executable", first_word(F.col("command"))))
    return rows
