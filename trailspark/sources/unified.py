"""The unified log: one event a line, with its provenance and the original record.

Reading is total. A line that is no event comes back as an unparsed record that holds it whole, and what a record lacks or
gets wrong is said in parse_problem, never corrected in silence. Ids are derived anew from the provenance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions.identity import event_id
from trailspark.schema import EVENT_COLUMNS, KINDS

#: Fixed values of the format.
VERSION = 1
ACTORS = ("user", "assistant", "tool", "system", "unknown")
TIMED = ("exact", "second", "minute", "hour", "day", "filesystem")
IDENTITY = ("client", "host", "user", "session_id", "project_path", "git_branch")
REQUIRED = ("v", "agent", "kind", "event_id", "ts_utc", "ts_precision", "payload", "provenance", "raw")
PRODUCER = "trailspark/1"


#: What is read of a record: each field is taken out once, and its shape and text are made once.
FIELDS = ("v", "agent", "kind", "event_id", "ts_utc", "ts_precision", "ts_source", "actor", *IDENTITY, "payload", "parse_problem", "provenance", "raw")
PLACES = ("bundle_uuid", "original_path", "sha256", "artifact_id", "locator")


def _name(prefix: str, path: str) -> str:
    return f"_{prefix}_{path.replace('.', '_')}"


def _at(path: str) -> Column:
    return F.col(_name("at", path))


def _is(path: str, *kinds: str) -> Column:
    out = F.lit(False)
    for k in kinds:
        out = out | F.startswith(F.col(_name("shape", path)), F.lit(k))
    return F.coalesce(out, F.lit(False))


def _text(path: str) -> Column:
    """A field that should be text: numbers and booleans become it, what is empty or nested is absent."""
    return F.col(_name("text", path))


def _opened(rows: DataFrame) -> DataFrame:
    """rows with the fields of `_record`: their values, shapes and texts, for _at, _is and _text."""
    paths = [*FIELDS, *[f"provenance.{p}" for p in PLACES]]
    taken = rows.select("*", *[F.try_variant_get("_record", f"$.{p}", "variant").alias(_name("at", p)) for p in paths]).drop("_record")
    shaped = taken.select("*", *[F.schema_of_variant(_at(p)).alias(_name("shape", p)) for p in paths])
    plain = [p for p in paths if p not in ("v", "payload", "provenance", "raw")]
    texts = {p: F.when(~_is(p, "OBJECT", "ARRAY"), F.nullif(F.try_variant_get(_at(p), "$", "string"), F.lit(""))) for p in plain}
    return shaped.select("*", *[text.alias(_name("text", p)) for p, text in texts.items()])


def _json(path: str) -> Column:
    """The text of a field's value as it is written: of objects and lists by position, of others as JSON."""
    nested = F.get_json_object("value", f"$.{path}")
    return F.when(_is(path, "OBJECT", "ARRAY"), nested).when(_at(path).isNotNull() & ~F.is_variant_null(_at(path)), F.to_json(_at(path)))


def schema_problems() -> list[Column]:
    """What a record lacks or has of another type; a Column for each, null where all is well."""
    lacking = [F.when(F.col("_parsed") & _at(c).isNull(), F.lit(f"the record has no field {c}")) for c in REQUIRED]
    typed = {c: ("STRING", "VOID") for c in ("ts_utc", "ts_source", "parse_problem", *IDENTITY)} | {"v": ("BIGINT",), "agent": ("STRING",), "event_id": ("STRING",), "payload": ("OBJECT",), "provenance": ("OBJECT",)}
    other = [F.when(_at(c).isNotNull() & ~_is(c, *kinds), F.lit(f"the field {c} is of another type")) for c, kinds in typed.items()]
    return lacking + other


def from_records(lines: DataFrame, *, bundle: str | None = None, path: Column | None = None, locator: Column | None = None, sha256: str | None = None) -> DataFrame:
    """Events of lines (text, value, problem), where value is an object's text or null. bundle, path and locator stand in for what a record doesn't say."""
    path = F.col("path") if path is None else path
    locator = F.concat(F.lit("line:"), F.col("line_no")) if locator is None else locator
    parsed = lines.withColumns({"_record": F.try_parse_json("value"), "_path": path, "_place": locator})
    rows = _opened(parsed.withColumn("_parsed", F.col("_record").isNotNull()))
    object_, agent, kind = F.col("value").isNotNull(), F.when(_is("agent", "STRING"), _text("agent")), F.when(_is("kind", "STRING"), _text("kind"))
    known = object_ & agent.isNotNull() & F.coalesce(kind.isin(*KINDS), F.lit(False))
    own = _is("provenance", "OBJECT") & F.coalesce(_is("provenance.original_path", "STRING") & (_text("provenance.original_path") != ""), F.lit(False))
    ts, precision = F.when(_is("ts_utc", "STRING"), _text("ts_utc")), _text("ts_precision")
    timed = F.coalesce(precision.isin(*TIMED), F.lit(False))
    payload = _at("payload")
    said_raw = F.try_variant_get(_at("raw"), "$", "string")
    bare = _is("raw", "STRING") & F.try_parse_json(said_raw).isNull()  # a text that never was JSON
    made = {
        "kind": F.when(known, kind).otherwise("unparsed.record"),
        "agent": F.coalesce(agent, F.lit("unknown")),
        "bundle_uuid": F.when(own, F.coalesce(_text("provenance.bundle_uuid"), F.lit(bundle))).otherwise(F.lit(bundle)),
        "original_path": F.when(own, _text("provenance.original_path")).otherwise(F.col("_path")),
        "file_sha256": F.when(own, _text("provenance.sha256")).otherwise(F.lit(sha256)),
        "artifact_id": F.when(own, _text("provenance.artifact_id")),
        "locator": F.when(own, _text("provenance.locator")).otherwise(F.col("_place")),
        "ts_utc": F.when(agent.isNotNull(), ts),
        "ts_precision": F.when(ts.isNull() | agent.isNull(), "absent").when(timed, precision).otherwise("second"),
        "ts_source": F.when(agent.isNotNull(), _text("ts_source")),
        "actor": F.when(known & F.coalesce(_text("actor").isin(*ACTORS), F.lit(False)), _text("actor")).otherwise("unknown"),
        "payload_json": F.when(~known, F.lit("{}")).when(_is("payload", "OBJECT"), _json("payload")).when(_json("payload").isNotNull(), F.concat(F.lit('{"payload":'), _json("payload"), F.lit("}"))).otherwise("{}"),
        "raw_json": F.when(~object_, F.col("text")).when(bare, said_raw).otherwise(F.coalesce(_json("raw"), F.col("value"))),
        **{c: F.when(agent.isNotNull(), _text(c)) for c in IDENTITY},
    }
    problems = [
        F.when(known, F.when(_is("parse_problem", "STRING"), _text("parse_problem"))),
        F.col("problem"),
        *schema_problems(),
        F.when(object_ & ~own, F.lit("no usable provenance, so the log stands in for it")),
        F.when(object_ & agent.isNull(), F.lit("the record names no agent")),
        F.when(object_ & agent.isNotNull() & ~F.coalesce(kind.isin(*KINDS), F.lit(False)), F.concat(F.lit("unknown kind "), F.coalesce(kind, F.lit("(none)")))),
        F.when(ts.isNull() & F.coalesce(precision != "absent", F.lit(False)), F.lit("a precision without a time")),
        F.when(ts.isNotNull() & ~timed, F.lit("a time of unknown precision, taken as seconds")),
        F.when(known & ~F.coalesce(_text("actor").isin(*ACTORS), _at("actor").isNull() | F.is_variant_null(_at("actor"))), F.lit("an unknown actor")),
        F.when(known & F.coalesce(payload.isNotNull() & ~F.is_variant_null(payload), F.lit(False)) & ~_is("payload", "OBJECT"), F.lit("the payload is no object, so it is kept under 'payload'")),
    ]
    found = rows.select("*", *[v.cast("string").alias(f"_e_{k}") for k, v in made.items()], F.concat_ws("; ", *problems).alias("_said"), F.when(known, _text("event_id")).alias("_stated"))
    named = found.select(*[F.col(f"_e_{c}").alias(c) for c in EVENT_COLUMNS if c in made], "_said", "_stated").withColumn("event_id", event_id())
    differs = F.when(F.col("_stated") != F.col("event_id"), F.lit("the stated id doesn't follow from the provenance"))
    return named.withColumn("parse_problem", F.nullif(F.concat_ws("; ", F.nullif(F.col("_said"), F.lit("")), differs), F.lit(""))).select(*EVENT_COLUMNS)


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.btrim(F.to_json(F.array(text)), F.lit("[]"))  # a string's own brackets stand between its quotes


def _members(**columns: Column) -> Column:
    """The members of a JSON object of texts, nulls written, without its braces."""
    return F.btrim(F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]), {"ignoreNullFields": "false"}), F.lit("{}"))


def _verbatim(text: Column) -> Column:
    """JSON as it is, on one line; a text that isn't JSON as a string; null where there is none."""
    one_line = F.regexp_replace(text, r"[\r\n]+", " ")
    return F.when(text.isNull(), F.lit("null")).when(F.try_parse_json(text).isNotNull(), one_line).otherwise(_quoted(text))


def to_record(producer: str = PRODUCER) -> Column:
    """An event as a line of the log. Nulls are written, and the payload and the original record are kept as they are."""

    payload = _verbatim(F.coalesce(F.when(F.col("payload_json") != "", F.col("payload_json")), F.lit("{}")))
    first = _members(**{c: F.col(c) for c in ("agent", "kind", "event_id", "ts_utc", "ts_precision", "ts_source", "actor", *IDENTITY)})
    places = _members(**{p: F.col("file_sha256" if p == "sha256" else p) for p in PLACES})
    parts = [f'{{"v":{VERSION},', first, ',"payload":', payload, ",", _members(parse_problem=F.col("parse_problem")), ',"provenance":{', places, '},"raw":', _verbatim(F.col("raw_json")), ",", _members(producer=F.lit(producer)), "}"]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
