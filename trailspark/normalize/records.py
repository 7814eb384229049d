"""What normalizers share: reading VARIANT records, and making events of them.

A normalizer turns each record into an array of small event structs and explodes it; a record that gives none becomes an
unparsed record, with its text, time and session, and a reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions.identity import event_id
from trailspark.functions.text import first_word, host_of, normalise_ts, text_of
from trailspark.schema import EVENT_COLUMNS, UNINTERPRETED
from trailspark.sources.positions import carry_forward

_EVENTS = "array<struct<kind:string,payload_json:string,suffix:string,actor:string,time:string>>"


def finish(rows: DataFrame, **columns: Column) -> DataFrame:
    """All event columns of rows that have some of them and `time`, with an id that follows from the provenance."""
    have = rows.withColumns(columns)
    if "time" in have.columns:
        have = have.withColumn("_t", normalise_ts(F.col("time"))).withColumns({"ts_utc": F.col("_t.ts_utc"), "ts_precision": F.col("_t.ts_precision")})
    have = have.withColumn("ts_precision", F.coalesce("ts_precision", F.lit("absent")) if "ts_precision" in have.columns else F.lit("absent"))
    full = have.select(*[(F.col(c) if c in have.columns else F.lit(None)).cast("string").alias(c) for c in EVENT_COLUMNS])
    return full.withColumn("event_id", event_id())


def at(value: Column, path: str) -> Column:
    """A part of a VARIANT; null where there is none, or a JSON null."""
    found = F.try_variant_get(value, f"$.{path}", "variant")
    return F.when(~F.is_variant_null(found), found)


def said(value: Column, path: str) -> Column:
    """A part of a VARIANT as text; null where there is none or it is empty."""
    return F.nullif(F.try_variant_get(value, f"$.{path}", "string"), F.lit(""))


def first_said(value: Column, *paths: str) -> Column:
    return F.coalesce(*[said(value, p) for p in paths])


def body(value: Column, path: str) -> Column:
    """The text of a message body at a path."""
    return text_of(F.try_variant_get(value, f"$.{path}", "variant"))


def is_a(value: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def items(value: Column) -> Column:
    """array<variant> of a list's items, or of a value that is no list itself; empty for none."""
    listed = F.try_variant_get(value, "$", "array<variant>")
    none = F.array().cast("array<variant>")
    return F.when(value.isNull() | F.is_variant_null(value), none).when(is_a(value, "ARRAY"), listed).otherwise(F.array(value))


def payload(**fields: Column) -> Column:
    """A payload of the fields that aren't null."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def nothing() -> Column:
    return F.array().cast(_EVENTS)


def event(kind: str | Column, content: Column, suffix: str | Column = "", actor: str = "unknown", time: Column | None = None) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        as_column(kind).alias("kind"), content.alias("payload_json"), as_column(suffix).alias("suffix"), F.lit(actor).alias("actor"),
        (F.lit(None) if time is None else time).cast("string").alias("time"),
    )


def when(test: Column, *events: Column) -> Column:
    """These events if the test holds, else none."""
    return F.when(F.coalesce(test, F.lit(False)), F.array(*events)).otherwise(nothing())


def each(values: Column, make) -> Column:
    """All events that make(value, index) gives for the values."""
    return F.coalesce(F.flatten(F.transform(values, make)), nothing())


def mark(name: str, index: Column) -> Column:
    return F.concat(F.lit(f"#{name}"), index.cast("string"))


def models(name: Column, tokens_in: Column | None = None, tokens_out: Column | None = None, cost: Column | None = None) -> Column:
    number = lambda c, kind: (F.lit(None) if c is None else c).try_cast(kind)
    one = F.struct(name.alias("model"), number(tokens_in, "long").alias("input_tokens"), number(tokens_out, "long").alias("output_tokens"), number(cost, "double").alias("cost"))
    return F.when(name.isNotNull(), F.array(one))


@dataclass(frozen=True)
class Tools:
    """What an agent's tools do, by name, and how it names their arguments."""

    command: tuple[str, ...] = ()
    read: tuple[str, ...] = ()
    write: tuple[str, ...] = ()
    network: tuple[str, ...] = ()
    memory: tuple[str, ...] = ()
    paths: tuple[str, ...] = ("path", "file_path")
    commands: tuple[str, ...] = ("command",)
    folders: tuple[str, ...] = ("cwd", "directory", "workdir")
    contents: tuple[str, ...] = ("content", "new_string", "diff")

    def effect(self, name: Column, arguments: Column, call: Column, suffix: Column, folder: Column | None = None) -> Column:
        """The event of what a call did, if its tool is known and says on what; no guess otherwise."""
        asked = F.coalesce(*[at(arguments, k) for k in self.commands])
        words = F.array_join(F.try_variant_get(asked, "$", "array<string>"), " ")
        command = F.nullif(F.when(is_a(asked, "ARRAY"), words).otherwise(F.try_variant_get(asked, "$", "string")), F.lit(""))
        path, url = first_said(arguments, *self.paths), first_said(arguments, "url", "query", "prompt")
        content = first_said(arguments, *self.contents)
        cwd = F.coalesce(*[said(arguments, k) for k in self.folders], F.lit(None) if folder is None else folder)
        common = {"tool": name, "tool_use_id": call}
        run = payload(**common, commands=F.array(F.struct(command.alias("command"), first_word(command).alias("executable"), cwd.alias("cwd"))))
        file = lambda operation: payload(**common, files=F.array(F.struct(path.alias("path"), F.lit(operation).alias("operation"), F.when(F.lit(operation == "write"), F.octet_length(content)).alias("bytes"))))
        link = F.regexp_extract(url, r"https?://[^\s<>\"')\]]+", 0)
        reach = payload(**common, network=F.array(F.struct(F.nullif(link, F.lit("")).alias("url"), host_of(link).alias("host"))), text=url)
        keep = payload(**common, text=F.coalesce(first_said(arguments, "fact", "text", "content"), F.lit("")))
        out = nothing()
        for names, test, kind, content_of in (
            (self.command, command.isNotNull(), "command.exec", run), (self.read, path.isNotNull(), "file.read", file("read")), (self.write, path.isNotNull(), "file.write", file("write")),
            (self.network, url.isNotNull(), "network.request", reach), (self.memory, F.lit(True), "memory.write", keep),
        ):
            if names:
                out = F.when(name.isin(*names) & test, F.array(event(kind, content_of, suffix, "assistant"))).otherwise(out)
        return out


def carried(rows: DataFrame, order: str = "line_no", **facts: Column) -> DataFrame:
    """Facts that a file states once, carried forward to the records after it."""
    return carry_forward(rows, facts, order=order)


def lines_of(lines: DataFrame) -> DataFrame:
    """JSON lines with the record as a VARIANT `v` and their place."""
    return lines.withColumns({"v": F.try_parse_json("value"), "place": F.concat(F.lit("line:"), F.col("line_no"))})


def emit(rows: DataFrame, made: Column, *, agent: str, artifact: str, time: Column, kind: Column, raw: Column | None = None, **columns: Column) -> DataFrame:
    """Events of rows (path, place, text, problem): those made, or an unparsed record that names the record's kind."""
    full = rows.withColumn("_made", made)
    unknown = F.array(event("unparsed.record", F.lit("{}")))
    found = full.withColumns({"_none": F.size("_made") == 0, "e": F.explode(F.when(F.size("_made") > 0, F.col("_made")).otherwise(unknown))})
    reason = F.coalesce(F.col("problem"), F.when(F.col("_none"), F.concat(F.lit("a record of type "), F.coalesce(kind, F.lit("(none)")), F.lit(f" {UNINTERPRETED}"))))
    return finish(
        found, kind=F.col("e.kind"), agent=F.lit(agent), actor=F.col("e.actor"), time=F.coalesce(F.col("e.time"), time), ts_source=F.when(F.coalesce(F.col("e.time"), time).isNotNull(), "timestamp"),
        artifact_id=F.lit(artifact), original_path=F.col("path"), locator=F.concat(F.col("place"), F.col("e.suffix")), payload_json=F.col("e.payload_json"),
        raw_json=F.col("text") if raw is None else raw, parse_problem=reason, **columns,
    )
