"""Readers that keep every record: what can't be decoded comes back with its text and a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions.flatten import custody_hash
from trailspark.functions.identity import event_id
from trailspark.operators.timeline import chain_problems
from trailspark.schema import EVENT, EVENT_COLUMNS
from trailspark.sources.positions import number_rows, runs, texts_of_runs
from trailspark.sources.unified import from_records


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line_no, text) of every line, the blank ones too; lines end with CRLF, LF or CR.

    Files are read in Spark's own splits, and each split's lines are numbered by its own task: a first pass counts the lines of
    each split, a second adds the number of those before it. Whatever the splits, the numbers are the same.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.make_valid_utf8("value").alias("text")
    )
    numbered = number_rows(rows, "path", "_block", "_at", "line_no")
    return numbered.select("path", "line_no", F.when(F.col("line_no") == 1, F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text")).alias("text"))


def strict_object(text: Column) -> Column:
    """The text of a line that is one JSON object and nothing else; null otherwise."""
    trimmed = F.trim(text)
    parsed = F.try_parse_json(F.concat(F.lit("["), trimmed, F.lit("]")))
    one = F.schema_of_variant(parsed).startswith("ARRAY<OBJECT") & F.try_variant_get(parsed, "$[1]", "variant").isNull()
    whole = F.startswith(trimmed, F.lit("{")) & F.endswith(trimmed, F.lit("}"))
    return F.when(whole & F.coalesce(one, F.lit(False)), trimmed)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, text, value, problem) of every line that isn't blank; value is the object's text or null."""
    lines = read_lines(spark, path).where(F.trim("text") != "").withColumn("value", strict_object(F.col("text")))
    problem = F.concat_ws(
        "; ",
        F.when(F.contains("text", F.lit("�")), "some bytes are no UTF-8"),
        F.when(F.col("value").isNull(), F.when(F.try_parse_json("text").isNotNull() & ~F.rlike(F.trim("text"), F.lit(r"^\{")), "not an object").otherwise("not JSON")),
    )
    return lines.withColumn("problem", F.when(problem != "", problem))


def read_unified_log(spark: SparkSession, path: str, bundle: str | None = None) -> DataFrame:
    """Events of unified logs, a line each; see sources.unified."""
    return from_records(read_jsonl(spark, path), bundle=bundle)


def read_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """files, gaps, project_roots, users and collections of bundle manifests, each with its bundle_uuid; collections has the hash of the manifest as stored."""
    schema = (
        "collection struct<uuid: string, started_utc: string, finished_utc: string, hostname: string, os: string, os_version: string, collector_user: string, elevated: boolean>, "
        "files array<struct<artifact_id: string, agent: string, category: string, user: string, original_path: string, bundle_path: string, size: bigint, sha256: string, mtime_utc: string, "
        "ctime_utc: string, atime_utc: string, birthtime_utc: string, collected: boolean, reason: string, status: string, symlink: string, changed_while_reading: boolean>>, "
        "errors array<struct<path: string, error: string, detail: string>>, refused_patterns array<struct<pattern: string, expanded: string, reason: string>>, "
        "project_roots array<struct<path: string, source: string>>, users array<struct<name: string, home: string, collected: boolean, reason: string>>"
    )
    stored = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("manifest_sha256"), F.from_json(F.decode("content", "UTF-8"), schema).alias("m"))
    rows = stored.select(F.col("m.collection.uuid").alias("bundle_uuid"), "manifest_sha256", "m.*")
    each = lambda c: rows.select("bundle_uuid", F.explode(c).alias("x"))
    files = each("files").select("bundle_uuid", "x.*")
    errors = each("errors").select("bundle_uuid", F.lit("error").alias("kind"), F.col("x.path").alias("detail"), F.concat_ws(": ", "x.error", "x.detail").alias("reason"))
    refused = each("refused_patterns").select("bundle_uuid", F.lit("refused").alias("kind"), F.col("x.pattern").alias("detail"), F.col("x.reason").alias("reason"))
    skipped = files.where(~F.coalesce("collected", F.lit(True))).select("bundle_uuid", F.lit("skipped_by_policy").alias("kind"), F.col("original_path").alias("detail"), "reason")
    return {
        "files": files,
        "gaps": errors.unionByName(refused).unionByName(skipped),
        "project_roots": each("project_roots").select("bundle_uuid", F.col("x.path").alias("root"), F.col("x.source").alias("source")),
        "users": each("users").select("bundle_uuid", "x.*"),
        "collections": rows.select("bundle_uuid", "manifest_sha256", "collection.*").drop("uuid"),
    }


def read_custody(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, seq, event, sha256, prev_sha256, manifest_sha256, problem) of custody records; numbers and hashes are checked, not trusted."""
    lines = read_jsonl(spark, path)
    said = lambda n: F.get_json_object("value", f"$.{n}")
    rows = lines.select(
        "path", "line_no", said("seq").try_cast("long").alias("seq"), *[said(n).alias(n) for n in ("event", "sha256", "prev_sha256", "manifest_sha256")],
        custody_hash("value").alias("_own"), F.col("problem").alias("_unread"),
    )
    checked = chain_problems(rows, ["path"], order="line_no", recomputed="_own")
    said_all = F.concat_ws("; ", "_unread", "problem")
    return checked.withColumn("problem", F.nullif(said_all, F.lit(""))).drop("_own", "_unread")


def read_table(rows: DataFrame, store: str, table: str, columns: dict[str, list[str]], row_id: str) -> DataFrame:
    """Rows of an agent's own table, as they are exported, as uninterpreted events; columns maps event columns to names to try."""
    from trailspark.schema import UNINTERPRETED

    literal = {c: F.coalesce(*[F.col(n).cast("string") for n in names if n in rows.columns] or [F.lit(None)]) for c, names in columns.items()}
    made = {
        **literal, "kind": F.lit("unparsed.record"), "ts_precision": F.lit("absent"), "original_path": F.lit(store),
        "locator": F.format_string(f"table:{table} rowid:%s", F.col(row_id).cast("string")), "raw_json": F.to_json(F.struct(*rows.columns)), "parse_problem": F.lit(f"a row of {table} {UNINTERPRETED}"),
    }
    return rows.select(*[made.get(c, F.lit(None)).cast("string").alias(c) for c in EVENT_COLUMNS]).withColumn("event_id", event_id())


def line_runs(lines: DataFrame, kind: Column, by: str = "path") -> DataFrame:
    """(path, run, first_line, kind, text): consecutive lines of one kind, joined."""
    rows = runs(lines.withColumn("kind", kind), same=F.col("kind"), by=by)
    return texts_of_runs(rows, [by, "run", "kind"])


__all__ = ["EVENT", "line_runs", "read_custody", "read_jsonl", "read_lines", "read_manifest", "read_table", "read_unified_log", "strict_object"]
