"""Exports: timelines, unified logs and stored cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.operators.timeline import append_new, distinct_events, timeline_order
from trailspark.sources.unified import to_record


def summarise(width: int = 0) -> Column:
    """One line about an event, from the first of its payload's fields that says something."""
    said = F.coalesce(*[F.nullif(F.get_json_object("payload_json", f"$.{p}"), F.lit("")) for p in ("text", "commands[0].command", "files[0].path", "network[0].url", "tool", "output")], F.lit(""))
    line = F.concat(F.col("kind"), F.when(said != "", F.concat(F.lit(": "), F.regexp_replace(said, r"\s+", " "))).otherwise(F.lit("")))
    return F.substring(line, 1, width) if width else line


def write_unified_log(events: DataFrame, path: str) -> None:
    events.select(to_record()).write.text(path)


#: The columns of a timeline, in the order that its readers expect.
TIMELINE = (
    "ts_utc", "ts_precision", "ts_source", "kind", "agent", "actor", "user", "host", "client", "session_id", "project_path", "git_branch", "summary", "artifact_id", "original_path", "locator",
    "file_sha256", "event_id", "parse_problem",
)


def timeline_rows(events: DataFrame) -> DataFrame:
    return events.withColumn("summary", summarise()).select(*TIMELINE)


def write_timeline(events: DataFrame, path: str, form: str = "csv") -> None:
    """csv, jsonl, or timesketch, which leaves out undated events: count those with `undated`."""
    if form == "csv":
        timeline_rows(events.orderBy(*timeline_order())).write.option("header", True).csv(path)
    elif form == "jsonl":
        events.orderBy(*timeline_order()).select(to_record()).write.text(path)
    else:
        rows = events.where(F.col("ts_utc").isNotNull()).orderBy(*timeline_order())
        rows.select(F.to_json(F.struct(summarise().alias("message"), F.col("ts_utc").alias("datetime"), F.col("kind").alias("timestamp_desc"), F.lit("agent:event").alias("data_type")))).write.text(path)


def undated(events: DataFrame) -> int:
    return events.where(F.col("ts_utc").isNull()).count()


#: Bundles of one append whose names are written into the query; beyond, they are joined.
NAMED = 1000


def stored_ids(events: DataFrame, path: str) -> DataFrame:
    """(event_id) of a case's events in the bundles of `events`.

    A bundle's events lie in a folder of their own, and the folders of other bundles aren't read: up to NAMED bundles are named in the
    filter on folders, more are joined by a plain equality, which prunes folders when the query runs.
    """
    stored = events.sparkSession.read.schema("event_id string, bundle_uuid string").parquet(path)
    bundles = events.select(F.col("bundle_uuid").alias("_bundle")).distinct()
    names = [r[0] for r in bundles.limit(NAMED + 1).collect()]
    if len(names) <= NAMED:
        test = F.col("bundle_uuid").isin([n for n in names if n is not None])
        return stored.where(test | F.col("bundle_uuid").isNull() if None in names else test).select("event_id")
    named = stored.join(bundles.where("_bundle IS NOT NULL"), F.col("bundle_uuid") == F.col("_bundle"), "left_semi")
    return named.select("event_id").union(stored.where(F.col("bundle_uuid").isNull()).select("event_id"))


def append_case(events: DataFrame, path: str) -> None:
    """Append the events that a case doesn't have yet to its Parquet table; doing it twice changes nothing.

    Only folders of the bundles that are appended are read.
    """
    rows = append_new(stored_ids(events, path), events) if _exists(events.sparkSession, path) else distinct_events(events)
    rows.write.mode("append").partitionBy("bundle_uuid").parquet(path)


def _exists(spark, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
