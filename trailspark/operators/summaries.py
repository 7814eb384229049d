"""Counts and derived sessions of a case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions.identity import null_safe_key, uninterpreted, unreadable

SESSION = ["agent", "host", "user", "is_fs", "project", "session"]


def beside(*totals: DataFrame) -> DataFrame:
    """Tables of totals, one row each, as one row."""
    keyed = [t.withColumn("_total", F.lit("all")) for t in totals]
    return reduce(lambda a, b: a.join(b, "_total"), keyed).drop("_total")


def case_counts(events: DataFrame) -> DataFrame:
    """One row of numbers that qualify what a case can say."""
    return events.agg(
        F.count("*").alias("events"),
        F.count_if(F.col("ts_utc").isNull()).alias("undated"),
        F.count_if(unreadable()).alias("unreadable"),
        F.count_if(uninterpreted()).alias("uninterpreted"),
        F.count_if(F.col("kind") == "artifact.fs").alias("file_events"),
        F.countDistinct("agent").alias("agents"),
        F.countDistinct("original_path").alias("files"),
        F.countDistinct("event_id").alias("distinct_events"),
    )


def agent_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("agent").agg(
        F.count("*").alias("events"), F.count_if(unreadable()).alias("unreadable"), F.count_if(uninterpreted()).alias("uninterpreted"),
        F.min("ts_utc").alias("first"), F.max("ts_utc").alias("last"),
    )


def kind_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count("*").alias("n"))


def unread_by_artifact(events: DataFrame) -> DataFrame:
    """Artifacts with records that weren't read, and in how many files."""
    found = events.groupBy("artifact_id").agg(
        F.countDistinct("original_path").alias("files"), F.count_if(unreadable()).alias("unreadable"), F.count_if(uninterpreted()).alias("uninterpreted")
    )
    return found.where((F.col("unreadable") > 0) | (F.col("uninterpreted") > 0))


def sessions(events: DataFrame) -> DataFrame:
    """Derived sessions. File system events of an agent, host and user make one; null and '' as a session differ."""
    fs = F.col("kind") == "artifact.fs"
    keyed = events.withColumns({"is_fs": fs, "project": F.when(~fs, F.col("project_path")), "session": F.when(~fs, F.col("session_id")), "fs_text": fs.cast("string")})
    found = keyed.groupBy(*SESSION, "fs_text").agg(
        F.count("*").alias("events"), F.min("ts_utc").alias("first"), F.max("ts_utc").alias("last"), F.count_if(unreadable()).alias("unreadable"),
        F.count_if(F.col("ts_utc").isNull()).alias("undated"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"),
    )
    return found.withColumn("session_key", null_safe_key("agent", "host", "user", "fs_text", "project", "session")).drop("fs_text")


def project_groups(found: DataFrame) -> DataFrame:
    """Sessions by agent and project."""
    return found.groupBy("agent", "project").agg(
        F.count("*").alias("sessions"), F.sum("events").alias("events"), F.min("first").alias("first"), F.max("last").alias("last")
    )


def model_usage(models: DataFrame) -> DataFrame:
    """Tokens and cost by agent, session and model; what no event states stays null."""
    return models.groupBy("agent", "session_id", "model").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"), F.count("*").alias("events")
    )


def ranked(values: DataFrame, column: str) -> DataFrame:
    """How often each value occurs and in how many sessions; order it by n descending, then by value."""
    return values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))
