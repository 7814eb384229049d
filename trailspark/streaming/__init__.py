"""Streams of unified logs: idempotent appends, and scans of rules on single events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.rules.scan import Rule, scan_events
from trailspark.sinks import append_case
from trailspark.sources import strict_object
from trailspark.sources.unified import from_records


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of unified log files as they arrive; what isn't one becomes an unparsed record."""
    lines = spark.readStream.text(path).where(F.trim("value") != "").select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    rows = lines.withColumn("value", strict_object(F.col("text"))).withColumn("problem", F.when(F.col("value").isNull(), F.lit("not an object")))
    # a stream has no line numbers, so a line that isn't an event is placed by its own text
    return from_records(rows, locator=F.concat(F.lit("text:"), F.sha2("text", 256)))


def append_stream(events: DataFrame, case: str, checkpoint: str):
    """Append a stream to a case. Each batch is compared with what is stored, so that a replay changes nothing."""
    return events.writeStream.foreachBatch(lambda batch, _: append_case(batch, case)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_stream(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of rules on single events; they need no state."""
    return scan_events(events, rules)


def burst_counts(events: DataFrame, keys: list[str], minutes: int = 10, late: str = "1 hour") -> DataFrame:
    """Events by group and sliding window. An approximation of bursts: windows begin at full minutes, and undated events are left to a batch."""
    dated = events.withColumn("ts", F.to_timestamp("ts_utc")).where("ts is not null").withWatermark("ts", late)
    return dated.groupBy(*keys, F.window("ts", f"{minutes} minutes", "1 minute")).agg(F.count("*").alias("size"))
