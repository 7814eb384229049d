"""The tool ledger: calls, their results, and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CALLS = ("tool.call", "mcp.call")
STRICT = ("bundle_uuid", "session_id")


def said(name: str) -> Column:
    """A field of the payload as text."""
    return F.get_json_object("payload_json", f"$.{name}")


def tool_calls(events: DataFrame, tool: str | None = None, text: str | None = None) -> DataFrame:
    """Calls with `tool` (the kind where none is named) and `use_id`, by tool and by text in the payload."""
    calls = events.where(F.col("kind").isin(*CALLS)).withColumns({"tool": F.coalesce(said("tool"), F.col("kind")), "use_id": said("tool_use_id")})
    if tool is not None:
        calls = calls.where(F.col("tool") == tool)
    return calls.where(F.contains("payload_json", F.lit(text))) if text else calls


def tool_results(events: DataFrame) -> DataFrame:
    """One result for each id: the last in timeline order."""
    found = events.where((F.col("kind") == "tool.result") & said("tool_use_id").isNotNull()).select(
        *STRICT, said("tool_use_id").alias("use_id"), F.coalesce(said("is_error").try_cast("boolean"), F.lit(False)).alias("is_error"),
        said("exit_code").try_cast("int").alias("exit_code"), F.coalesce(said("output"), said("text")).alias("output"), "ts_utc", "event_id",
    )
    place = F.row_number().over(W.partitionBy(*STRICT, "use_id").orderBy(F.desc_nulls_last("ts_utc"), F.desc("event_id")))
    return found.withColumn("_place", place).where("_place = 1").drop("_place", "ts_utc").withColumnRenamed("event_id", "result_id")


def _same(calls: DataFrame, results: DataFrame) -> Column:
    return reduce(lambda x, y: x & y, [calls[c].eqNullSafe(results[c]) for c in STRICT], calls["use_id"] == results["use_id"])


def ledger(calls: DataFrame, results: DataFrame, strict: bool = True) -> DataFrame:
    """Calls with their results; without one the result's columns stay null, which isn't success.

    strict joins within bundle and session; otherwise by id alone, and the greatest result id counts.
    """
    if strict:
        joined = calls.join(results, _same(calls, results), "left")
    else:
        results = results.groupBy("use_id").agg(*[F.max_by(c, "result_id").alias(c) for c in ("is_error", "exit_code", "output", "result_id")])
        joined = calls.join(results, calls["use_id"] == results["use_id"], "left")
    return joined.select(*[calls[c] for c in calls.columns], *[results[c] for c in ("is_error", "exit_code", "output", "result_id")])


def failed(calls: DataFrame, results: DataFrame) -> DataFrame:
    bad = results.where("is_error")
    return calls.join(bad, _same(calls, bad), "left_semi")


def tool_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("tool").agg(F.count("*").alias("calls"), F.countDistinct("session_id").alias("sessions"))
