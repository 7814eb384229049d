"""Groups and bursts of events that exceed a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ABSENT = "\u0000absent"


def large_groups(events: DataFrame, keys: list[str], least: int, distinct: Column | None = None) -> DataFrame:
    """Groups of at least `least` events, or of as many distinct values, of which a missing one counts as a value."""
    size = F.count("*") if distinct is None else F.countDistinct(F.coalesce(distinct.cast("string"), F.lit(ABSENT)))
    return events.groupBy(*keys).agg(size.alias("size"), F.min("ts_utc").alias("first"), F.max("ts_utc").alias("last")).where(F.col("size") >= least)


def bursts(events: DataFrame, keys: list[str], minutes: int, least: int) -> DataFrame:
    """For each group its largest run of dated events within the window, the earliest of equal ones, if large enough.

    Columns: the keys, size, first and last (micros). A range window counts backwards from each event.
    """
    dated = events.select(*keys, F.unix_micros(F.to_timestamp("ts_utc")).alias("at")).where("at is not null")
    span = W.partitionBy(*keys).orderBy("at").rangeBetween(-minutes * 60_000_000, 0)
    sized = dated.withColumns({"size": F.count("*").over(span), "first": F.min("at").over(span)})
    best = sized.groupBy(*keys).agg(F.max_by(F.struct("size", "first", F.col("at").alias("last")), F.struct("size", -F.col("at"))).alias("b"))
    return best.select(*keys, "b.*").where(F.col("size") >= least)


def undated_groups(events: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Undated events are groups of their own; they are never part of a burst."""
    return events.where(F.col("ts_utc").isNull()).groupBy(*keys).agg(F.count("*").alias("size")).where(F.col("size") >= least)


def members(events: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The events of each burst."""
    at = F.unix_micros(F.to_timestamp(events["ts_utc"]))
    same = (at >= found["first"]) & (at <= found["last"])
    for k in keys:
        same &= events[k].eqNullSafe(found[k])
    return events.join(found, same, "left_semi")
