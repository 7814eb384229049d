"""Timeline: filters that keep undated events, orders, pages, duplicates and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailspark.functions.identity import problem


def within(events: DataFrame, *, agents=None, kinds=None, session=None, since: str | None = None, until: str | None = None, files: bool = True) -> DataFrame:
    """Events of the given agents, kinds and session in a window; an undated event is in every window."""
    keep = F.lit(True)
    if agents:
        keep &= F.col("agent").isin(*agents)
    if kinds:
        keep &= F.col("kind").isin(*kinds)
    if session is not None:
        keep &= F.col("session_id") == session
    if since:
        keep &= F.col("ts_utc").isNull() | (F.col("ts_utc") >= since)
    if until:
        keep &= F.col("ts_utc").isNull() | (F.col("ts_utc") <= until)
    if not files:
        keep &= F.col("kind") != "artifact.fs"
    return events.where(keep)


def timeline_order() -> list[Column]:
    return [F.asc_nulls_first("ts_utc"), F.asc("original_path"), F.asc_nulls_first("locator"), F.asc("kind")]


def session_order() -> list[Column]:
    """As the timeline, but line:9 comes before line:10."""
    return [F.asc_nulls_first("ts_utc"), F.asc("original_path"), F.asc_nulls_first(F.length("locator")), F.asc_nulls_first("locator"), F.asc("kind")]


def page(events: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of ordered events and one row more, which tells whether there is a next page."""
    return events.orderBy(*session_order()).offset(max(0, offset)).limit(min(max(1, limit), 20_000) + 1)


def place_of() -> Column:
    """The sort key of an event within a session, as one value that orders as session_order() does, with the id for ties."""
    return F.struct("ts_utc", "original_path", F.length("locator").alias("n"), "locator", "kind", "event_id")


def page_after(events: DataFrame, after: Row | None = None, limit: int = 2000) -> DataFrame:
    """The page of ordered events that follows the event `after`, with its `place`: give a page's last one for the next.

    Each page is a top-k of what lies beyond a key, so that a late page costs what the first one does; nulls come first.
    """
    rows = events.withColumn("place", place_of())
    if after is not None:
        at = F.struct(*[F.lit(v).cast("int" if k == "n" else "string").alias(k) for k, v in after["place"].asDict().items()])
        rows = rows.where(F.col("place") > at)
        if after["place"]["ts_utc"] is not None:  # what a scan can be asked for
            rows = rows.where(F.col("ts_utc") >= after["place"]["ts_utc"])
    return rows.orderBy("place").limit(min(max(1, limit), 20_000))


def distinct_events(events: DataFrame) -> DataFrame:
    """The first row, in timeline order, of each event id."""
    place = F.row_number().over(W.partitionBy("event_id").orderBy(*timeline_order(), F.xxhash64(*events.columns)))
    return events.withColumn("_place", place).where("_place = 1").drop("_place")


def append_new(stored: DataFrame, more: DataFrame) -> DataFrame:
    """The rows of more whose event isn't stored yet, once each; appending twice changes nothing."""
    return distinct_events(more).join(stored.select("event_id"), "event_id", "left_anti")


def checked(events: DataFrame) -> DataFrame:
    """Adds `problem`, null for valid events."""
    return events.withColumn("problem", problem())


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert: of the rows of a key the last in the given order."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def carried(events: DataFrame, columns: list[str], by: list[str], order: list[Column]) -> DataFrame:
    """Facts that a session states once, carried forward to the records after it."""
    so_far = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return events.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns})


def islands(rows: DataFrame, same: Column, by: list[str], order: list[Column], name: str = "island") -> DataFrame:
    """Numbers runs of consecutive rows; `same` tells whether a row continues the run of the row before it."""
    in_order = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, F.sum((~F.coalesce(same, F.lit(False))).cast("long")).over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow)))


def turns(records: DataFrame, message: str, by: list[str], order: list[Column]) -> DataFrame:
    """Consecutive records of one message id form a turn; a record without an id stands alone."""
    before = F.lag(message).over(W.partitionBy(*by).orderBy(*order))
    return islands(records.withColumn("_before", before), F.col("_before") == F.col(message), by, order, "turn_no").drop("_before")


def chain_problems(records: DataFrame, by: list[str], position: str = "seq", sha: str = "sha256", previous: str = "prev_sha256", order: str | None = None, recomputed: str | None = None) -> DataFrame:
    """Adds why a custody record breaks its chain: a number that isn't its place, a hash that isn't its predecessor's or its own.

    order: the column that records stand in; without it, their numbers. recomputed: the hash that the record really has.
    """
    in_order = W.partitionBy(*by).orderBy(order or position)
    said = F.concat_ws(
        "; ",
        F.when(~F.col(position).eqNullSafe((F.row_number().over(in_order) - 1).cast("long")), F.lit("number out of sequence")),
        F.when(~F.col(previous).eqNullSafe(F.lag(sha).over(in_order)), F.lit("previous hash differs")),
        F.when(~F.col(recomputed).eqNullSafe(F.col(sha)), F.lit("own hash differs")) if recomputed else F.lit(None).cast("string"),
    )
    return records.withColumn("problem", F.when(said != "", said))


def commits_to(records: DataFrame, by: list[str], manifests: DataFrame, column: str = "manifest_sha256") -> DataFrame:
    """(by, committed): whether any record of a chain names the hash of its manifest. manifests: (by, manifest_sha256)."""
    named = records.select(*by, F.col(column).alias("_named")).join(manifests.select(*by, F.col("manifest_sha256").alias("_stored")), by)
    return named.groupBy(*by).agg(F.bool_or(F.coalesce(F.col("_named") == F.col("_stored"), F.lit(False))).alias("committed"))
