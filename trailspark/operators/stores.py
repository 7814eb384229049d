"""Corroboration: which stores of an agent name which sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def named_sessions(events: DataFrame) -> DataFrame:
    """(agent, session, store) with counts and times; file system events and blank ids name nothing."""
    some = events.where((F.col("kind") != "artifact.fs") & F.col("session_id").isNotNull() & (F.trim("session_id") != ""))
    return some.groupBy("agent", F.col("session_id").alias("session"), F.col("artifact_id").alias("store")).agg(
        F.count("*").alias("events"), F.min("ts_utc").alias("first"), F.max("ts_utc").alias("last")
    )


def corroboration(named: DataFrame) -> DataFrame:
    """One row a session: the stores that name it."""
    return named.groupBy("agent", "session").agg(
        F.countDistinct("store").alias("stores"), F.sum("events").alias("events"), F.array_join(F.sort_array(F.collect_set("store")), ",").alias("named_by")
    ).withColumn("corroborated", F.col("stores") > 1)


def silent_stores(named: DataFrame) -> DataFrame:
    """(agent, session, store): stores that name sessions of the agent, but not this one. An agent has few stores."""
    stores = named.select("agent", "store").distinct()
    return named.select("agent", "session").distinct().join(stores, "agent").join(named.select("agent", "session", "store"), ["agent", "session", "store"], "left_anti")


def store_overlap(named: DataFrame) -> DataFrame:
    """For each pair of an agent's stores how many sessions both name, and each alone; none, partial or complete.

    Sessions are counted by the set of stores that name them, so that the pairs come from few rows.
    """
    sets = named.groupBy("agent", "session").agg(F.sort_array(F.collect_set("store")).alias("names")).groupBy("agent", "names").agg(F.count("*").alias("n"))
    stores = named.select("agent", "store").distinct()
    pairs = stores.select("agent", F.col("store").alias("a")).join(stores.select("agent", F.col("store").alias("b")), "agent").where("a < b")
    has = lambda c: F.array_contains("names", F.col(c))
    counted = pairs.join(sets, "agent").groupBy("agent", "a", "b").agg(
        F.sum(F.when(has("a") & has("b"), F.col("n")).otherwise(0)).alias("both"),
        F.sum(F.when(has("a") & ~has("b"), F.col("n")).otherwise(0)).alias("a_only"),
        F.sum(F.when(~has("a") & has("b"), F.col("n")).otherwise(0)).alias("b_only"),
    )
    return counted.withColumn("overlap", F.when(F.col("both") == 0, "none").when((F.col("a_only") == 0) & (F.col("b_only") == 0), "complete").otherwise("partial"))


def prompts_without_transcript(prompts: DataFrame, transcript: DataFrame) -> DataFrame:
    """Prompts of a history whose agent and session have no transcript event."""
    return prompts.join(transcript.select("agent", "session_id").distinct(), ["agent", "session_id"], "left_anti")
