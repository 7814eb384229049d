"""Collected files: copies, attribution to a catalogue, verification, and hunts in listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailspark.functions.text import glob_regex, literal_length

#: How much a root of a pattern says, the most telling first.
ROOTS = ("named", "working", "plugin")


def identical_copies(files: DataFrame, key: str, sha: str) -> DataFrame:
    """(sha, copies, first): contents that more than one file has."""
    return files.where(F.col(sha).isNotNull()).groupBy(sha).agg(F.count("*").alias("copies"), F.min(key).alias("first")).where("copies > 1")


def patterns(spark: SparkSession, catalogue: list[tuple[str, str, str, str]]) -> DataFrame:
    """(artifact_id, agent, pattern, root, rank, literal, tail) from (artifact, agent, glob, root) entries of a catalogue.

    tail is the last segment where it has no wildcard: an equal join on it then goes before the pattern.
    """
    rows = []
    for artifact, agent, glob, root in catalogue:
        last = glob.replace("\\", "/").rsplit("/", 1)[-1]
        rows.append((artifact, agent, glob_regex(glob), root, ROOTS.index(root), literal_length(glob), None if set(last) & set("*?") else last.lower()))
    return spark.createDataFrame(rows, "artifact_id string, agent string, pattern string, root string, rank int, literal int, tail string")


def claims(paths: DataFrame, known: DataFrame, path: str = "path") -> DataFrame:
    """Each distinct path with every catalogue pattern that it matches. A catalogue has hundreds of entries."""
    each = paths.select(path).distinct().withColumn("last", F.lower(F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)))
    small = F.broadcast(known)
    exact = each.join(small.where("tail is not null"), (F.col("last") == F.col("tail")) & F.expr(f"`{path}` rlike pattern"))
    loose = each.join(small.where("tail is null"), F.expr(f"`{path}` rlike pattern"))
    return exact.unionByName(loose).drop("last", "tail", "pattern")


def best_claims(found: DataFrame, path: str = "path") -> DataFrame:
    """The claim with the most literal text, then the most telling root, then the least artifact id."""
    place = F.row_number().over(W.partitionBy(path).orderBy(F.desc("literal"), "rank", "artifact_id"))
    return found.withColumn("place", place).where("place = 1").drop("place")


def unclaimed(paths: DataFrame, found: DataFrame, path: str = "path") -> DataFrame:
    return paths.select(path).distinct().join(found.select(path), path, "left_anti")


def verify_bundle(manifest: DataFrame, listing: DataFrame, path: str = "path", sha: str = "sha256") -> DataFrame:
    """(path, verdict) of every file that the manifest expects or the bundle holds."""
    a, b = manifest.select(path, F.col(sha).alias("expected"), F.lit(True).alias("_a")), listing.select(path, F.col(sha).alias("found"), F.lit(True).alias("_b"))
    verdict = (
        F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when(F.col("expected").isNull(), "inconsistent")
        .when(F.col("expected") != F.col("found"), "mismatched").otherwise("verified")
    )
    return a.join(b, path, "full_outer").select(path, verdict.alias("verdict"))


def fleet_presence(found: DataFrame) -> DataFrame:
    """Which hosts hold paths of which agent, from attributed listings (host, path, agent, mtime)."""
    return found.groupBy("host", "agent").agg(F.countDistinct("path").alias("paths"), F.max("mtime").alias("last"))


def hunt_paths(file_events: DataFrame, fragments: DataFrame) -> DataFrame:
    """File events whose path holds a fragment anywhere, whatever the case or the separators. fragments: (fragment, agent), a small table."""
    small = F.broadcast(fragments.select(F.lower(F.translate("fragment", "\\", "/")).alias("_part"), "agent").distinct())
    return file_events.join(small, F.contains(F.lower(F.translate("path", "\\", "/")), F.col("_part"))).drop("_part")


def hunt_command_lines(process_events: DataFrame, words: DataFrame) -> DataFrame:
    """Process events whose command line has an agent's word as a word of its own. words: (name, agent), a small table."""
    small = F.broadcast(words.select(F.lower("name").alias("_name"), "agent").distinct())
    said = F.transform(F.split(F.lower("command_line"), r"[\s\"']+"), lambda w: F.regexp_replace(F.element_at(F.split(w, r"[/\\]"), -1), r"\.(exe|cmd|js)$", ""))
    return process_events.withColumn("_words", said).join(small, F.array_contains("_words", F.col("_name"))).drop("_name", "_words")


def hunt_files(file_events: DataFrame, fragments: DataFrame) -> DataFrame:
    """File events whose name is that of an artifact, whatever the case. fragments: (name, agent), a small table."""
    lowered = F.broadcast(fragments.select(F.lower("name").alias("_name"), "agent").distinct())
    return file_events.join(lowered, F.lower(F.element_at(F.split("path", r"[/\\]"), -1)) == F.col("_name")).drop("_name")


def hunt_processes(process_events: DataFrame, binaries: DataFrame) -> DataFrame:
    """Process events whose executable is an agent's binary, with or without .exe. binaries: (name, agent)."""
    lowered = F.broadcast(binaries.select(F.lower("name").alias("_name"), "agent").distinct())
    name = F.regexp_replace(F.lower(F.element_at(F.split("executable", r"[/\\]"), -1)), r"\.exe$", "")
    return process_events.join(lowered, name == F.col("_name")).drop("_name")
