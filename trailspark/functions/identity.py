"""Identities that derive from provenance, and predicates on the two kinds of unread records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailspark.schema import KINDS, UNINTERPRETED

NUL = "\u0000"


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def event_id() -> Column:
    """The first 32 digits of the SHA-256 of bundle, path, file hash, artifact, locator and kind; null counts as ''."""
    parts = ("bundle_uuid", "original_path", "file_sha256", "artifact_id", "locator", "kind")
    return F.substring(F.sha2(F.concat_ws(NUL, *map(_or_empty, parts)), 256), 1, 32)


def finding_id(rule: Column, event_ids: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(NUL, rule, F.array_join(F.array_sort(event_ids), NUL)), 256), 1, 32)


def null_safe_key(*columns: str) -> Column:
    """A SHA-256 in which null and '' differ: each value follows a byte that says which of the two it is."""
    parts = [F.concat(F.when(F.col(c).isNull(), F.lit("\u0001")).otherwise(F.lit("\u0002")), _or_empty(c), F.lit(NUL)) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def uninterpreted() -> Column:
    """Read, but without a mapping; whatever the kind."""
    return F.coalesce(F.contains("parse_problem", F.lit(UNINTERPRETED)), F.lit(False))


def unreadable() -> Column:
    return (F.col("kind") == "unparsed.record") & ~uninterpreted()


def problem() -> Column:
    """Why an event breaks the model; null if it doesn't. Broken events are marked, never dropped."""
    absent, no_time = F.col("ts_precision") == "absent", F.col("ts_utc").isNull()
    shape = F.rlike(F.col("ts_utc"), F.lit(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})$"))
    said = F.concat_ws(
        "; ",
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), F.lit("unknown kind")),
        F.when(no_time != F.coalesce(absent, F.lit(False)), F.lit("time and precision disagree")),
        F.when(~F.coalesce(shape, F.lit(True)), F.lit("malformed time")),
    )
    return F.when(said != "", said)
