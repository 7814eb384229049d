"""The driver's conversations and events as unified events, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions.identity import event_id
from trailspark.schema import EVENT_COLUMNS, UNINTERPRETED

#: What the types of the events table stand for.
EVENT_KINDS = {"click": "tool.call", "view": "file.read", "purchase": "command.exec", "error": "tool.result"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event(**columns: Column) -> list[Column]:
    return [columns.get(c, F.lit(None).cast("string")).cast("string").alias(c) for c in EVENT_COLUMNS]


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_id", event_id())


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "user.prompt").when(F.col("role") == "assistant", "assistant.text").otherwise("instruction.source")
    rows = table(spark, sf_dir, "conversations").select(
        *_event(
            bundle_uuid=F.lit("b0"), kind=kind, agent=F.lit("conv_agent"), ts_precision=F.lit("absent"),
            actor=F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("system"), session_id=F.col("conv_id"),
            artifact_id=F.lit("conv.transcript"), original_path=F.format_string("/trail/conv/%d.jsonl", "conv_id"), file_sha256=F.lit(""),
            locator=F.concat(F.lit("line:"), F.col("turn")), payload_json=F.to_json(F.struct("text")),
        )
    )
    return _named(rows)


def table_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_KINDS.items() for x in kv]), F.col("event_type")), F.lit("session.start"))
    use = F.get_json_object("props", "$.k")
    failed = (F.col("event_type") == "error") & (F.col("value") > 50)
    # some records are unread or unmapped, some sessions have no host, some are of a copied file
    number = F.col("event_id")
    problem = F.when(number % 17 == 0, F.lit("cut off")).when(number % 19 == 0, F.lit(f"the record {UNINTERPRETED}"))
    rows = table(spark, sf_dir, "events").select(
        *_event(
            bundle_uuid=F.lit("b0"), kind=F.when(number % 17 == 0, "unparsed.record").when(number % 23 == 0, "artifact.fs").otherwise(kind), parse_problem=problem, agent=F.lit("ev_agent"),
            host=F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("host"), F.col("user_id") % 3)), user=F.concat(F.lit("u"), F.col("user_id") % 2), project_path=F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("/w/"), F.col("user_id") % 5)), ts_utc=F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
            ts_precision=F.lit("exact"), actor=F.lit("assistant"), session_id=F.col("user_id"), artifact_id=F.concat(F.lit("ev."), F.col("event_type"), F.when(F.col("user_id") % 2 == 0, ".even").otherwise("")),
            original_path=F.format_string("/trail/ev/%d.jsonl", "user_id"), file_sha256=F.lit(""), locator=F.concat(F.lit("line:"), F.col("event_id")),
            payload_json=F.to_json(F.struct(F.col("event_type").alias("tool"), use.alias("tool_use_id"), failed.alias("is_error"), "value")),
        )
    )
    return _named(rows)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_events(spark, sf_dir).unionByName(table_events(spark, sf_dir))


#: The events as SQL; kinds as they are overridden above. UNMAPPED tells which of them were read without a mapping.
EVENTS = f"""
WITH raw AS (
  SELECT 'b0' AS bundle_uuid, CASE role WHEN 'user' THEN 'user.prompt' WHEN 'assistant' THEN 'assistant.text' ELSE 'instruction.source' END AS kind,
    'conv_agent' AS agent, NULL::VARCHAR AS host, NULL::VARCHAR AS "user", NULL::VARCHAR AS project, NULL::VARCHAR AS problem, NULL::VARCHAR AS ts_utc, 'absent' AS ts_precision,
    conv_id::VARCHAR AS session_id, 'conv.transcript' AS artifact_id, '/trail/conv/' || conv_id || '.jsonl' AS original_path, 'line:' || turn AS locator, text AS body,
    NULL::VARCHAR AS tool, NULL::VARCHAR AS use_id, false AS is_error
  FROM conversations
  UNION ALL
  SELECT 'b0', CASE WHEN event_id % 17 = 0 THEN 'unparsed.record' WHEN event_id % 23 = 0 THEN 'artifact.fs'
      ELSE CASE event_type WHEN 'click' THEN 'tool.call' WHEN 'view' THEN 'file.read' WHEN 'purchase' THEN 'command.exec' WHEN 'error' THEN 'tool.result' ELSE 'session.start' END END,
    'ev_agent', CASE WHEN user_id % 3 > 0 THEN 'host' || user_id % 3 END, 'u' || user_id % 2, CASE WHEN user_id % 5 > 0 THEN '/w/' || user_id % 5 END,
    CASE WHEN event_id % 17 = 0 THEN 'cut off' WHEN event_id % 19 = 0 THEN 'the record {UNINTERPRETED}' END,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), 'exact', user_id::VARCHAR, 'ev.' || event_type || CASE WHEN user_id % 2 = 0 THEN '.even' ELSE '' END,
    '/trail/ev/' || user_id || '.jsonl', 'line:' || event_id, NULL, event_type, json_extract_string(props, '$.k'), event_type = 'error' AND value > 50
  FROM events),
ev AS (
  SELECT *, contains(coalesce(problem, ''), '{UNINTERPRETED}') AS unmapped,
    substr(sha256(concat_ws(chr(0), bundle_uuid, original_path, '', artifact_id, locator, kind)), 1, 32) AS event_id FROM raw)
"""
