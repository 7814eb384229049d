"""Queries on activity: timeline, sessions, tools, bursts, stores, identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions.identity import uninterpreted, unreadable
from trailspark.operators import bursts, stores, summaries, timeline, tools
from trailspark.plans.adapter import EVENTS, conversation_events, events, table, table_events
from trailspark.schema import UNINTERPRETED

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SHOWN = ["event_id", "kind", "agent", "ts_utc", "session_id", "original_path", "locator"]


@query(EVENTS + """SELECT event_id, kind, agent, ts_utc, session_id, original_path, locator FROM ev
WHERE kind IN ('user.prompt', 'tool.call', 'command.exec') AND (ts_utc IS NULL OR ts_utc >= '2024-01-10')""")
def timeline_(spark, sf_dir: str) -> DataFrame:
    found = timeline.within(events(spark, sf_dir), kinds=("user.prompt", "tool.call", "command.exec"), since="2024-01-10")
    return found.select(*SHOWN).orderBy(*timeline.timeline_order())


QUERIES["timeline"], SQL["timeline"] = QUERIES.pop("timeline_"), SQL.pop("timeline_")


@query(EVENTS + """SELECT agent, count(*) AS events, count(*) FILTER (kind = 'unparsed.record' AND NOT unmapped) AS unreadable, count(*) FILTER (unmapped) AS uninterpreted, min(ts_utc) AS first, max(ts_utc) AS last FROM ev GROUP BY agent""")
def agent_summary(spark, sf_dir: str) -> DataFrame:
    return summaries.agent_summary(events(spark, sf_dir))


@query(EVENTS + "SELECT kind, count(*) AS n FROM ev GROUP BY kind")
def kind_histogram(spark, sf_dir: str) -> DataFrame:
    return summaries.kind_histogram(events(spark, sf_dir))


@query(EVENTS + """SELECT count(*) AS events, count(*) FILTER (ts_utc IS NULL) AS undated, count(*) FILTER (kind = 'unparsed.record' AND NOT unmapped) AS unreadable,
count(*) FILTER (unmapped) AS uninterpreted, count(*) FILTER (kind = 'artifact.fs') AS file_events,
count(DISTINCT agent) AS agents, count(DISTINCT original_path) AS files, count(DISTINCT event_id) AS distinct_events FROM ev""")
def case_counts(spark, sf_dir: str) -> DataFrame:
    return summaries.case_counts(events(spark, sf_dir))


def _safe(*values: str) -> str:
    """SQL of a key in which null and '' differ."""
    return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN chr(1) ELSE chr(2) || {v} END || chr(0)" for v in values) + ")"


_SESSIONS = EVENTS + f""", k AS (SELECT *, kind = 'artifact.fs' AS is_fs FROM ev), s AS (
SELECT agent, host, "user", is_fs, CASE WHEN NOT is_fs THEN project END AS project, CASE WHEN NOT is_fs THEN session_id END AS session, count(*) AS events,
  min(ts_utc) AS first, max(ts_utc) AS last, count(*) FILTER (kind = 'unparsed.record' AND NOT unmapped) AS unreadable, count(*) FILTER (ts_utc IS NULL) AS undated,
  string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds,
  {_safe("agent", "host", '"user"', "CASE WHEN is_fs THEN 'true' ELSE 'false' END", "CASE WHEN NOT is_fs THEN project END", "CASE WHEN NOT is_fs THEN session_id END")} AS session_key
FROM k GROUP BY agent, host, "user", is_fs, CASE WHEN NOT is_fs THEN project END, CASE WHEN NOT is_fs THEN session_id END) """


@query(_SESSIONS + "SELECT * FROM s")
def sessions(spark, sf_dir: str) -> DataFrame:
    return summaries.sessions(events(spark, sf_dir))


@query(_SESSIONS + "SELECT agent, project, count(*) AS sessions, sum(events)::BIGINT AS events, min(first) AS first, max(last) AS last FROM s GROUP BY agent, project")
def project_groups(spark, sf_dir: str) -> DataFrame:
    return summaries.project_groups(summaries.sessions(events(spark, sf_dir)))


_TOOLS = EVENTS + """, calls AS (SELECT * FROM ev WHERE kind = 'tool.call'),
results AS (SELECT * FROM (SELECT session_id, use_id, is_error, event_id AS result_id, row_number() OVER (PARTITION BY session_id, use_id ORDER BY ts_utc DESC NULLS LAST, event_id DESC) AS r
  FROM ev WHERE kind = 'tool.result' AND use_id IS NOT NULL) WHERE r = 1) """


@query(_TOOLS + """SELECT c.event_id, c.session_id, c.tool, c.use_id, r.is_error, r.result_id FROM calls c LEFT JOIN results r ON c.session_id = r.session_id AND c.use_id = r.use_id""")
def tool_ledger(spark, sf_dir: str) -> DataFrame:
    rows = table_events(spark, sf_dir)
    return tools.ledger(tools.tool_calls(rows), tools.tool_results(rows)).select("event_id", "session_id", "tool", "use_id", "is_error", "result_id")


@query(_TOOLS + """, top AS (SELECT use_id, max(result_id) AS result_id FROM results GROUP BY use_id)
SELECT c.event_id, c.use_id, t.result_id FROM calls c LEFT JOIN top t ON c.use_id = t.use_id""")
def tool_ledger_by_id(spark, sf_dir: str) -> DataFrame:
    rows = table_events(spark, sf_dir)
    return tools.ledger(tools.tool_calls(rows), tools.tool_results(rows), strict=False).select("event_id", "use_id", "result_id")


@query(_TOOLS + """SELECT event_id, session_id, use_id FROM calls c WHERE EXISTS (SELECT 1 FROM results r WHERE r.is_error AND r.session_id = c.session_id AND r.use_id = c.use_id)""")
def failed_calls(spark, sf_dir: str) -> DataFrame:
    rows = table_events(spark, sf_dir)
    return tools.failed(tools.tool_calls(rows), tools.tool_results(rows)).select("event_id", "session_id", "use_id")


@query(_TOOLS + "SELECT tool, count(*) AS calls, count(DISTINCT session_id) AS sessions FROM calls GROUP BY tool")
def tool_counts(spark, sf_dir: str) -> DataFrame:
    return tools.tool_counts(tools.tool_calls(table_events(spark, sf_dir)))


@query("""WITH e AS (SELECT user_id::VARCHAR AS session_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view' AND event_id % 17 <> 0 AND event_id % 23 <> 0),
c AS (SELECT session_id, t, count(*) OVER w AS size, min(t) OVER w AS first FROM e WINDOW w AS (PARTITION BY session_id ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY size DESC, t) AS p FROM c)
SELECT session_id, size, first, t AS last FROM r WHERE p = 1 AND size >= 2""")
def burst(spark, sf_dir: str) -> DataFrame:
    views = table_events(spark, sf_dir).where("kind = 'file.read'")
    return bursts.bursts(views, ["session_id"], minutes=24 * 60, least=2)


@query("""SELECT user_id::VARCHAR AS session_id, count(*) AS size, min(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')) AS first, max(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')) AS last
FROM events WHERE event_type = 'purchase' AND event_id % 17 <> 0 AND event_id % 23 <> 0 GROUP BY user_id HAVING count(*) >= 3""")
def large_group(spark, sf_dir: str) -> DataFrame:
    return bursts.large_groups(table_events(spark, sf_dir).where("kind = 'command.exec'"), ["session_id"], 3)


@query(EVENTS + """SELECT agent, session_id, count(DISTINCT coalesce(use_id, chr(0) || 'absent')) AS size, min(ts_utc) AS first, max(ts_utc) AS last FROM ev
GROUP BY agent, session_id HAVING count(DISTINCT coalesce(use_id, chr(0) || 'absent')) >= 4""")
def distinct_group(spark, sf_dir: str) -> DataFrame:
    return bursts.large_groups(events(spark, sf_dir), ["agent", "session_id"], 4, tools.said("tool_use_id"))


@query(EVENTS + "SELECT session_id, count(*) AS size FROM ev WHERE ts_utc IS NULL GROUP BY session_id HAVING count(*) >= 3")
def undated_groups(spark, sf_dir: str) -> DataFrame:
    return bursts.undated_groups(events(spark, sf_dir), ["session_id"], 3)


_NAMED = EVENTS + """, named AS (SELECT agent, session_id AS session, artifact_id AS store, count(*) AS events, min(ts_utc) AS first, max(ts_utc) AS last
FROM ev WHERE trim(session_id) <> '' AND kind <> 'artifact.fs' GROUP BY ALL) """


@query(_NAMED + "SELECT * FROM named")
def named_sessions(spark, sf_dir: str) -> DataFrame:
    return stores.named_sessions(events(spark, sf_dir))


@query(_NAMED + """SELECT agent, session, count(DISTINCT store) AS stores, sum(events)::BIGINT AS events, string_agg(DISTINCT store, ',' ORDER BY store) AS named_by,
count(DISTINCT store) > 1 AS corroborated FROM named GROUP BY agent, session""")
def corroboration(spark, sf_dir: str) -> DataFrame:
    return stores.corroboration(stores.named_sessions(events(spark, sf_dir)))


@query(_NAMED + """SELECT a.agent, a.session, b.store FROM (SELECT DISTINCT agent, session FROM named) a JOIN (SELECT DISTINCT agent, store FROM named) b ON a.agent = b.agent
WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.agent = a.agent AND n.session = a.session AND n.store = b.store)""")
def silent_stores(spark, sf_dir: str) -> DataFrame:
    return stores.silent_stores(stores.named_sessions(events(spark, sf_dir)))


@query(_NAMED + """, p AS (SELECT DISTINCT a.agent, a.store AS a, b.store AS b FROM named a JOIN named b ON a.agent = b.agent AND a.store < b.store),
c AS (SELECT p.agent, p.a, p.b, (SELECT count(*) FROM named x JOIN named y ON x.session = y.session AND x.agent = y.agent WHERE x.agent = p.agent AND x.store = p.a AND y.store = p.b) AS "both",
  (SELECT count(*) FROM named x WHERE x.agent = p.agent AND x.store = p.a) AS na, (SELECT count(*) FROM named x WHERE x.agent = p.agent AND x.store = p.b) AS nb FROM p)
SELECT agent, a, b, "both", na - "both" AS a_only, nb - "both" AS b_only, CASE WHEN "both" = 0 THEN 'none' WHEN na = "both" AND nb = "both" THEN 'complete' ELSE 'partial' END AS overlap FROM c""")
def store_overlap(spark, sf_dir: str) -> DataFrame:
    return stores.store_overlap(stores.named_sessions(events(spark, sf_dir)))


@query(EVENTS + """SELECT event_id, session_id FROM ev c WHERE kind = 'tool.call' AND NOT EXISTS (SELECT 1 FROM ev r WHERE r.kind = 'tool.result' AND r.tool = 'error' AND r.is_error AND r.agent = c.agent AND r.session_id = c.session_id)""")
def prompts_without_transcript(spark, sf_dir: str) -> DataFrame:
    rows = table_events(spark, sf_dir)
    failed = rows.where((F.col("kind") == "tool.result") & (tools.said("is_error") == "true"))
    return stores.prompts_without_transcript(rows.where("kind = 'tool.call'"), failed).select("event_id", "session_id")


@query("""WITH c AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN md5(text) END AS fact FROM conversations)
SELECT conv_id, turn, last_value(fact IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS fact FROM c""")
def carry_forward(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.md5("text")).alias("fact"))
    return timeline.carried(rows, ["fact"], ["conv_id"], [F.asc("turn"), F.asc("role")]).select("conv_id", "turn", "fact")


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN role END AS message FROM conversations),
b AS (SELECT *, CASE WHEN lag(message) OVER w = message THEN 0 ELSE 1 END AS starts FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, sum(starts) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS turn_no FROM b""")
def turns(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", F.col("role")).alias("message"))
    return timeline.turns(rows, "message", ["conv_id"], [F.asc("turn")]).select("conv_id", "turn", "turn_no")


@query("""WITH c AS (SELECT conv_id, turn AS seq, sha256(text) AS sha, CASE WHEN turn % 5 <> 3 THEN lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) END AS prev FROM conversations),
p AS (SELECT *, concat_ws('; ', CASE WHEN seq <> row_number() OVER w - 1 THEN 'number out of sequence' END, CASE WHEN prev IS DISTINCT FROM lag(sha) OVER w THEN 'previous hash differs' END) AS s
FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY seq)) SELECT conv_id, seq, nullif(s, '') AS problem FROM p""")
def custody_chain(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    before = F.lag(F.sha2("text", 256)).over(W.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), F.sha2("text", 256).alias("sha256"), F.when(F.col("turn") % 5 != 3, before).alias("prev_sha256"))
    return timeline.chain_problems(rows, ["conv_id"]).select("conv_id", "seq", "problem")


@query(EVENTS + "SELECT DISTINCT event_id, kind, session_id FROM ev")
def distinct_events(spark, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return timeline.distinct_events(rows.unionByName(rows.where("kind = 'tool.call'"))).select("event_id", "kind", "session_id")


@query(EVENTS + "SELECT event_id FROM ev WHERE kind <> 'tool.call'")
def idempotent_append(spark, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return timeline.append_new(rows.where("kind = 'tool.call'"), rows.unionByName(rows)).select("event_id")


@query(EVENTS + """, c AS (SELECT event_id, CASE WHEN session_id::BIGINT % 7 = 0 THEN 'made.up' ELSE kind END AS kind, CASE WHEN session_id::BIGINT % 5 = 0 THEN 'absent' ELSE ts_precision END AS ts_precision, ts_utc FROM ev),
s AS (SELECT event_id, concat_ws('; ', CASE WHEN kind = 'made.up' THEN 'unknown kind' END, CASE WHEN (ts_utc IS NULL) <> (ts_precision = 'absent') THEN 'time and precision disagree' END) AS s FROM c)
SELECT event_id, nullif(s, '') AS problem FROM s""")
def event_validity(spark, sf_dir: str) -> DataFrame:
    number = F.col("session_id").cast("long")
    spoiled = events(spark, sf_dir).withColumns({"kind": F.when(number % 7 == 0, "made.up").otherwise(F.col("kind")), "ts_precision": F.when(number % 5 == 0, "absent").otherwise(F.col("ts_precision"))})
    return timeline.checked(spoiled).select("event_id", "problem")


@query("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events)
SELECT user_id, event_id, event_type FROM r WHERE p = 1""")
def latest_upsert(spark, sf_dir: str) -> DataFrame:
    return timeline.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query(EVENTS + """SELECT event_id, session_id, locator FROM ev WHERE agent = 'conv_agent' ORDER BY original_path, length(locator), locator, kind LIMIT 101""")
def session_page(spark, sf_dir: str) -> DataFrame:
    return timeline.page(conversation_events(spark, sf_dir), 100).select("event_id", "session_id", "locator")


@query(EVENTS + f""", p AS (SELECT artifact_id, original_path, CASE WHEN length(body) % 9 = 0 THEN 'unparsed.record' ELSE kind END AS kind,
CASE WHEN length(body) % 4 = 0 THEN 'the record {UNINTERPRETED}' END AS problem FROM ev WHERE agent = 'conv_agent')
SELECT artifact_id, count(DISTINCT original_path) AS files, count(*) FILTER (kind = 'unparsed.record' AND problem IS NULL) AS unreadable, count(*) FILTER (problem IS NOT NULL) AS uninterpreted
FROM p GROUP BY artifact_id""")
def unread_by_artifact(spark, sf_dir: str) -> DataFrame:
    size = F.length(F.get_json_object("payload_json", "$.text"))
    rows = conversation_events(spark, sf_dir).withColumns(
        {"kind": F.when(size % 9 == 0, "unparsed.record").otherwise(F.col("kind")), "parse_problem": F.when(size % 4 == 0, f"the record {UNINTERPRETED}")}
    )
    return summaries.unread_by_artifact(rows)


@query(EVENTS + f""", p AS (SELECT event_id, CASE WHEN length(body) % 9 = 0 THEN 'unparsed.record' ELSE kind END AS kind, length(body) % 4 = 0 AS u FROM ev WHERE agent = 'conv_agent')
SELECT event_id, u AS uninterpreted, kind = 'unparsed.record' AND NOT u AS unreadable FROM p""")
def unread_flags(spark, sf_dir: str) -> DataFrame:
    size = F.length(F.get_json_object("payload_json", "$.text"))
    rows = conversation_events(spark, sf_dir).withColumns(
        {"kind": F.when(size % 9 == 0, "unparsed.record").otherwise(F.col("kind")), "parse_problem": F.when(size % 4 == 0, f"the record {UNINTERPRETED}")}
    )
    return rows.select("event_id", uninterpreted().alias("uninterpreted"), unreadable().alias("unreadable"))
