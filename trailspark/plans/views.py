"""Queries on views and reports, on formats, and on normalized records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions import text as T
from trailspark.normalize import chats, documents
from trailspark.operators import artifacts, summaries, views
from trailspark.plans.adapter import EVENTS, conversation_events, events, table, table_events
from trailspark.rules import scan
from trailspark.rules.scan import Rule
from trailspark.sources.unified import from_records, to_record

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STATE = "CASE WHEN NOT collected THEN 'not collected' WHEN status IN ('parsed', 'failed') THEN status ELSE 'no parser' END"
FILES = f"""
WITH f AS (SELECT doc_id, 'b' || doc_id % 3 AS bundle_uuid, '/f/' || source || '/' || doc_id || '.jsonl' AS path, CASE doc_id % 4 WHEN 0 THEN 'parsed' WHEN 1 THEN 'failed' WHEN 2 THEN 'other' END AS status,
  doc_id % 7 <> 0 AS collected, CASE doc_id % 5 WHEN 0 THEN 'collector' WHEN 1 THEN 'path' WHEN 2 THEN 'path' END AS attributed_by, CASE WHEN doc_id % 5 < 3 THEN 'a' || doc_id % 5 END AS artifact_id,
  CASE WHEN doc_id % 10 = 0 THEN 'z' END AS claimed_as, sha256(text) AS sha256, length(text) AS size FROM documents),
s AS (SELECT *, {_STATE} AS state FROM f),
g AS (SELECT bundle_uuid, 'skipped_by_policy' AS kind, path AS detail, 'too large' AS reason FROM f WHERE NOT collected) """


def files(spark, sf_dir: str) -> DataFrame:
    """Documents as collected files of three bundles, some of them unread, unclaimed or not collected."""
    n = F.col("doc_id")
    by = F.when(n % 5 == 0, "collector").when(n % 5 < 3, "path")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("b"), n % 3).alias("bundle_uuid"), F.concat(F.lit("/f/"), "source", F.lit("/"), n, F.lit(".jsonl")).alias("path"),
        F.when(n % 4 == 0, "parsed").when(n % 4 == 1, "failed").when(n % 4 == 2, "other").alias("status"), (n % 7 != 0).alias("collected"), by.alias("attributed_by"),
        F.when(n % 5 < 3, F.concat(F.lit("a"), n % 5)).alias("artifact_id"), F.when(n % 10 == 0, "z").alias("claimed_as"), F.sha2("text", 256).alias("sha256"), F.char_length("text").cast("long").alias("size"),
    )


def gaps(spark, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("NOT collected").select("bundle_uuid", F.lit("skipped_by_policy").alias("kind"), F.col("path").alias("detail"), F.lit("too large").alias("reason"))


@query(EVENTS + """, u AS (SELECT artifact_id, count(*) FILTER (kind = 'unparsed.record' AND NOT unmapped) + count(*) FILTER (unmapped) AS n FROM ev GROUP BY artifact_id)
SELECT 'agent' AS section, agent AS name, count(*) AS n FROM ev GROUP BY agent UNION ALL SELECT 'kind', kind, count(*) FROM ev GROUP BY kind UNION ALL SELECT 'unread', artifact_id, n FROM u WHERE n > 0""")
def case_summary(spark, sf_dir: str) -> DataFrame:
    return views.case_summary(events(spark, sf_dir))


@query(EVENTS + """, k AS (SELECT kind, count(*) AS n FROM ev GROUP BY kind), p AS (SELECT *, row_number() OVER (ORDER BY n DESC, kind) AS place FROM k)
SELECT CASE WHEN place <= 3 THEN kind ELSE '(other)' END AS kind, sum(n)::BIGINT AS n, count(*) AS kinds FROM p GROUP BY 1""")
def top_kinds(spark, sf_dir: str) -> DataFrame:
    return views.top_kinds(events(spark, sf_dir), 3)


@query(EVENTS + """, c AS (SELECT * FROM ev WHERE kind = 'tool.call'),
r AS (SELECT * FROM (SELECT session_id, use_id, is_error, row_number() OVER (PARTITION BY session_id, use_id ORDER BY ts_utc DESC NULLS LAST, event_id DESC) AS p FROM ev WHERE kind = 'tool.result' AND use_id IS NOT NULL) WHERE p = 1)
SELECT c.tool, count(*) AS calls, count(DISTINCT c.session_id) AS sessions, count(*) FILTER (coalesce(r.is_error, false)) AS failures, count(*) FILTER (r.use_id IS NULL) AS unanswered
FROM c LEFT JOIN r ON c.session_id = r.session_id AND c.use_id = r.use_id GROUP BY c.tool""")
def tools_view(spark, sf_dir: str) -> DataFrame:
    return views.tools_view(table_events(spark, sf_dir))


@query(EVENTS + """, named AS (SELECT agent, session_id AS session, artifact_id AS store, count(*) AS n FROM ev WHERE trim(session_id) <> '' AND kind <> 'artifact.fs' GROUP BY ALL),
stores AS (SELECT DISTINCT agent, store FROM named), c AS (SELECT agent, session, count(DISTINCT store) AS stores, sum(n)::BIGINT AS events, string_agg(DISTINCT store, ',' ORDER BY store) AS named_by, count(DISTINCT store) > 1 AS corroborated FROM named GROUP BY agent, session)
SELECT c.*, coalesce((SELECT string_agg(s.store, ',' ORDER BY s.store) FROM stores s WHERE s.agent = c.agent AND NOT EXISTS (SELECT 1 FROM named n WHERE n.agent = c.agent AND n.session = c.session AND n.store = s.store)), '') AS silent FROM c""")
def corroboration_view(spark, sf_dir: str) -> DataFrame:
    return views.corroboration_view(events(spark, sf_dir))


@query(FILES + """, c AS (SELECT sha256, count(*) AS copies, min(path) AS first_path FROM s WHERE sha256 IS NOT NULL GROUP BY sha256)
SELECT s.path, s.state, coalesce(c.copies, 1)::BIGINT AS copies, CASE WHEN c.copies > 1 AND c.first_path <> s.path THEN c.first_path END AS same_as FROM s LEFT JOIN c ON s.sha256 = c.sha256""")
def artifacts_view(spark, sf_dir: str) -> DataFrame:
    return views.artifacts_view(files(spark, sf_dir)).select("path", "state", "copies", "same_as")


@query(FILES + """SELECT count(*) AS files, count(*) FILTER (state = 'parsed') AS parsed, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'no parser') AS no_parser, count(*) FILTER (state = 'not collected') AS not_collected,
(SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM s WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) > 1)) AS identical_files, (SELECT count(*) FROM g) AS gaps FROM s""")
def artifact_counts(spark, sf_dir: str) -> DataFrame:
    return views.artifact_counts(files(spark, sf_dir), gaps(spark, sf_dir))


@query(FILES + "SELECT bundle_uuid, 'file' AS row_kind, path AS detail, state, NULL::VARCHAR AS reason FROM s UNION ALL SELECT bundle_uuid, 'gap', detail, kind, reason FROM g")
def artifacts_export(spark, sf_dir: str) -> DataFrame:
    return views.artifacts_export(files(spark, sf_dir), gaps(spark, sf_dir))


@query(EVENTS.replace("WITH raw", FILES + ", raw", 1) + """, a AS (SELECT bundle_uuid, count(*) AS files, count(*) FILTER (attributed_by = 'collector') AS attributed_by_collector, count(*) FILTER (attributed_by = 'path') AS attributed_by_path, count(*) FILTER (attributed_by IS NULL) AS unattributed,
  count(*) FILTER (status = 'parsed') AS parsed, count(*) FILTER (status = 'failed') AS failed FROM f GROUP BY bundle_uuid),
e AS (SELECT bundle_uuid, count(*) AS events, count(*) FILTER (kind = 'unparsed.record' AND NOT unmapped) AS unreadable, count(*) FILTER (unmapped) AS uninterpreted, count(*) - count(DISTINCT event_id || original_path) AS colliding FROM ev GROUP BY bundle_uuid),
m AS (SELECT bundle_uuid, count(*) AS gaps FROM g GROUP BY bundle_uuid)
SELECT a.*, coalesce(events, 0) AS events, coalesce(unreadable, 0) AS unreadable, coalesce(uninterpreted, 0) AS uninterpreted, coalesce(colliding, 0) AS colliding, coalesce(gaps, 0) AS gaps FROM a LEFT JOIN e USING (bundle_uuid) LEFT JOIN m USING (bundle_uuid)""")
def ingest_report(spark, sf_dir: str) -> DataFrame:
    return views.ingest_report(files(spark, sf_dir), events(spark, sf_dir), gaps(spark, sf_dir))


@query(EVENTS + """SELECT agent, count(*) AS records, count(*) FILTER (kind = 'unparsed.record' AND NOT unmapped) AS unreadable, count(*) FILTER (unmapped) AS uninterpreted, count(*) FILTER (kind = 'artifact.fs') AS file_events, count(DISTINCT original_path) AS files FROM ev GROUP BY agent""")
def normalize_report(spark, sf_dir: str) -> DataFrame:
    return views.normalize_report(events(spark, sf_dir))


@query(FILES + """, l AS (SELECT bundle_uuid, path, count(*) OVER (PARTITION BY bundle_uuid) AS n, row_number() OVER (PARTITION BY bundle_uuid ORDER BY path) AS p FROM f WHERE attributed_by IS NULL)
SELECT bundle_uuid, 'unattributed' AS kind, string_agg(path, ', ' ORDER BY path) AS detail, any_value(n) || ' files that no entry claims' AS reason FROM l WHERE p <= 5 GROUP BY bundle_uuid
UNION ALL SELECT bundle_uuid, 'missing_wal', path, 'its write-ahead log was not asked for' FROM f WHERE path LIKE '%3.jsonl'
UNION ALL SELECT bundle_uuid, 'attribution', path, 'collected as ' || artifact_id || ', claimed by ' || claimed_as FROM f WHERE claimed_as <> artifact_id""")
def derived_gaps(spark, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    return views.derived_gaps(rows, rows.where("path LIKE '%3.jsonl'").select("path"))


@query(EVENTS.replace("WITH raw", FILES + ", raw", 1) + """, c AS (SELECT count(*) AS events, count(*) FILTER (ts_utc IS NULL) AS undated, count(*) FILTER (kind = 'unparsed.record' AND NOT unmapped) AS unreadable, count(*) FILTER (unmapped) AS uninterpreted,
  (SELECT count(*) FROM s WHERE state <> 'parsed') AS unread, (SELECT count(*) FROM g) AS gaps FROM ev),
n AS (SELECT unnest(list_filter([events || ' events', CASE WHEN undated > 0 THEN undated || ' events without a time' END, CASE WHEN unreadable > 0 THEN unreadable || ' records that nothing could read' END,
  CASE WHEN uninterpreted > 0 THEN uninterpreted || ' records read without a mapping' END, CASE WHEN unread > 0 THEN unread || ' files that weren''t read' END, CASE WHEN gaps > 0 THEN gaps || ' gaps in the collection' END], lambda x: x IS NOT NULL)) AS note FROM c)
SELECT (row_number() OVER () - 1)::INTEGER AS place, note FROM n""")
def header_notes(spark, sf_dir: str) -> DataFrame:
    return views.header_notes(events(spark, sf_dir), files(spark, sf_dir), gaps(spark, sf_dir))


@query(EVENTS + "SELECT original_path, count(*) AS colliding FROM ev WHERE kind = 'tool.call' GROUP BY original_path")
def colliding_ids(spark, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return views.colliding_ids(rows.unionByName(rows.where("kind = 'tool.call'")))


@query("""WITH c AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS fresh FROM conversations)
SELECT '/c/' || conv_id AS path, role AS subtype, count(*) AS records, sum(fresh)::BIGINT AS runs FROM c GROUP BY conv_id, role""")
def subtype_tally(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("/c/"), "conv_id").alias("path"), F.col("turn").alias("line_no"), "role")
    return views.subtype_tally(rows, F.col("role"))


@query(EVENTS + """SELECT event_id, CASE WHEN "user" IS NOT NULL THEN substr(sha256(coalesce(host, '') || chr(0) || "user"), 1, 16) END AS user_key, CASE WHEN host IS NOT NULL THEN substr(sha256(host), 1, 16) END AS host_key FROM ev""")
def with_dimensions(spark, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    found = views.dimensions(rows)
    users = views.pseudonyms(found["users"], "shown", "user_key", "user-")
    return views.with_dimensions(rows, users, found["hosts"]).select("event_id", "user_key", "host_key")


@query(EVENTS + """, p AS (SELECT event_id, row_number() OVER (ORDER BY ts_utc NULLS FIRST, original_path, length(locator), locator, kind) AS place, count(*) OVER () AS n FROM ev WHERE agent = 'ev_agent' AND session_id = '7' AND kind <> 'artifact.fs')
SELECT event_id, place::INTEGER AS place, CASE WHEN n > 15 THEN 15 END AS next FROM p WHERE place > 5 AND place <= 15""")
def session_events(spark, sf_dir: str) -> DataFrame:
    return views.session_events(events(spark, sf_dir), "ev_agent", "7", 5, 10).select("event_id", "place", "next")


@query(EVENTS + "SELECT event_id, CASE kind WHEN 'tool.call' THEN 'first only' ELSE 'second only' END AS side FROM ev WHERE kind IN ('tool.call', 'file.read')")
def differences(spark, sf_dir: str) -> DataFrame:
    ids = events(spark, sf_dir).select("event_id", "kind")
    return views.differences(ids.where("kind <> 'file.read'").select("event_id"), ids.where("kind <> 'tool.call'").select("event_id"))


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS prompt_id, CASE WHEN l.doc_id IS NULL THEN 'no body' WHEN d.doc_id IS NULL THEN 'no metadata' END AS problem
FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def pair_prompts(spark, sf_dir: str) -> DataFrame:
    metadata = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("prompt_id"))
    return views.pair_prompts(metadata, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("prompt_id")).distinct()).select("prompt_id", "problem")


_MARK_RULES = [
    Rule("V-1", "Errors", "high", {"field": "payload.is_error", "equals": "true"}, kinds=("tool.result",)), Rule("V-2", "Calls", "info", {"field": "kind", "equals": "tool.call"}),
    Rule("V-3", "Never", "low", {"field": "kind", "equals": "plan.write"}),
]
_MARKED = EVENTS + """, x AS (SELECT 'V-1' AS rule_id, 1 AS severity, * FROM ev WHERE (kind = 'tool.result' OR unmapped) AND is_error UNION ALL SELECT 'V-2', 4, * FROM ev WHERE kind = 'tool.call') """


@query(_MARKED + """SELECT r.id AS rule_id, true AS scanned, count(x.event_id) AS findings FROM (VALUES ('V-1'), ('V-2'), ('V-3')) r(id) LEFT JOIN x ON x.rule_id = r.id GROUP BY r.id""")
def findings_view(spark, sf_dir: str) -> DataFrame:
    rows = table_events(spark, sf_dir)
    found = scan.scan_events(rows, _MARK_RULES)
    return views.findings_view(found, scan.scan_record(rows, _MARK_RULES, found, "run")).select("rule_id", "scanned", "findings")


@query(_MARKED + """, s AS (SELECT agent, session_id AS session, count(*) FILTER (kind = 'unparsed.record' AND NOT unmapped) > 0 AS has_unread FROM ev WHERE agent = 'ev_agent' AND kind <> 'artifact.fs' GROUP BY ALL),
m AS (SELECT session_id AS session, count(*) AS findings, min(severity) AS worst FROM x GROUP BY session_id)
SELECT s.session, coalesce(m.findings, 0) AS findings, CASE m.worst WHEN 1 THEN 'high' WHEN 4 THEN 'info' END AS worst, s.has_unread FROM s LEFT JOIN m ON s.session = m.session""")
def session_marks(spark, sf_dir: str) -> DataFrame:
    rows = table_events(spark, sf_dir)
    found = scan.session_marks(summaries.sessions(rows), scan.scan_events(rows, _MARK_RULES))
    return found.where("NOT is_fs").select("session", "findings", "worst", "has_unread")


def _written(rows: DataFrame) -> DataFrame:
    """Events as lines of a unified log."""
    text = rows.select(to_record().alias("value"))
    return text.select(F.lit("/log").alias("path"), F.lit(1).alias("line_no"), F.col("value").alias("text"), "value", F.lit(None).cast("string").alias("problem"))


@query(EVENTS + """SELECT event_id, kind, agent, ts_utc, session_id, locator, problem AS parse_problem, body FROM ev""")
def unified_round_trip(spark, sf_dir: str) -> DataFrame:
    """Events written as records of the log and read again."""
    back = from_records(_written(events(spark, sf_dir)))
    return back.select("event_id", "kind", "agent", "ts_utc", "session_id", "locator", "parse_problem", F.get_json_object("payload_json", "$.text").alias("body"))


@query(EVENTS + """, n AS (SELECT *, session_id::BIGINT % 6 AS c FROM ev WHERE agent = 'conv_agent')
SELECT locator || session_id AS place, CASE WHEN c IN (0, 1) THEN 'unparsed.record' ELSE kind END AS kind, CASE c WHEN 0 THEN 'unknown kind odd' WHEN 1 THEN 'the record names no agent' WHEN 2 THEN 'no usable provenance, so the log stands in for it'
  WHEN 3 THEN 'the stated id doesn''t follow from the provenance' WHEN 4 THEN 'a time of unknown precision, taken as seconds' END AS problem FROM n""")
def unified_problems(spark, sf_dir: str) -> DataFrame:
    """Records of the log spoiled in one of five ways."""
    rows = conversation_events(spark, sf_dir).withColumn("raw_json", F.to_json(F.struct(F.concat("locator", "session_id").alias("place"))))
    lines = _written(rows).withColumn("_c", F.get_json_object("value", "$.session_id").cast("long") % 6)
    changed = (
        F.when(F.col("_c") == 0, F.regexp_replace("value", '"kind":"[^"]*"', '"kind":"odd"')).when(F.col("_c") == 1, F.regexp_replace("value", '"agent":"[^"]*"', '"agent":""'))
        .when(F.col("_c") == 2, F.regexp_replace("value", '"original_path":"[^"]*"', '"original_path":""')).when(F.col("_c") == 3, F.regexp_replace("value", '"event_id":"[^"]*"', '"event_id":"0"'))
        .when(F.col("_c") == 4, F.regexp_replace("value", '"ts_utc":null,"ts_precision":"absent"', '"ts_utc":"2024-01-01T00:00:00Z","ts_precision":"soon"')).otherwise(F.col("value"))
    )
    found = from_records(lines.withColumn("value", changed))
    # a provenance that stands in changes the id, which is said too
    said = F.regexp_replace("parse_problem", "; the stated id doesn't follow from the provenance$", "")
    return found.select(F.get_json_object("raw_json", "$.place").alias("place"), "kind", said.alias("problem"))


@query("""SELECT conv_id::VARCHAR AS session_id, 'line:' || turn AS locator, CASE role WHEN 'user' THEN 'user.prompt' WHEN 'assistant' THEN 'assistant.text' ELSE 'unparsed.record' END AS kind,
CASE WHEN role IN ('user', 'assistant') THEN text END AS body, CASE role WHEN 'assistant' THEN 'm' || conv_id % 3 END AS model FROM conversations""")
def claude_transcripts(spark, sf_dir: str) -> DataFrame:
    """Conversations as transcript lines, normalized."""
    message = F.struct(F.col("text").alias("content"), F.when(F.col("role") == "assistant", F.concat(F.lit("m"), F.col("conv_id") % 3)).alias("model"))
    value = F.to_json(F.struct(F.col("role").alias("type"), F.col("conv_id").cast("string").alias("sessionId"), message.alias("message")))
    lines = table(spark, sf_dir, "conversations").select(F.concat(F.lit("/t/"), "conv_id").alias("path"), F.col("turn").alias("line_no"), value.alias("text"), value.alias("value"), F.lit(None).cast("string").alias("problem"))
    found = chats.claude(lines)
    said = lambda p: F.get_json_object("payload_json", p)
    return found.select("session_id", "locator", "kind", said("$.text").alias("body"), said("$.models[0].model").alias("model"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, max(CASE WHEN event_type = 'view' THEN ts END) OVER w AS seen, last_value(CASE WHEN event_type = 'purchase' THEN 'm' || event_id END IGNORE NULLS) OVER w AS model
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, CASE event_type WHEN 'purchase' THEN 'config.snapshot' WHEN 'click' THEN 'user.prompt' WHEN 'error' THEN 'tool.result' ELSE 'unparsed.record' END AS kind, CASE WHEN event_type IN ('click', 'error', 'purchase') THEN model END AS model FROM e""")
def copilot_sessions(spark, sf_dir: str) -> DataFrame:
    """Events as session records whose model changes hold for what follows."""
    kinds = F.create_map(*[F.lit(x) for kv in {"purchase": "session.model_change", "click": "user.message", "error": "tool.execution_complete"}.items() for x in kv])
    data = F.struct(F.when(F.col("event_type") == "purchase", F.concat(F.lit("m"), "event_id")).alias("newModel"), F.lit("x").alias("content"))
    value = F.to_json(F.struct(F.coalesce(F.element_at(kinds, F.col("event_type")), F.lit("later")).alias("type"), data.alias("data")))
    lines = table(spark, sf_dir, "events").select(F.concat(F.lit("/p/"), "user_id").alias("path"), F.col("event_id").alias("line_no"), value.alias("text"), value.alias("value"), F.lit(None).cast("string").alias("problem"))
    return chats.copilot(lines).select(F.substring("locator", 6, 20).cast("long").alias("event_id"), "kind", F.get_json_object("payload_json", "$.models[0].model").alias("model"))


@query("""WITH c AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id::VARCHAR AS session_id, 'document#messages[' || i || ']' AS locator, text AS body FROM c UNION ALL SELECT DISTINCT conv_id::VARCHAR, 'document', NULL FROM conversations""")
def split_documents(spark, sf_dir: str) -> DataFrame:
    """Conversations as one JSON document each, split by the floor for documents."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    text = F.to_json(F.struct(F.col("conv_id").cast("string").alias("sessionId"), F.transform("m", lambda x: F.struct(x["text"].alias("text"))).alias("messages")))
    docs = rows.select(F.concat(F.lit("/d/"), "conv_id").alias("path"), F.lit("document").alias("place"), text.alias("text"), F.try_parse_json(text).alias("v"), F.lit(None).cast("string").alias("problem"))
    found = documents.generic_documents(docs, "x", "x.d")
    return found.select("session_id", "locator", F.get_json_object("payload_json", "$.text").alias("body"))


@query("""WITH d AS (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN '/etc/x/' WHEN 1 THEN '/work/a/' WHEN 2 THEN '/work/b/' ELSE '/home/u/' END || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.local.md' WHEN doc_id % 11 = 0 THEN '.sh' ELSE '.md' END AS path FROM documents)
SELECT doc_id, CASE WHEN path LIKE '/etc/%' THEN 'managed' WHEN path LIKE '%.local.md' THEN 'local' WHEN path LIKE '/work/%' THEN 'project' ELSE 'user' END AS scope,
CASE WHEN path NOT LIKE '%.sh' AND doc_id % 2 = 0 THEN 'Title ' || doc_id END AS title, path LIKE '%.sh' AS executable, (octet_length(encode(CASE WHEN doc_id % 2 = 0 THEN '# Title ' || doc_id || chr(10) ELSE '' END || text)))::BIGINT AS bytes FROM d""")
def instruction_scopes(spark, sf_dir: str) -> DataFrame:
    """Documents as instruction files of four places."""
    n = F.col("doc_id")
    place = F.when(n % 5 == 0, "/etc/x/").when(n % 5 == 1, "/work/a/").when(n % 5 == 2, "/work/b/").otherwise("/home/u/")
    path = F.concat(place, n.cast("string"), F.when(n % 7 == 0, ".local.md").when(n % 11 == 0, ".sh").otherwise(".md"))
    text = F.concat(F.when(n % 2 == 0, F.concat(F.lit("# Title "), n.cast("string"), F.lit("\n"))).otherwise(""), F.regexp_replace("text", r"(?m)^#", "%"))
    docs = table(spark, sf_dir, "documents").select(path.alias("path"), text.alias("text"), F.lit(None).cast("string").alias("problem"))
    found = documents.instructions(docs, "x", "x.i", F.array(F.lit("/work/a"), F.lit("/Work/b/")))
    said = lambda k: F.get_json_object("payload_json", f"$.instructions[0].{k}")
    return found.select(F.regexp_extract("original_path", r"/(\d+)\.", 1).cast("long").alias("doc_id"), said("scope").alias("scope"), said("title").alias("title"), (said("executable") == "true").alias("executable"), said("bytes").cast("long").alias("bytes"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000000Z' END AS ts_utc, CASE WHEN event_id % 2 = 0 THEN 'second' ELSE 'absent' END AS ts_precision FROM events""")
def text_log(spark, sf_dir: str) -> DataFrame:
    """Events as lines of a log; every second one begins with its time."""
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), stamp, F.lit("] "), "event_type")).otherwise(F.concat("event_type", F.lit(" at "), stamp))
    lines = table(spark, sf_dir, "events").select(F.lit("/l").alias("path"), F.col("event_id").alias("line_no"), text.alias("text"))
    return documents.text_log(lines, "x", "x.l").select(F.substring("locator", 6, 20).cast("long").alias("event_id"), "ts_utc", "ts_precision")


@query("""SELECT doc_id::VARCHAR AS event_id, 'T-TEXT' AS rule_id FROM documents WHERE source = 'src1' UNION ALL SELECT doc_id::VARCHAR, 'T-NEST' FROM documents WHERE lang IN ('aa') OR doc_id % 13 = 0 UNION ALL SELECT doc_id::VARCHAR, 'T-CASE' FROM documents WHERE source = 'src2'""")
def nested_rules(spark, sf_dir: str) -> DataFrame:
    """Rules on event text, on nested lists and on the case of a pattern."""
    nested = F.array(F.struct(F.array(F.struct(F.when(F.col("doc_id") % 13 == 0, "hit").otherwise("miss").alias("c"))).alias("b")), F.struct(F.array(F.struct(F.col("lang").alias("c"))).alias("b")))
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("event_id"), F.lit("user.prompt").alias("kind"), F.lit("x").alias("agent"), none.alias("ts_utc"), none.alias("session_id"), none.alias("parse_problem"), none.alias("raw_json"),
        F.to_json(F.struct(nested.alias("a"), F.struct(F.lit("first\nline").alias("note"), F.col("source").alias("source")).alias("where"))).alias("payload_json"),
    )
    rules = [
        Rule("T-TEXT", "t", "low", {"field": "event_text", "regex": "(?m)^source = src1$"}), Rule("T-NEST", "t", "low", {"field": "payload.a[].b[].c", "equals_any": ["hit", "AA"]}),
        Rule("T-CASE", "t", "low", {"field": "payload.where.source", "regex": "^SRC2$", "ignore_case": True}),
    ]
    return scan.scan_events(rows, rules).select("event_id", "rule_id")


_CLAIMS = [("ev.log", "ev_agent", "/trail/ev/*.jsonl", "named"), ("ev.first", "ev_agent", "/trail/ev/1*.jsonl", "plugin"), ("any", "x", "/trail/**", "working")]


@query(EVENTS + """, p AS (SELECT DISTINCT original_path AS path FROM ev)
SELECT path, CASE WHEN path LIKE '/trail/ev/1%' THEN 'ev.first' WHEN path LIKE '/trail/ev/%' THEN 'ev.log' ELSE 'any' END AS artifact_id, CASE WHEN path LIKE '/trail/ev/%' THEN 'ev.log' END AS read_as,
CASE WHEN path LIKE '/trail/ev/1%' THEN 'any,ev.log' WHEN path LIKE '/trail/ev/%' THEN 'any' ELSE '' END AS others FROM p""")
def claimants(spark, sf_dir: str) -> DataFrame:
    """Paths with their best claim, the reader that takes them, and who else claims them."""
    found = artifacts.claims(events(spark, sf_dir).select(F.col("original_path").alias("path")), artifacts.patterns(spark, _CLAIMS))
    others = views.other_claimants(found).select("path", F.array_join("others", ",").alias("others"))
    return views.readers(found, ("ev.log",)).join(others, "path")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text ELSE 'a' || chr(10) || text END AS body FROM documents""")
def message_bodies(spark, sf_dir: str) -> DataFrame:
    """Bodies that are strings, and lists of parts."""
    plain = F.to_json(F.array("text"))
    whole = F.when(F.col("doc_id") % 4 == 0, F.substring(plain, F.lit(2), F.char_length(plain) - 2)).otherwise(F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.lit("a").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))))
    return table(spark, sf_dir, "documents").select("doc_id", T.text_of(F.try_parse_json(whole)).alias("body"))
