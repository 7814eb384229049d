"""Views and reports over a case: what was collected, what was read of it, and what a reader should know before trusting it.

Tables: events (the unified model), files (bundle_uuid, path, artifact_id, agent, size, sha256, mtime, status, attributed_by),
gaps (bundle_uuid, kind, detail, reason), findings (as scans give them).
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailspark.functions.identity import uninterpreted, unreadable
from trailspark.operators import facets, stores, summaries, tools
from trailspark.operators.timeline import session_order

#: The states of a collected file, the order of scopes, and priorities in the order of collection.
STATES = ("parsed", "failed", "no parser", "not collected")
SCOPES = ("managed", "user", "project", "local", "unknown")
PRIORITIES = ("live_only", "first", "normal", "durable")
PREVIEW = 400


def bounds(since: str | None, until: str | None) -> dict[str, str | None]:
    """{since, until, problem} of a window: a day means from its start to its end, a minute to its end; nothing is guessed."""

    def parsed(text: str | None, end: bool) -> tuple[str | None, str | None]:
        if not text:
            return None, None
        shown = lambda t: t.strftime("%Y-%m-%dT%H:%M:%S.%f") + "Z"
        step = timedelta(microseconds=1)
        try:
            if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
                start = datetime.combine(date.fromisoformat(text), datetime.min.time())
                return shown(start + timedelta(days=1) - step if end else start), None
            if found := re.fullmatch(r"(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})Z?", text):
                start = datetime.fromisoformat(f"{found[1]}T{found[2]}")
                return shown(start + timedelta(minutes=1) - step if end else start), None
            if re.fullmatch(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z?", text):
                return shown(datetime.fromisoformat(text.rstrip("Z").replace(" ", "T"))), None
        except ValueError:
            pass
        return None, f"not a time: {text}"

    (low, bad_low), (high, bad_high) = parsed(since, False), parsed(until, True)
    inverted = "the window ends before it begins" if low and high and high < low else None
    said = "; ".join(x for x in (bad_low, bad_high, inverted) if x)
    return {"since": low, "until": high, "problem": said or None}


def by_id(events: DataFrame, event: str) -> DataFrame:
    return events.where(F.col("event_id") == event)


def file_state() -> Column:
    """What became of a collected file: the reader's verdict, no reader, or not collected at all."""
    status = F.col("status")
    return F.when(~F.coalesce(F.col("collected"), F.lit(True)), "not collected").when(status.isin("parsed", "failed"), status).otherwise("no parser")


def dimensions(events: DataFrame) -> dict[str, DataFrame]:
    """users and hosts as tables of their own, keyed by a hash, so that names can be replaced in one place."""
    key = lambda *c: F.substring(F.sha2(F.concat_ws("\u0000", *[F.coalesce(F.col(x), F.lit("")) for x in c]), 256), 1, 16)
    users = events.where("user IS NOT NULL").select("host", "user").distinct().select(key("host", "user").alias("user_key"), "host", "user")
    hosts = events.where("host IS NOT NULL").select("host").distinct().select(key("host").alias("host_key"), "host")
    return {"users": users, "hosts": hosts}


def pseudonyms(table: DataFrame, name: str, key: str, prefix: str) -> DataFrame:
    """A dimension with its names replaced by ones that say nothing; keys stay, so events need no change."""
    return table.withColumn(name, F.concat(F.lit(prefix), F.substring(key, 1, 8)))


def with_dimensions(events: DataFrame, users: DataFrame, hosts: DataFrame) -> DataFrame:
    """Events with the keys of their user and host. Both are null-safe: a user without a host is a user."""
    u, h = users.alias("u"), hosts.alias("h")
    e = events.alias("e")
    joined = e.join(u, (F.col("e.user") == F.col("u.user")) & F.col("e.host").eqNullSafe(F.col("u.host")), "left").join(h, F.col("e.host") == F.col("h.host"), "left")
    return joined.select("e.*", "u.user_key", "h.host_key")


def top_kinds(events: DataFrame, n: int) -> DataFrame:
    """The n most frequent kinds, and one row for all others together."""
    counted = summaries.kind_histogram(events).withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "kind")))  # a row for each kind there is
    named = F.when(F.col("place") <= n, F.col("kind")).otherwise("(other)")
    return counted.groupBy(named.alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))


def instructions_of(events: DataFrame) -> DataFrame:
    """Instruction events with what their payload says of them."""
    said = lambda k: F.get_json_object("payload_json", f"$.instructions[0].{k}")
    text = F.get_json_object("payload_json", "$.text")
    hidden = F.get_json_object("payload_json", "$.instructions[0].hidden_characters")
    return events.where("kind = 'instruction.source'").select(
        "event_id", "bundle_uuid", "agent", "user", "host", "artifact_id", "original_path", "project_path", F.coalesce(said("scope"), F.lit("unknown")).alias("scope"), said("title").alias("title"), F.substring(text, 1, PREVIEW).alias("preview"),
        F.coalesce(F.char_length(text), F.lit(0)).alias("characters"), F.coalesce(said("executable") == "true", F.lit(False)).alias("executable"), said("tools").isNotNull().alias("grants_tools"), hidden.isNotNull().alias("hides_characters"),
        F.coalesce(said("from_json") == "true", F.lit(False)).alias("from_json"), F.get_json_object("payload_json", "$.front_matter").isNotNull().alias("has_front_matter"), F.col("parse_problem").isNotNull().alias("has_problem"), "ts_utc",
    )


def instruction_files(instructions: DataFrame, files: DataFrame) -> DataFrame:
    """Instructions with the time, size and state of their files."""
    facts = files.select("bundle_uuid", F.col("path").alias("original_path"), "mtime", "size", "status")
    return instructions.join(facts, ["bundle_uuid", "original_path"], "left")


def instructions_view(events: DataFrame) -> DataFrame:
    """Instructions with their preview, whether they stand in other files than the one that records them, and the number of equal texts.

    An instruction is recorded elsewhere if it names paths, and none, without what follows a #, is its own file. Order by `scope_order`.
    """
    paths = F.transform(F.from_json(F.get_json_object("payload_json", "$.instructions"), "array<struct<path: string>>"), lambda x: x["path"])
    named = F.filter(paths, lambda p: F.coalesce(p, F.lit("")) != "")
    own = F.coalesce("original_path", F.lit(""))
    elsewhere = (F.size(named) > 0) & F.forall(named, lambda p: F.substring_index(p, "#", 1) != own)
    text = F.get_json_object("payload_json", "$.text")
    # empty texts aren't copies of each other, and would be one key
    extra = events.where("kind = 'instruction.source'").select("event_id", F.coalesce(elsewhere, F.lit(False)).alias("recorded_elsewhere"), F.when(text != "", F.sha2(text, 256)).alias("text_sha256"))
    rows = instructions_of(events).join(extra, "event_id")
    equal = extra.where("text_sha256 IS NOT NULL").groupBy("text_sha256").agg(F.count("*").alias("equal_texts"))
    rank = F.array_position(F.array(*map(F.lit, SCOPES)), F.col("scope"))
    return rows.join(equal, "text_sha256", "left").withColumns({"equal_texts": F.coalesce("equal_texts", F.lit(1)).cast("long"), "scope_order": rank.cast("int")})


def instruction_counts(events: DataFrame) -> DataFrame:
    """Instructions by scope, in all, and with each flag; a row for every scope there may be."""
    flags = ("executable", "grants_tools", "hides_characters", "from_json", "has_front_matter", "has_problem")
    found = instructions_of(events).groupBy("scope").agg(F.count("*").alias("instructions"), *[F.count_if(F.col(f)).alias(f) for f in flags], F.count_if(F.col("characters") == 0).alias("empty"), F.count_if(F.col("project_path").isNotNull()).alias("in_project"))
    every = events.sparkSession.createDataFrame([(s,) for s in SCOPES], "scope string")
    return every.join(found, "scope", "left").fillna(0)


def colliding_ids(events: DataFrame) -> DataFrame:
    """Files in which several records have one identity, and how many records those are too many."""
    return events.groupBy("original_path").agg((F.count("*") - F.countDistinct("event_id")).alias("colliding")).where("colliding > 0")


def ingest_report(files: DataFrame, events: DataFrame, gaps: DataFrame) -> DataFrame:
    """A row for each bundle: how files were attributed and read, what of the events is unread, gaps and collisions."""
    count = lambda test, name: F.count_if(F.coalesce(test, F.lit(False))).alias(name)
    by = F.col("attributed_by")
    read = files.groupBy("bundle_uuid").agg(
        F.count("*").alias("files"), count(by == "collector", "attributed_by_collector"), count(by == "path", "attributed_by_path"), count(by.isNull(), "unattributed"), count(F.col("status") == "parsed", "parsed"), count(F.col("status") == "failed", "failed"),
    )
    made = events.groupBy("bundle_uuid").agg(F.count("*").alias("events"), F.count_if(unreadable()).alias("unreadable"), F.count_if(uninterpreted()).alias("uninterpreted"), (F.count("*") - F.countDistinct("event_id", "original_path")).alias("colliding"))
    missed = gaps.groupBy("bundle_uuid").agg(F.count("*").alias("gaps"))
    return read.join(made, "bundle_uuid", "full_outer").join(missed, "bundle_uuid", "full_outer").fillna(0)


def normalize_report(events: DataFrame) -> DataFrame:
    """Records, unread ones and files by agent."""
    return events.groupBy("agent").agg(F.count("*").alias("records"), F.count_if(unreadable()).alias("unreadable"), F.count_if(uninterpreted()).alias("uninterpreted"), F.count_if(F.col("kind") == "artifact.fs").alias("file_events"), F.countDistinct("original_path").alias("files"))


def artifact_counts(files: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: files, by state, those whose content another file has too, and gaps."""
    copies = files.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("identical_files"))
    states = files.withColumn("state", file_state()).agg(F.count("*").alias("files"), *[F.count_if(F.col("state") == s).alias(s.replace(" ", "_")) for s in STATES])
    return summaries.beside(states, copies, gaps.agg(F.count("*").alias("gaps")))


#: Other paths of equal files that are named; all are counted.
OTHERS = 5


def artifacts_view(files: DataFrame) -> DataFrame:
    """Files with their state, and the number and other paths (the first OTHERS of them) of collected files with the same content.

    Of a group of equal files only its first OTHERS + 1 paths are ever gathered, so that a large one is a small row.
    """
    known = files.where("sha256 IS NOT NULL")
    place = F.row_number().over(W.partitionBy("sha256").orderBy("path"))
    first = known.select("sha256", "path").withColumn("_place", place).where(F.col("_place") <= OTHERS + 1).groupBy("sha256").agg(F.sort_array(F.collect_list("path")).alias("_first"))
    named = known.groupBy("sha256").agg(F.count("*").alias("copies")).where("copies > 1").join(first, "sha256")
    joined = files.join(named, "sha256", "left").withColumns({"state": file_state(), "copies": F.coalesce("copies", F.lit(1)).cast("long")})
    others = F.slice(F.filter("_first", lambda p: p != F.col("path")), 1, OTHERS)
    return joined.withColumns({"same_as": F.when(F.get("_first", F.lit(0)) != F.col("path"), F.get("_first", F.lit(0))), "other_paths": F.when(F.col("copies") > 1, others)}).drop("_first")


def artifacts_export(files: DataFrame, gaps: DataFrame) -> DataFrame:
    """Files and gaps as rows of one table, so that what is missing stands beside what is there."""
    here = files.select("bundle_uuid", F.lit("file").alias("row_kind"), F.col("path").alias("detail"), file_state().alias("state"), F.lit(None).cast("string").alias("reason"))
    return here.unionByName(gaps.select("bundle_uuid", F.lit("gap").alias("row_kind"), "detail", F.col("kind").alias("state"), "reason"))


def subtype_tally(records: DataFrame, subtype: Column) -> DataFrame:
    """How many records of each subtype a file holds, and in how many runs of consecutive ones."""
    order = W.partitionBy("path").orderBy("line_no")
    rows = records.withColumn("subtype", subtype).where("subtype IS NOT NULL")
    rows = rows.withColumn("_new", (~F.coalesce(F.lag("subtype").over(order) == F.col("subtype"), F.lit(False))).cast("long"))
    return rows.groupBy("path", "subtype").agg(F.count("*").alias("records"), F.sum("_new").alias("runs"))


def readers(found: DataFrame, registry: tuple[str, ...], attributed: DataFrame | None = None, path: str = "path") -> DataFrame:
    """(path, artifact_id, read_as): the collector's attribution if it has a reader, else the best claim that has one, else the best claim."""
    claims = found.select(path, "artifact_id", "literal", "rank")
    if attributed is not None:
        own = attributed.where("artifact_id IS NOT NULL").select(path, "artifact_id", F.lit(1 << 30).alias("literal"), F.lit(-1).alias("rank"))
        claims = own.unionByName(claims)
    can = F.col("artifact_id").isin(*registry) if registry else F.lit(False)
    ordered = W.partitionBy(path).orderBy(F.desc("literal"), "rank", "artifact_id")
    placed = claims.withColumns({"place": F.row_number().over(ordered), "_can": can})
    return placed.groupBy(path).agg(F.min_by("artifact_id", "place").alias("artifact_id"), F.min_by("artifact_id", F.when(F.col("_can"), F.col("place"))).alias("read_as"))


def other_claimants(found: DataFrame, path: str = "path") -> DataFrame:
    """(path, artifact_id, others): the artifacts that claim a path beside the best one."""
    ordered = W.partitionBy(path).orderBy(F.desc("literal"), "rank", "artifact_id")
    placed = found.withColumn("place", F.row_number().over(ordered))
    rest = F.array_sort(F.collect_set(F.when(F.col("place") > 1, F.col("artifact_id"))))
    return placed.groupBy(path).agg(F.min_by("artifact_id", "place").alias("artifact_id"), rest.alias("others"))


def reader_coverage(catalogue: DataFrame, registry: tuple[str, ...], generic: tuple[str, ...] = ()) -> DataFrame:
    """For each agent of a catalogue (artifact_id, agent, category): transcripts read of all, artifacts read, read only as they are, not read."""
    own, floor = F.col("artifact_id").isin(*registry) if registry else F.lit(False), F.col("artifact_id").isin(*generic) if generic else F.lit(False)
    rows = catalogue.select("agent", "artifact_id", "category").distinct()
    transcript = F.col("category") == "transcript"
    return rows.groupBy("agent").agg(
        F.count_if(transcript).alias("transcripts"), F.count_if(transcript & own).alias("transcripts_read"), F.count("*").alias("artifacts"), F.count_if(own & ~floor).alias("read"), F.count_if(floor).alias("at_floor"), F.count_if(~own & ~floor).alias("not_read")
    )


def missing_wal(databases: DataFrame, patterns: DataFrame, path: str = "path") -> DataFrame:
    """Databases whose write-ahead log no pattern asks for, by its name or by a wildcard. patterns: a catalogue's."""
    from trailspark.operators.artifacts import claims

    logs = databases.select(path, F.concat(F.col(path), F.lit("-wal")).alias("_wal"))
    asked = claims(logs.select(F.col("_wal").alias("path")), patterns).select(F.col("path").alias("_wal")).distinct()
    return logs.join(asked, "_wal", "left_anti").select(path)


def derived_gaps(files: DataFrame, walless: DataFrame) -> DataFrame:
    """Gaps that follow from what was collected: files nobody claims (their number and five names), databases without their log, contested attributions."""
    lone = files.where("attributed_by IS NULL").groupBy("bundle_uuid").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set(F.struct("path"))), 1, 5).alias("_some"))
    unclaimed = lone.select("bundle_uuid", F.lit("unattributed").alias("kind"), F.array_join(F.transform("_some", lambda x: x["path"]), ", ").alias("detail"), F.concat("n", F.lit(" files that no entry claims")).alias("reason"))
    wal = files.join(walless, "path").select("bundle_uuid", F.lit("missing_wal").alias("kind"), F.col("path").alias("detail"), F.lit("its write-ahead log was not asked for").alias("reason"))
    contested = files.where("claimed_as IS NOT NULL AND claimed_as <> artifact_id").select("bundle_uuid", F.lit("attribution").alias("kind"), F.col("path").alias("detail"), F.concat(F.lit("collected as "), "artifact_id", F.lit(", claimed by "), "claimed_as").alias("reason"))
    return unclaimed.unionByName(wal).unionByName(contested)


def top_unread(events: DataFrame, n: int) -> DataFrame:
    """The n artifacts with the most unread records."""
    return summaries.unread_by_artifact(events).orderBy(F.desc(F.col("unreadable") + F.col("uninterpreted")), "artifact_id").limit(n)


def in_collection_order(catalogue: DataFrame, system: str) -> DataFrame:
    """A catalogue's artifacts (artifact_id, systems, priority) of one system, with `place` in the order of collection."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority"))
    rows = catalogue.where(F.array_contains("systems", system))
    return rows.withColumn("place", F.row_number().over(W.orderBy(rank, "artifact_id")))  # a catalogue has hundreds of rows


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has and the other hasn't, with `side`; none if both hold the same, repeated rows too."""
    return a.exceptAll(b).withColumn("side", F.lit("first only")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second only")))


def cell(value: Column, kind: str) -> Column:
    """A value as text for a table of text: lists by semicolons, structs as JSON, true and false, nothing for null."""
    if kind.startswith("array"):
        shown = F.array_join(F.transform(value, lambda x: F.to_json(x) if kind.startswith(("array<struct", "array<map")) else x.cast("string")), "; ")
    elif kind.startswith(("struct", "map", "variant")):
        shown = F.to_json(value)
    else:
        shown = value.cast("string")
    return F.coalesce(shown, F.lit(""))


def export_csv(view: DataFrame, path: str) -> None:
    """A view as CSV files with a header."""
    view.select(*[cell(F.col(c), k).alias(c) for c, k in view.dtypes]).write.option("header", True).csv(path)


def header_notes(events: DataFrame, files: DataFrame, gaps: DataFrame) -> DataFrame:
    """(place, note): what a reader of an export should know first; a note that has nothing to say is left out."""
    counts = summaries.beside(summaries.case_counts(events), files.agg(F.count_if(file_state() != "parsed").alias("unread_files")), gaps.agg(F.count("*").alias("gaps")))
    notes = [
        F.concat("events", F.lit(" events")), *[F.when(F.col(c) > 0, F.concat(c, F.lit(f" {text}"))) for c, text in (
            ("undated", "events without a time"), ("unreadable", "records that nothing could read"), ("uninterpreted", "records read without a mapping"), ("unread_files", "files that weren't read"), ("gaps", "gaps in the collection"))],
    ]
    return counts.select(F.posexplode(F.array_compact(F.array(*notes))).alias("place", "note"))


def case_summary(events: DataFrame) -> DataFrame:
    """(section, name, n): agents, kinds and models with their numbers of events, and artifacts with those unread, as one table."""
    part = lambda rows, section, name: rows.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col("n").cast("long").alias("n"))
    agents = part(events.groupBy("agent").agg(F.count("*").alias("n")), "agent", "agent")
    kinds = part(summaries.kind_histogram(events), "kind", "kind")
    models = part(facets.facet(events, "models").groupBy("model").agg(F.count("*").alias("n")), "model", "model")
    unread = part(summaries.unread_by_artifact(events).withColumn("n", F.col("unreadable") + F.col("uninterpreted")), "unread", "artifact_id")
    return agents.unionByName(kinds).unionByName(models).unionByName(unread)


def session_events(events: DataFrame, agent: str, session: str | None, after: int = 0, limit: int = 2000) -> DataFrame:
    """A page of one session's events, with `next` on each row: where the next page begins, null on the last."""
    rows = events.where((F.col("agent") == agent) & F.col("session_id").eqNullSafe(F.lit(session)) & (F.col("kind") != "artifact.fs"))
    size = max(1, min(limit, 20_000))
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy("agent").orderBy(*session_order())))  # one session
    last = placed.withColumn("_last", F.max("place").over(W.partitionBy("agent")))
    page = last.where((F.col("place") > after) & (F.col("place") <= after + size))
    return page.withColumn("next", F.when(F.col("_last") > after + size, F.lit(after + size))).drop("_last")


def corroboration_view(events: DataFrame) -> DataFrame:
    """Sessions with the stores that name them, and those of the agent that don't."""
    named = stores.named_sessions(events)
    silent = stores.silent_stores(named).groupBy("agent", "session").agg(F.array_join(F.sort_array(F.collect_set("store")), ",").alias("silent"))
    return stores.corroboration(named).join(silent, ["agent", "session"], "left").withColumn("silent", F.coalesce("silent", F.lit("")))


def tools_view(events: DataFrame) -> DataFrame:
    """Tools with their calls, sessions, failures, and calls without a result."""
    found = tools.ledger(tools.tool_calls(events), tools.tool_results(events))
    return found.groupBy("tool").agg(F.count("*").alias("calls"), F.countDistinct("session_id").alias("sessions"), F.count_if(F.coalesce("is_error", F.lit(False))).alias("failures"), F.count_if(F.col("result_id").isNull()).alias("unanswered"))


def findings_view(findings: DataFrame, records: DataFrame) -> DataFrame:
    """Findings by rule, for every rule that a scan ran: one without a finding is scanned, not unknown. records: scan records."""
    ran = records.select(F.explode("rule_ids").alias("rule_id")).distinct()
    counted = findings.groupBy("rule_id").agg(F.count("*").alias("findings"), F.min("ts_utc").alias("first"), F.max("ts_utc").alias("last"))
    joined = ran.withColumn("scanned", F.lit(True)).join(counted, "rule_id", "full_outer")
    return joined.withColumns({"scanned": F.coalesce("scanned", F.lit(False)), "findings": F.coalesce("findings", F.lit(0)).cast("long")})


def pair_prompts(metadata: DataFrame, bodies: DataFrame) -> DataFrame:
    """Prompts of a library, metadata and bodies by prompt_id; a half without the other is kept and named."""
    a, b = metadata.withColumn("_a", F.lit(True)), bodies.withColumn("_b", F.lit(True))
    half = F.when(F.col("_b").isNull(), "no body").when(F.col("_a").isNull(), "no metadata")
    return a.join(b, "prompt_id", "full_outer").withColumn("problem", half).drop("_a", "_b")
