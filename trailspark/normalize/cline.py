"""Cline's command line: documents of messages, manifests of sessions, and what its own tools did, patches included.

Tools' arguments come in every shape that a model writes: one value, a list, or an object that holds either. Shapes are read
to a bounded depth; a call whose arguments say nothing that can be read keeps them, and says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions.text import first_word, host_of, text_of
from trailspark.normalize.records import at, emit, event, first_said, is_a, items, models, nothing, payload, said

#: The agent's own names of its tools, and the version of the documents that were read.
RUN, READ, EDIT, PATCH, FETCH = "run_commands", "read_files", "editor", "apply_patch", "fetch_web_content"
VERSION = "1"
#: The lines of a patch that name a file, and what each does to it.
_OPENS = r"^\*\*\* (Add|Update|Delete) File: (.+)$"
OPERATIONS = {"add": "write", "update": "write", "delete": "delete"}


def patch_files(patch: Column) -> Column:
    """array<struct<path, operation, patch_verb, moved_to, added, removed>> of the files that a patch names, in its order.

    A file's part goes from the line that names it to the next such line; lines that begin with a plus or minus sign are counted.
    """
    plain = F.regexp_replace(patch, r"\r\n?", "\n")
    parts = F.filter(F.split(plain, r"(?m)(?=^\*\*\* (?:Add|Update|Delete) File: )"), lambda p: F.rlike(p, F.lit("(?m)\\A" + _OPENS)))

    def one(part: Column) -> Column:
        lines = F.split(part, "\n")
        verb = F.lower(F.regexp_extract(part, "(?m)\\A" + _OPENS, 1))
        count = lambda sign: F.size(F.filter(lines, lambda x: F.startswith(x, F.lit(sign)))).cast("int")
        moved = F.nullif(F.regexp_extract(part, r"(?m)^\*\*\* Move to: (.+)$", 1), F.lit(""))
        operation = F.try_element_at(F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv]), verb)
        return F.struct(
            F.trim(F.regexp_extract(part, "(?m)\\A" + _OPENS, 2)).alias("path"), operation.alias("operation"), verb.alias("patch_verb"), moved.alias("moved_to"), count("+").alias("added"), count("-").alias("removed"),
        )

    return F.transform(parts, one)


def _texts(v: Column, lists: tuple[str, ...], single, depth: int = 3) -> Column:
    """array<string> of what single() finds in a value, in the items of a list, or in an object's list under one of the names."""
    none = F.array().cast("array<string>")
    if depth == 0:
        return none
    inner = F.coalesce(*[at(v, k) for k in lists])
    below = lambda x: F.flatten(F.transform(items(x), lambda y: _texts(y, lists, single, depth - 1)))
    own = F.array_compact(F.array(single(v)))
    return F.when(is_a(v, "ARRAY"), below(v)).when(is_a(v, "OBJECT") & inner.isNotNull(), below(inner)).otherwise(F.coalesce(own, none))


def commands_in(v: Column) -> Column:
    """array<string> of the commands of a call; an object may name a program and its arguments."""

    def one(x: Column) -> Column:
        program = first_said(x, "command", "cmd")
        words = F.array_join(F.try_variant_get(at(x, "args"), "$", "array<string>"), " ")
        whole = F.when(F.coalesce(words, F.lit("")) != "", F.concat(program, F.lit(" "), words)).otherwise(program)
        return F.when(is_a(x, "STRING"), F.nullif(F.try_variant_get(x, "$", "string"), F.lit(""))).when(is_a(x, "OBJECT"), whole)

    return _texts(v, ("commands",), one)


def paths_in(v: Column) -> Column:
    """array<string> of the paths of a call."""
    one = lambda x: F.when(is_a(x, "STRING"), F.nullif(F.try_variant_get(x, "$", "string"), F.lit(""))).when(is_a(x, "OBJECT"), first_said(x, "path", "file_path", "filePath"))
    return _texts(v, ("files", "file_paths", "paths"), one)


def _call(b: Column, where: Column) -> Column:
    """A tool's call, and an event for what it did: its commands, each of its files, its addresses."""
    name, call, given = F.coalesce(said(b, "name"), F.lit("")), said(b, "id"), at(b, "input")
    run, read, patch = commands_in(given), paths_in(given), F.coalesce(said(given, "input"), F.when(is_a(given, "STRING"), F.try_variant_get(given, "$", "string")), F.lit(""))
    changed = patch_files(patch)
    path, urls = said(given, "path"), F.filter(F.transform(items(at(given, "requests")), lambda x: said(x, "url")), lambda u: u.isNotNull())
    none = lambda c: F.coalesce(F.size(c) == 0, F.lit(True))
    unread = (
        F.when((name == RUN) & none(run), "no command could be read out of the call").when((name == READ) & none(read), "no path could be read out of the call").when((name == EDIT) & path.isNull(), "the call names no path")
        .when((name == PATCH) & none(changed), "the patch names no file in a form that is known").when((name == FETCH) & none(urls), "the call names no address")
    )
    skill = {"skill": F.when(name == "skills", said(given, "skill")), "skill_args": F.when(name == "skills", said(given, "args"))}
    called = event("tool.call", payload(tool=name, tool_use_id=call, input=given, unread=unread, **skill), where, "assistant")
    common = {"tool": name, "tool_use_id": call}
    ran = payload(**common, commands=F.transform(run, lambda c: F.struct(c.alias("command"), first_word(c).alias("executable"))))
    suffix = lambda kind, i=None: F.concat(where, F.lit(f"#{kind}"), F.lit("") if i is None else i.cast("string"))
    file = lambda kind, fields, i: event(kind, payload(**common, files=F.array(fields)), suffix("file", i), "assistant")
    reads = F.transform(read, lambda p, i: file("file.read", F.struct(p.alias("path"), F.lit("read").alias("operation")), i))
    edits = F.array(file("file.write", F.struct(path.alias("path"), F.lit("write").alias("operation")), F.lit(0)))
    writes = F.transform(changed, lambda f, i: file("file.write", f, i))
    reach = F.array(event("network.request", payload(**common, network=F.transform(urls, lambda u: F.struct(u.alias("url"), host_of(u).alias("host")))), suffix("network"), "assistant"))
    did = (
        F.when((name == RUN) & ~none(run), F.array(event("command.exec", ran, suffix("command"), "assistant"))).when((name == READ) & ~none(read), reads).when((name == EDIT) & path.isNotNull(), edits)
        .when((name == PATCH) & ~none(changed), writes).when((name == FETCH) & ~none(urls), reach).otherwise(nothing())
    )
    return F.concat(F.array(called), did)


def _session_of(path: Column) -> Column:
    """The session that a file is named after."""
    return F.nullif(F.regexp_extract(path, r"([^/\\]+?)(?:\.messages)?\.json$", 1), F.lit(""))


def messages(documents: DataFrame, agent: str = "cline_cli") -> DataFrame:
    """Documents of messages (path, place, v, text, problem): a header, the system prompt, and an event for each block of each message.

    Blocks of other types stay unread, with the role that they stand under. A message without a list of blocks stays unread.
    """
    v = F.col("v")
    good = is_a(v, "OBJECT")
    version = said(v, "version")
    other = F.when(good & ~F.coalesce(version == VERSION, F.lit(False)), F.concat(F.lit("written as version "), F.coalesce(version, F.lit("none"))))
    note = F.nullif(F.concat_ws("; ", "problem", F.when(~good & F.col("problem").isNull(), "no JSON object"), other), F.lit(""))
    origin = lambda k: said(v, f"origin.{k}")
    talk = items(at(v, "messages"))
    header = payload(
        text=F.concat(F.size(talk).cast("string"), F.lit(" messages in this session")), role=said(v, "agent"), task_type=said(v, "taskType"), subagent=origin("subagent"), parent_session_id=origin("parentThreadId"),
        origin_mode=origin("mode"), origin_trigger=origin("trigger"), origin_source=origin("source"), version=version,
    )
    prompt = said(v, "system_prompt")
    told = payload(text=prompt, scope=F.lit("session"), instructions=F.array(F.struct(F.concat("path", F.lit("#system_prompt")).alias("path"), F.lit("session").alias("scope"))))

    def message(m: Column, i: Column) -> Column:
        where, time, answer = F.concat(F.lit("#messages["), i.cast("string"), F.lit("]")), said(m, "ts"), F.coalesce(said(m, "role") == "assistant", F.lit(False))
        used = models(said(m, "modelInfo.id"), said(m, "metrics.inputTokens"), said(m, "metrics.outputTokens"), said(m, "metrics.cost"))

        def block(b: Column, j: Column) -> Column:
            at_ = F.concat(where, F.lit(".content["), j.cast("string"), F.lit("]"))
            kind, text = said(b, "type"), payload(text=F.coalesce(text_of(at(b, "text")), F.lit("")), models=used)
            result = payload(tool_use_id=said(b, "tool_use_id"), output=at(b, "content"), text=text_of(at(b, "content")), is_error=F.coalesce(said(b, "is_error") == "true", F.lit(False)))
            return (
                F.when((kind == "text") & answer, F.array(event("assistant.text", text, at_, "assistant"))).when(kind == "text", F.array(event("user.prompt", text, at_, "user")))
                .when(kind == "thinking", F.array(event("assistant.thinking", payload(text=F.coalesce(text_of(at(b, "thinking")), F.lit("")), models=used), at_, "assistant"))).when(kind == "tool_use", _call(b, at_))
                .when(kind == "tool_result", F.array(event("tool.result", result, at_, "tool"))).otherwise(F.array(event("unparsed.record", payload(block=b, message_role=said(m, "role")), at_)))
            )

        blocks = F.flatten(F.transform(F.try_variant_get(at(m, "content"), "$", "array<variant>"), block))
        whole = F.array(event("unparsed.record", payload(message=m), where))
        made = F.when(F.size(blocks) > 0, blocks).otherwise(whole)
        return F.transform(made, lambda e: F.struct(e["kind"].alias("kind"), e["payload_json"].alias("payload_json"), e["suffix"].alias("suffix"), e["actor"].alias("actor"), time.alias("time")))

    instruction = F.when(prompt.isNotNull(), F.array(event("instruction.source", told, "#system_prompt", "system"))).otherwise(nothing())
    first = F.array(event("config.snapshot", header, "#header", "system", said(v, "updated_at")))
    made = F.when(good, F.concat(first, instruction, F.coalesce(F.flatten(F.transform(talk, message)), nothing()))).otherwise(nothing())
    rows = documents.withColumn("problem", note)
    return emit(rows, made, agent=agent, artifact=f"{agent}.messages", time=F.lit(None).cast("string"), kind=F.lit("document of messages"), session_id=F.coalesce(said(v, "sessionId"), _session_of(F.col("path"))))


def manifests(documents: DataFrame, agent: str = "cline_cli") -> DataFrame:
    """Manifests of sessions: a start, the prompt that it was given, and an end if there is a time or a state of one."""
    v = F.col("v")
    good, status, ended = is_a(v, "OBJECT"), said(v, "status"), said(v, "ended_at")
    session = F.coalesce(said(v, "session_id"), _session_of(F.col("path")))
    kept = {k: said(v, k) for k in ("pid", "interactive", "status", "workspace_root", "team_name", "enable_tools", "enable_spawn", "enable_teams", "messages_path", "compaction_path")}
    model = said(v, "model")
    start = event("session.start", payload(text=F.concat(F.lit("session "), F.coalesce(session, F.lit("with no id")), F.lit(" started")), models=models(model), provider=said(v, "provider"), **kept), "#started_at", "system", said(v, "started_at"))
    asked = F.when(said(v, "prompt").isNotNull(), F.array(event("user.prompt", payload(text=said(v, "prompt"), from_manifest=F.lit(True), interactive=said(v, "interactive")), "#prompt", "user", said(v, "started_at")))).otherwise(nothing())
    over = ended.isNotNull() | F.coalesce(status.isin("completed", "failed", "cancelled"), F.lit(False))
    no_time = F.when(ended.isNull(), "the run is over and has no time of its end")
    end = F.when(over, F.array(event("session.end", payload(text=F.concat(F.lit("session "), F.coalesce(status, F.lit("with no status"))), status=status, exit_code=said(v, "exit_code"), note=no_time), "#ended_at", "system", ended))).otherwise(nothing())
    made = F.when(good, F.concat(F.array(start), asked, end)).otherwise(nothing())
    rows = documents.withColumn("problem", F.coalesce("problem", F.when(~good, "no JSON object")))
    return emit(rows, made, agent=agent, artifact=f"{agent}.manifest", time=F.lit(None).cast("string"), kind=F.lit("manifest"), session_id=session, project_path=first_said(v, "cwd", "workspace_root"), client=said(v, "source"))
