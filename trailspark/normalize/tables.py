"""Normalizers of agents' own tables, as they are exported: conversations, their sessions' headers, threads and items.

A table's rows come as any DataFrame with the table's columns; a column that an export lacks counts as null. A row's place is
`table:<name> rowid:<id>`. Headers meet their rows by a left join on the session, so that a row without one is kept, and says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions.text import first_word, host_of, remote_uri, text_of, uri_as_path
from trailspark.normalize.records import Tools, at, emit, event, first_said, is_a, items, models, nothing, payload, said
from trailspark.schema import UNINTERPRETED


def rows_of(rows: DataFrame, store: str, table: str, row_id: str, columns: tuple[str, ...]) -> DataFrame:
    """(path, place, text, problem) and the columns, as text, of a table's rows; text is the whole row as JSON."""
    kinds = dict(rows.dtypes)
    # doubles are written without an exponent, as times are read
    plain = lambda c: F.col(f"`{c}`").cast("decimal(38,9)") if kinds[c] in ("double", "float") else F.col(f"`{c}`")
    known = [(plain(c).cast("string") if c in kinds else F.lit(None).cast("string")).alias(c) for c in columns]
    place = F.format_string(f"table:{table} rowid:%s", F.col(f"`{row_id}`").cast("string"))
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if not c.startswith("_")]))
    return rows.select(*known, F.lit(store).alias("path"), place.alias("place"), whole.alias("text"), F.lit(None).cast("string").alias("problem"))


def _given(name: str) -> Column:
    """A column's text; null if it is empty."""
    return F.nullif(F.col(name), F.lit(""))


def _document(name: str, kind: str = "OBJECT") -> tuple[Column, Column]:
    """A column's JSON as a VARIANT, null if it isn't of that kind, and why it isn't."""
    v = F.try_parse_json(name)
    good = is_a(v, kind)
    why = F.when(F.trim(F.coalesce(name, F.lit(""))) == "", f"the {name} column is empty").when(~good, f"the {name} column is no JSON {kind.lower()}")
    return F.when(good, v), why


def _notes(*parts: Column) -> Column:
    return F.nullif(F.concat_ws("; ", *parts), F.lit(""))


def _number(value: Column) -> Column:
    return value.try_cast("double")


def _headers(sessions: DataFrame, key: str, **facts: Column) -> DataFrame:
    """A row for each session: the facts of its first row by place."""
    made = sessions.where(_given(key).isNotNull()).select(_given(key).alias("_session"), F.struct("place").alias("_order"), F.struct(*[v.alias(k) for k, v in facts.items()]).alias("_header"))
    return made.groupBy("_session").agg(F.min_by("_header", "_order").alias("_header"))


def _with_header(rows: DataFrame, key: Column, headers: DataFrame | None, kind: str) -> DataFrame:
    """rows with `_header` of their session, and a note where there is none. A session's rows may be many, its header is one."""
    rows = rows.withColumn("_session", key)
    if headers is None:
        return rows.withColumns({"_header": F.lit(None).cast(f"struct<{kind}>"), "_lacks": F.lit(None).cast("string")})
    met = rows.join(headers, "_session", "left")
    return met.withColumn("_lacks", F.when(F.col("_session").isNull(), "the row names no session").when(F.col("_header").isNull(), "no row of the session's own is there"))


#: The agents' own names of their tools.
OPENCODE = Tools(
    command=("bash", "shell"), read=("read", "glob", "grep", "list"), write=("write", "edit", "patch", "multiedit"), network=("webfetch", "websearch", "fetch"),
    paths=("filePath", "file_path", "path", "absolute_path"), contents=("content", "newString"),
)
GOOSE = Tools(command=("shell",), read=("tree", "read_image"), write=("write", "edit"), paths=("path", "source"), contents=("content", "file_text", "after"))
HERMES = Tools(
    command=("terminal", "execute_command", "bash"), read=("read_file", "search_files"), write=("write_file", "patch", "edit_file"), network=("web_search", "web_extract", "browser_navigate"), commands=("command", "cmd"),
)
_OPENCODE_SESSION = ("id", "directory", "agent", "model", "title", "version", "parent_id", "share_url", "time_created", "time_archived", "cost", "tokens_input", "tokens_output", "tokens_reasoning", "tokens_cache_read", "tokens_cache_write")


def _model(v: Column) -> Column:
    """A model's name: text, or provider and name as one."""
    provider, name = first_said(v, "providerID", "provider"), first_said(v, "modelID", "model", "id")
    return F.when(is_a(v, "STRING"), F.nullif(F.try_variant_get(v, "$", "string"), F.lit(""))).when(is_a(v, "OBJECT"), F.nullif(F.concat_ws("/", provider, name), F.lit("")))


def opencode(sessions: DataFrame | None, inputs: DataFrame | None, messages: DataFrame | None, store: str, *, row_id: str = "rowid", agent: str = "opencode") -> DataFrame:
    """Events of the tables session, session_input and session_message; one that an export lacks is None.

    A session begins, and ends if it was archived; an admitted prompt is one; a message gives what its type says, an answer
    one event for each of its parts. A message of another type, or whose data is no object, stays unread.
    """
    out = []
    headers = None
    if sessions is not None:
        rows = rows_of(sessions, store, "session", row_id, _OPENCODE_SESSION)
        headers = _headers(rows, "id", directory=_given("directory"), agent_name=_given("agent"))
        model = _given("model")
        tokens = F.struct(*[_number(F.col(f"tokens_{c}")).alias(c) for c in ("input", "output", "reasoning", "cache_read", "cache_write")])
        start = payload(
            text=F.coalesce(_given("title"), F.concat(F.lit("session "), F.coalesce("id", F.lit("")))), agent_name=_given("agent"), models=F.when(model.isNotNull(), F.array(F.struct(model.alias("model")))), parent_session=_given("parent_id"),
            cost=_number(F.col("cost")), tokens=tokens, share_url=_given("share_url"),
        )
        ended = F.when(_given("time_archived").isNotNull(), F.array(event("session.end", payload(text=F.lit("the session was archived")), " archived", "system", F.col("time_archived"))))
        made = F.concat(F.array(event("session.start", start, "", "system", F.col("time_created"))), F.coalesce(ended, nothing()))
        out.append(emit(rows, made, agent=agent, artifact=f"{agent}.session", time=F.lit(None).cast("string"), kind=F.lit("session"), session_id=_given("id"), project_path=_given("directory"), client=_given("version")))
    kind = "directory: string, agent_name: string"
    common = {"session_id": F.col("_session"), "project_path": F.col("_header.directory"), "agent": agent}
    if inputs is not None:
        rows = rows_of(inputs, store, "session_input", row_id, ("session_id", "prompt", "delivery", "admitted_seq", "promoted_seq", "time_created"))
        rows = _with_header(rows, _given("session_id"), headers, kind)
        asked = payload(text=F.coalesce("prompt", F.lit("")), delivery=_given("delivery"), admitted_seq=_number(F.col("admitted_seq")), promoted_seq=_number(F.col("promoted_seq")), source_table=F.lit("session_input"))
        out.append(emit(rows.withColumn("problem", F.col("_lacks")), F.array(event("user.prompt", asked, "", "user")), artifact=f"{agent}.session_input", time=F.col("time_created"), kind=F.lit("input"), **common))
    if messages is not None:
        rows = rows_of(messages, store, "session_message", row_id, ("session_id", "type", "data", "time_created"))
        rows = _with_header(rows, _given("session_id"), headers, kind)
        document, why = _document("data")
        rows = rows.withColumn("v", document).withColumn("problem", _notes(why, F.col("_lacks")))
        of = F.coalesce(_given("type"), said(F.col("v"), "type"))
        made = F.when(F.col("v").isNull(), nothing()).otherwise(_opencode_message(F.col("v"), of, F.col("_header.directory"), store))
        out.append(emit(rows, made, artifact=f"{agent}.session_message", time=F.col("time_created"), kind=of, **common))
    return _together(out)


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _opencode_message(v: Column, of: Column, folder: Column, store: str) -> Column:
    text = said(v, "text")
    model = _model(at(v, "model"))
    used = models(model)
    asked = payload(
        text=F.coalesce(text, F.lit("")), files=F.transform(F.filter(items(at(v, "files")), lambda x: said(x, "uri").isNotNull()), lambda x: F.struct(said(x, "uri").alias("path"), F.lit("unknown").alias("operation"))),
        subagents=F.transform(items(at(v, "agents")), lambda x: said(x, "name")), source_table=F.lit("session_message"),
    )
    told = payload(text=text, scope=F.lit("session"), origin=of, instructions=F.array(F.struct(F.lit(store).alias("path"), F.lit("session").alias("scope"))))
    command = said(v, "command")
    ran = payload(text=command, commands=F.array(F.struct(command.alias("command"), first_word(command).alias("executable"), folder.alias("cwd"))), output=said(v, "output"), tool_use_id=said(v, "callID"))
    changed = F.when(of == "agent-switched", F.concat(F.lit("the agent was changed to "), F.coalesce(said(v, "agent"), F.lit("")))).otherwise(F.concat(F.lit("the model was changed to "), F.coalesce(model, F.lit(""))))
    parts = F.filter(items(at(v, "content")), lambda b: is_a(b, "OBJECT"))
    said_nothing = F.array(event("assistant.text", payload(text=F.lit(""), models=used, finish=said(v, "finish")), "", "assistant"))

    def part(b: Column, i: Column) -> Column:
        where = F.concat(F.lit(" content:"), i.cast("string"))
        body, kind = said(b, "text"), said(b, "type")
        name, call, state = F.coalesce(said(b, "name"), F.lit("")), said(b, "id"), at(b, "state")
        given, status = at(state, "input"), said(state, "status")
        called = event("tool.call", payload(tool=name, tool_use_id=call, input=given, text=name), where, "assistant")
        effect = OPENCODE.effect(F.lower(name), given, call, F.concat(where, F.lit(" effect")), folder)
        outputs = F.array_join(F.transform(items(at(state, "content")), lambda x: F.coalesce(first_said(x, "text", "uri"), F.lit(""))), "\n")
        output = F.coalesce(F.nullif(F.trim(outputs), F.lit("")), text_of(at(state, "result")))
        result = payload(tool=name, tool_use_id=call, output=output, text=output, is_error=status == "error", error=F.when(status == "error", text_of(at(state, "error"))))
        answered = F.when(status.isin("completed", "error"), F.array(event("tool.result", result, F.concat(where, F.lit(" result")), "tool"))).otherwise(nothing())
        return (
            F.when((kind == "text") & body.isNotNull(), F.array(event("assistant.text", payload(text=body, models=used), where, "assistant")))
            .when((kind == "reasoning") & body.isNotNull(), F.array(event("assistant.thinking", payload(text=body), where, "assistant")))
            .when(kind == "tool", F.concat(F.array(called), effect, answered))
            .otherwise(F.array(event("unparsed.record", payload(block=b), where)))
        )

    answered = F.flatten(F.transform(parts, part))
    return (
        F.when(of == "user", F.array(event("user.prompt", asked, "", "user")))
        .when(of.isin("system", "synthetic"), F.array(event("instruction.source", told, "", "system")))
        .when(of == "shell", F.array(event("command.exec", ran, "", "assistant")))
        .when(of.isin("agent-switched", "model-switched"), F.array(event("config.snapshot", payload(text=changed, agent_name=said(v, "agent"), models=used), "", "user")))
        .when(of == "compaction", F.array(event("session.end", payload(text=said(v, "summary"), compaction=F.lit(True), reason=said(v, "reason")), "", "system")))
        .when(of == "assistant", F.when(F.size(answered) > 0, answered).otherwise(said_nothing))
        .otherwise(nothing())
    )


def goose(sessions: DataFrame | None, messages: DataFrame | None, threads: DataFrame | None = None, thread_messages: DataFrame | None = None, store: str = "", *, row_id: str = "rowid", agent: str = "goose") -> DataFrame:
    """Events of the tables sessions and messages, threads and thread_messages; one that an export lacks is None.

    A message gives an event for each block of its content. What a user didn't see, and text that the harness added to a turn,
    say so. A message of another role, without blocks or whose content is no list stays unread.
    """
    out, kind = [], "directory: string"
    for heads, talk, head_name, talk_name, key in ((sessions, messages, "sessions", "messages", "session_id"), (threads, thread_messages, "threads", "thread_messages", "thread_id")):
        headers = None
        if heads is not None:
            rows = rows_of(heads, store, head_name, row_id, ("id", "name", "description", "working_dir", "created_at", "archived_at", "session_type", "goose_mode", "provider_name", "model_config_json", "parent_session_id", "schedule_id", "input_tokens", "output_tokens", "total_tokens", "accumulated_cost"))
            headers = _headers(rows, "id", directory=_given("working_dir"))
            config, why = _document("model_config_json")
            name = F.nullif(F.concat_ws("/", _given("provider_name"), first_said(config, "model_name", "model")), F.lit(""))
            mode = _given("goose_mode")
            start = payload(
                text=F.coalesce(_given("name"), _given("description"), F.lit("a session" if key == "session_id" else "a thread")), models=models(name), session_kind=_given("session_type"),
                permissions=F.when(mode.isNotNull(), F.array(F.struct(mode.alias("mode"), F.lit("set").alias("decision")))), parent_session=_given("parent_session_id"), schedule_id=_given("schedule_id"),
                tokens=F.struct(*[_number(F.col(f"{c}_tokens")).alias(c) for c in ("input", "output", "total")]), cost=_number(F.col("accumulated_cost")),
            )
            ended = F.when(_given("archived_at").isNotNull(), F.array(event("session.end", payload(text=F.lit("archived")), " archived", "system", F.col("archived_at"))))
            made = F.concat(F.array(event("session.start", start, "", "system", F.col("created_at"))), F.coalesce(ended, nothing()))
            rows = rows.withColumn("problem", F.when(_given("model_config_json").isNotNull(), why))
            out.append(emit(rows, made, agent=agent, artifact=f"{agent}.{head_name}", time=F.lit(None).cast("string"), kind=F.lit(head_name), session_id=_given("id"), project_path=_given("working_dir")))
        if talk is not None:
            rows = rows_of(talk, store, talk_name, row_id, (key, "role", "content_json", "metadata_json", "created_timestamp"))
            rows = _with_header(rows, _given(key), headers, kind)
            content, why = _document("content_json", "ARRAY")
            meta, why_meta = _document("metadata_json")
            role = F.coalesce("role", F.lit(""))
            hidden = F.when(F.try_variant_get(meta, "$.userVisible", "string") == "false", "marked as not shown to the user")
            strange = F.when(~role.isin("user", "assistant"), F.concat(F.lit("a role that isn't known: "), role))
            rows = rows.withColumns({"v": content, "m": meta}).withColumn("problem", _notes(why, F.when(_given("metadata_json").isNotNull(), why_meta), hidden, strange, F.col("_lacks")))
            made = F.when(F.col("v").isNull() | ~role.isin("user", "assistant"), nothing()).otherwise(F.flatten(F.transform(items(F.col("v")), lambda b, i: _goose_block(b, i, F.col("m"), role, F.col("_header.directory"), store))))
            out.append(emit(rows, made, agent=agent, artifact=f"{agent}.{talk_name}", time=F.col("created_timestamp"), kind=F.lit("message"), session_id=F.col("_session"), project_path=F.col("_header.directory")))
    return _together(out)


def _goose_block(b: Column, i: Column, m: Column, role: Column, folder: Column, store: str) -> Column:
    where = F.concat(F.lit(" content:"), i.cast("string"))
    kind, text = said(b, "type"), F.coalesce(said(b, "text"), F.lit(""))
    flags = {"user_visible": said(m, "userVisible"), "agent_visible": said(m, "agentVisible")}
    own = F.coalesce(said(m, "turnContext") == "true", F.lit(False))
    added = payload(text=text, scope=F.lit("session"), origin=F.lit("turn_context"), instructions=F.array(F.struct(F.lit(store).alias("path"), F.lit("session").alias("scope"))), **flags)
    answer = event("assistant.text", payload(text=text, models=models(first_said(m, "model", "modelName")), **flags), where, "assistant")
    prompt = event("user.prompt", payload(text=text, **flags), where, "user")
    name, mime = said(b, "name"), said(b, "mimeType")
    attached = payload(text=F.concat(F.lit("["), kind, F.lit(": "), F.coalesce(name, mime, F.lit("no type given")), F.lit("]")), attachment=F.struct(kind.alias("kind"), name.alias("name"), mime.alias("mime_type")))
    call, asked = said(b, "id"), at(b, "toolCall")
    full, given, failed = F.coalesce(said(asked, "value.name"), F.lit("")), at(asked, "value.arguments"), said(asked, "status") == "error"
    # a tool of an extension is called extension__tool
    extension = F.when(F.contains(full, F.lit("__")), F.substring_index(full, "__", 1))
    tool = F.when(extension.isNotNull(), F.substr(full, F.char_length(extension) + 3)).otherwise(full)
    called = payload(tool=F.nullif(full, F.lit("")), tool_use_id=call, input=given, text=F.coalesce(F.nullif(full, F.lit("")), said(asked, "error")), extension=extension, is_error=F.when(failed, F.lit(True)), error=F.when(failed, said(asked, "error")))
    gave = at(b, "toolResult")
    wrong = (said(gave, "status") == "error") | (said(gave, "value.isError") == "true")
    listed = F.when(is_a(at(gave, "value"), "ARRAY"), at(gave, "value")).otherwise(at(gave, "value.content"))
    output = F.coalesce(F.nullif(F.array_join(F.transform(items(listed), lambda x: F.coalesce(said(x, "text"), F.lit(""))), "\n"), F.lit("")), said(gave, "error"))
    result = payload(tool_use_id=call, output=output, text=output, is_error=F.coalesce(wrong, F.lit(False)))
    confirm = payload(tool=said(b, "toolName"), tool_use_id=call, permissions=F.array(F.struct(F.lit("asked").alias("decision"), said(b, "toolName").alias("subject"))), input=at(b, "arguments"))
    notice = payload(text=first_said(b, "msg", "message"), block=b)
    return (
        F.when((kind == "text") & (role == "assistant"), F.array(answer))
        .when((kind == "text") & own, F.array(event("instruction.source", added, where, "system")))
        .when(kind == "text", F.array(prompt))
        .when(kind == "thinking", F.array(event("assistant.thinking", payload(text=F.coalesce(said(b, "thinking"), F.lit(""))), where, "assistant")))
        .when(kind == "redactedThinking", F.array(event("assistant.thinking", payload(text=F.lit(""), redacted=F.lit(True)), where, "assistant")))
        .when(kind.isin("image", "document"), F.when(role == "assistant", F.array(event("assistant.text", attached, where, "assistant"))).otherwise(F.array(event("user.prompt", attached, where, "user"))))
        .when(kind == "toolRequest", F.concat(F.array(event("tool.call", called, where, "assistant")), GOOSE.effect(tool, given, call, F.concat(where, F.lit(" effect")), folder)))
        .when(kind == "toolResponse", F.array(event("tool.result", result, where, "tool")))
        .when(kind == "toolConfirmationRequest", F.array(event("permission.decision", confirm, where, "system")))
        .otherwise(F.array(event("unparsed.record", notice, where)))
    )


#: What a change of a file is called, and what it does.
CHANGES = {"add": "write", "update": "write", "delete": "delete"}


def codex_items(rows: DataFrame, store: str, table: str = "thread_items", *, row_id: str = "rowid", agent: str = "codex") -> DataFrame:
    """Items of a thread's history: their document's type says what they are, and the column's type must not say otherwise.

    Times come from the column that names their unit. Items of other types, or without a document, stay unread.
    """
    document, why = _document("item_json")
    known = rows_of(rows, store, table, row_id, ("thread_id", "turn_id", "item_id", "item_type", "item_json", "rollout_ordinal", "created_at_ms"))
    known = known.withColumns({"v": document, "_of": F.coalesce(said(document, "type"), _given("item_type"))})
    v, of = F.col("v"), F.col("_of")
    differs = F.when(said(v, "type") != _given("item_type"), F.concat(F.lit("the item_type column says "), "item_type", F.lit(" and the document says "), said(v, "type")))
    known = known.withColumn("problem", _notes(why, differs))
    place = {"item_type": of, "item_id": _given("item_id"), "turn_id": _given("turn_id"), "rollout_ordinal": _number(F.col("rollout_ordinal"))}
    joined = lambda path, field: F.nullif(F.array_join(F.filter(F.transform(items(at(v, path)), lambda x: said(x, field) if field else F.try_variant_get(x, "$", "string")), lambda x: F.coalesce(x, F.lit("")) != ""), "\n"), F.lit(""))
    texts = F.filter(items(at(v, "content")), lambda x: said(x, "type") == "text")
    other = F.filter(items(at(v, "content")), lambda x: ~F.coalesce(said(x, "type") == "text", F.lit(False)))
    prompt = payload(text=F.nullif(F.array_join(F.transform(texts, lambda x: F.coalesce(said(x, "text"), F.lit(""))), "\n"), F.lit("")), input=F.when(F.size(other) > 0, other), client_id=said(v, "clientId"), **place)
    hook = payload(text=joined("fragments", "text"), scope=F.lit("session"), instructions=F.array(F.struct(F.lit(f"{store}#{table}.item_json").alias("path"), F.lit("session").alias("scope"))), in_database=F.lit(True), **place)
    command = said(v, "command")
    ran = payload(
        text=said(v, "aggregatedOutput"), commands=F.when(command.isNotNull(), F.array(F.struct(command.alias("command"), first_word(command).alias("executable"), said(v, "cwd").alias("cwd"), said(v, "exitCode").try_cast("int").alias("exit_code")))),
        status=said(v, "status"), duration_ms=_number(said(v, "durationMs")), source=said(v, "source"), **place,
    )
    does = lambda x: F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for kv in CHANGES.items() for y in kv]), said(x, "kind.type")), F.lit("write"))
    changed = F.filter(items(at(v, "changes")), lambda x: said(x, "path").isNotNull())
    wrote = payload(files=F.when(F.size(changed) > 0, F.transform(changed, lambda x: F.struct(said(x, "path").alias("path"), does(x).alias("operation")))), status=said(v, "status"), output=F.transform(items(at(v, "changes")), lambda x: said(x, "diff")), **place)
    mcp = payload(
        tool=said(v, "tool"), mcp=F.when(said(v, "server").isNotNull(), F.array(F.struct(said(v, "server").alias("server"), said(v, "tool").alias("tool")))), input=at(v, "arguments"), output=at(v, "result"),
        is_error=at(v, "error").isNotNull(), status=said(v, "status"), duration_ms=_number(said(v, "durationMs")), **place,
    )
    url = said(v, "action.url")
    searched = payload(text=said(v, "query"), network=F.when(host_of(url).isNotNull(), F.array(F.struct(host_of(url).alias("host"), url.alias("url")))), output=at(v, "results"), **place)
    seen = payload(files=F.when(said(v, "path").isNotNull(), F.array(F.struct(said(v, "path").alias("path"), F.lit("read").alias("operation")))), **place)
    gave = payload(tool=said(v, "name"), output=at(v, "output"), text=text_of(at(v, "output")), namespace=said(v, "namespace"), **place)
    tool = payload(
        tool=said(v, "tool"), input=F.coalesce(at(v, "arguments"), at(v, "prompt")), output=at(v, "contentItems"), status=said(v, "status"), sender_thread=said(v, "senderThreadId"), receiver_threads=at(v, "receiverThreadIds"), **place
    )
    activity, who = said(v, "kind"), said(v, "agentPath")
    below = payload(text=F.concat_ws("", F.lit("a subagent "), F.coalesce(activity, F.lit("activity")), F.lit(": "), who), subagent=who, agent_thread_id=said(v, "agentThreadId"), activity=activity, tool=F.when(~activity.isin("started", "completed", "interrupted"), "subAgent"), **place)
    stage = F.when(activity == "started", "session.start").when(activity.isin("completed", "interrupted"), "session.end").otherwise("tool.call")
    slept = payload(tool=F.lit("sleep"), duration_ms=_number(said(v, "durationMs")), **place)
    drawn = payload(tool=F.lit("imageGeneration"), text=said(v, "revisedPrompt"), files=F.when(said(v, "savedPath").isNotNull(), F.array(F.struct(said(v, "savedPath").alias("path"), F.lit("write").alias("operation")))), status=said(v, "status"), **place)
    review = payload(text=F.when(of == "enteredReviewMode", "review mode begins").otherwise("review mode ends"), input=at(v, "review"), **place)
    makes = (
        ("userMessage", "user.prompt", "user", prompt), ("hookPrompt", "instruction.source", "system", hook), ("agentMessage", "assistant.text", "assistant", payload(text=said(v, "text"), phase=said(v, "phase"), **place)),
        ("reasoning", "assistant.thinking", "assistant", payload(text=F.nullif(F.concat_ws("\n", joined("summary", ""), joined("content", "")), F.lit("")), **place)), ("plan", "plan.write", "assistant", payload(text=said(v, "text"), **place)),
        ("commandExecution", "command.exec", "assistant", ran), ("fileChange", "file.write", "assistant", wrote), ("mcpToolCall", "mcp.call", "assistant", mcp), ("webSearch", "network.request", "assistant", searched),
        ("imageView", "file.read", "assistant", seen), ("functionCallOutput", "tool.result", "tool", gave), ("contextCompaction", "session.end", "system", payload(text=F.lit("earlier turns were compacted"), compaction=F.lit(True), **place)),
        ("dynamicToolCall", "tool.call", "assistant", tool), ("collabAgentToolCall", "tool.call", "assistant", tool), ("subAgentActivity", stage, "assistant", below), ("sleep", "tool.call", "assistant", slept),
        ("imageGeneration", "tool.call", "assistant", drawn), ("enteredReviewMode", "config.snapshot", "system", review), ("exitedReviewMode", "config.snapshot", "system", review),
    )
    made = nothing()
    for name, kind, actor, content in makes:
        made = F.when(of == name, F.array(event(kind, content, "", actor))).otherwise(made)
    # without a document an item is recorded and not its content
    return emit(known, made, agent=agent, artifact=f"{agent}.{table}", time=F.when(F.rlike("created_at_ms", F.lit(r"^-?\d+$")), _ms("created_at_ms")), kind=of, session_id=_given("thread_id"))


def _ms(name: str) -> Column:
    return F.date_format(F.timestamp_millis(F.col(name).try_cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def codex_turns(rows: DataFrame, store: str, table: str = "thread_turns", *, row_id: str = "rowid", agent: str = "codex") -> DataFrame:
    """Turns of a thread, unmapped and without a time: their columns of time don't name a unit."""
    known = rows_of(rows, store, table, row_id, ("thread_id", "turn_id", "status", "duration_ms", "error_json"))
    lasted = F.when(F.rlike("duration_ms", F.lit(r"^\d+$")), F.concat(F.lit(", after "), "duration_ms", F.lit(" ms")))
    text = F.concat_ws("", F.lit("turn "), F.coalesce(_given("turn_id"), F.lit("unknown")), F.lit(" is "), F.coalesce(_given("status"), F.lit("unknown")), lasted, F.when(_given("error_json").isNotNull(), ", and it recorded an error"))
    known = known.withColumn("problem", F.lit(f"a turn of a thread {UNINTERPRETED}"))
    return emit(known, F.array(event("unparsed.record", payload(table=F.lit(table), text=text))), agent=agent, artifact=f"{agent}.{table}", time=F.lit(None).cast("string"), kind=F.lit("turn"), session_id=_given("thread_id"))


def hermes(sessions: DataFrame | None, messages: DataFrame | None, store: str, *, row_id: str = "rowid", agent: str = "hermes") -> DataFrame:
    """Events of the tables sessions and messages; one that an export lacks is None.

    A session begins, has its system prompt as an instruction, and ends. An answer's row may hold a reply, its reasoning and
    calls of tools, each an event; a row of another role, or an answer that holds none of them, stays unread.
    """
    out, headers = [], None
    kind = "cwd: string, branch: string, model: string"
    if sessions is not None:
        rows = rows_of(sessions, store, "sessions", row_id, ("id", "title", "model", "source", "user_id", "cwd", "git_branch", "system_prompt", "parent_session_id", "started_at", "ended_at", "end_reason", "input_tokens", "output_tokens", "estimated_cost_usd"))
        headers = _headers(rows, "id", cwd=_given("cwd"), branch=_given("git_branch"), model=_given("model"))
        used = models(_given("model"), F.col("input_tokens"), F.col("output_tokens"), F.col("estimated_cost_usd"))
        start = payload(text=F.coalesce(_given("title"), F.concat(F.lit("session "), F.coalesce("id", F.lit("")))), title=_given("title"), models=used, parent_session_id=_given("parent_session_id"), source=_given("source"), user_id=_given("user_id"))
        prompt = _given("system_prompt")
        told = payload(text=prompt, scope=F.lit("session"), in_database=F.lit(True), instructions=F.array(F.struct(F.lit(f"{store}#sessions.system_prompt").alias("path"), F.lit("session").alias("scope"))), session_title=_given("title"))
        # a prompt of a session claims no time of its own
        asked = F.when(prompt.isNotNull(), F.array(event("instruction.source", told, "#system_prompt", "system"))).otherwise(nothing())
        over = F.when(_given("ended_at").isNotNull(), F.array(event("session.end", payload(text=F.coalesce(_given("end_reason"), F.lit("the session ended")), reason=_given("end_reason")), "#end", "system", F.col("ended_at")))).otherwise(nothing())
        made = F.concat(F.array(event("session.start", start, "", "system", F.col("started_at"))), asked, over)
        out.append(emit(rows, made, agent=agent, artifact=f"{agent}.sessions", time=F.lit(None).cast("string"), kind=F.lit("session"), session_id=_given("id"), project_path=_given("cwd"), git_branch=_given("git_branch")))
    if messages is not None:
        rows = rows_of(messages, store, "messages", row_id, ("session_id", "role", "content", "reasoning", "reasoning_content", "codex_message_items", "tool_calls", "tool_name", "tool_call_id", "timestamp", "finish_reason"))
        rows = _with_header(rows, _given("session_id"), headers, kind)
        role, header = F.lower(F.coalesce("role", F.lit(""))), F.col("_header")
        used = models(header["model"])
        bad = [F.when(_given(c).isNotNull() & F.try_parse_json(c).isNull(), f"the {c} column is no JSON") for c in ("codex_message_items", "tool_calls")]
        note = F.when(~role.isin("user", "system", "tool", "assistant"), F.concat(F.lit("a role that isn't known: "), role))
        rows = rows.withColumn("problem", _notes(*bad, note, F.col("_lacks")))
        text = payload(text=F.coalesce("content", F.lit("")), models=used, finish_reason=_given("finish_reason"))
        told = payload(text=F.coalesce("content", F.lit("")), scope=F.lit("session"), in_database=F.lit(True), instructions=F.array(F.struct(F.lit(f"{store}#messages.content").alias("path"), F.lit("session").alias("scope"))))
        result = payload(tool=_given("tool_name"), tool_use_id=_given("tool_call_id"), text=F.coalesce("content", F.lit("")), output=F.col("content"))
        listed = F.nullif(text_of(F.try_parse_json("codex_message_items")), F.lit(""))
        thought = F.coalesce(_given("reasoning"), _given("reasoning_content"))
        reply = F.when(_given("content").isNotNull(), F.array(event("assistant.text", text, "", "assistant"))).when(listed.isNotNull(), F.array(event("assistant.text", payload(text=listed, models=used, text_source=F.lit("codex_message_items")), "#items", "assistant"))).otherwise(nothing())
        silent = _given("content").isNull() & listed.isNull()
        mind = F.when(thought.isNotNull(), F.array(event("assistant.thinking", payload(text=thought, models=used, reasoning_only_reply=F.when(silent, F.lit(True))), "#reasoning", "assistant"))).otherwise(nothing())

        def call(x: Column, i: Column) -> Column:
            name = F.coalesce(first_said(x, "function.name", "name"), _given("tool_name"))
            given = F.coalesce(F.try_parse_json(said(x, "function.arguments")), at(x, "function.arguments"), at(x, "arguments"))
            of = F.coalesce(said(x, "id"), _given("tool_call_id"))
            where = F.concat(F.lit("#tool"), i.cast("string"))
            return F.concat(F.array(event("tool.call", payload(tool=name, tool_use_id=of, input=given, models=used), where, "assistant")), HERMES.effect(F.coalesce(name, F.lit("")), given, of, F.concat(where, F.lit("effect")), header["cwd"]))

        calls = F.coalesce(F.flatten(F.transform(items(F.try_parse_json("tool_calls")), call)), nothing())
        made = (
            F.when(role == "user", F.array(event("user.prompt", text, "", "user"))).when(role == "system", F.array(event("instruction.source", told, "", "system")))
            .when(role == "tool", F.array(event("tool.result", result, "", "tool"))).when(role == "assistant", F.concat(reply, mind, calls)).otherwise(nothing())
        )
        out.append(emit(rows, made, agent=agent, artifact=f"{agent}.messages", time=F.col("timestamp"), kind=role, session_id=F.col("_session"), project_path=header["cwd"], git_branch=header["branch"]))
    return _together(out)


def folders(paths: Column, order: Column) -> Column:
    """array<string> of paths on lines of their own, in the order that a list of their places gives; as they stand if it gives none."""
    listed = F.filter(F.split(F.coalesce(paths, F.lit("")), "\n"), lambda p: F.trim(p) != "")
    places = F.transform(F.filter(F.split(F.coalesce(order, F.lit("")), ","), lambda x: F.rlike(F.trim(x), F.lit(r"^\d{1,9}$"))), lambda x: F.trim(x).try_cast("int"))
    fits = (F.size(listed) > 0) & (F.array_sort(places) == F.sequence(F.lit(0), F.greatest(F.size(listed) - 1, F.lit(0))))
    sorted_ = F.transform(F.array_sort(F.zip_with(places, listed, lambda i, p: F.struct(i.alias("i"), p.alias("p")))), lambda x: x["p"])
    return F.when(fits, sorted_).otherwise(listed)


def zed(threads: DataFrame, store: str, *, row_id: str = "rowid", agent: str = "zed") -> DataFrame:
    """Events of the table threads: each begins a session, and its document gives an event for each message and part of an answer.

    Messages and parts are objects with one key that says what they are. Only a thread has times, so its messages have none;
    a thread without a time of its beginning has that of its last change, and says so.
    """
    rows = rows_of(threads, store, "threads", row_id, ("id", "summary", "data", "folder_paths", "folder_paths_order", "created_at", "updated_at", "parent_id"))
    document, why = _document("data")
    late = F.when(_given("created_at").isNull() & _given("updated_at").isNotNull(), "the time is that of the last change; none of the beginning is there")
    rows = rows.withColumns({"v": document, "_folders": folders(F.col("folder_paths"), F.col("folder_paths_order"))}).withColumn("problem", _notes(why, late))
    v, project = F.col("v"), F.get("_folders", F.lit(0))
    talk = F.coalesce(F.try_variant_get(v, "$.messages", "array<variant>"), F.array().cast("array<variant>"))
    model = at(v, "model")
    name = F.when(is_a(model, "STRING"), F.try_variant_get(model, "$", "string")).otherwise(F.nullif(F.concat_ws("/", first_said(model, "provider", "provider_id"), first_said(model, "model", "model_id", "id")), F.lit("")))
    start = payload(
        text=F.coalesce(_given("summary"), said(v, "title")), folder_paths=F.when(F.size("_folders") > 0, F.col("_folders")), parent_session=_given("parent_id"), models=models(F.nullif(name, F.lit(""))), profile=said(v, "profile"),
        updated_at=_given("updated_at"), tokens=at(v, "cumulative_token_usage"), detailed_summary=said(v, "detailed_summary"), messages=F.size(talk),
    )
    tag_of = lambda x: F.when(is_a(x, "OBJECT") & (F.size(F.map_keys(F.try_variant_get(x, "$", "map<string, variant>"))) == 1), F.get(F.map_keys(F.try_variant_get(x, "$", "map<string, variant>")), F.lit(0)))
    join = lambda xs: F.nullif(F.array_join(F.filter(xs, lambda x: F.coalesce(x, F.lit("")) != ""), "\n"), F.lit(""))

    def part(b: Column, where: Column) -> Column:
        tag = tag_of(b)
        called = payload(tool=said(b, "ToolUse.name"), tool_use_id=said(b, "ToolUse.id"), input=at(b, "ToolUse.input"), text=said(b, "ToolUse.name"))
        return (
            F.when(tag == "Text", F.array(event("assistant.text", payload(text=F.coalesce(said(b, "Text"), F.lit(""))), where, "assistant")))
            .when(tag == "Thinking", F.array(event("assistant.thinking", payload(text=F.coalesce(said(b, "Thinking.text"), F.lit("")), signature=said(b, "Thinking.signature")), where, "assistant")))
            .when(tag == "RedactedThinking", F.array(event("assistant.thinking", payload(text=F.lit(""), redacted=F.lit(True)), where, "assistant")))
            .when(tag == "ToolUse", F.array(event("tool.call", called, where, "assistant")))
            .otherwise(F.array(event("unparsed.record", payload(content=b), where)))
        )

    def message(m: Column, i: Column) -> Column:
        where, tag = F.concat(F.lit(" message:"), i.cast("string")), tag_of(m)
        content = items(at(m, "User.content"))
        mentions = F.transform(F.filter(content, lambda x: tag_of(x) == "Mention"), lambda x: F.struct(said(x, "Mention.uri").alias("uri"), said(x, "Mention.content").alias("content")))
        images = F.size(F.filter(content, lambda x: tag_of(x) == "Image"))
        odd = F.size(F.filter(content, lambda x: ~F.coalesce(tag_of(x).isin("Text", "Mention", "Image"), F.lit(False))))
        prompt = payload(text=join(F.transform(content, lambda x: said(x, "Text"))), mentions=F.when(F.size(mentions) > 0, mentions), images=F.when(images > 0, images), message_id=said(m, "User.id"), unknown_parts=F.when(odd > 0, odd))
        parts = F.flatten(F.transform(items(at(m, "Agent.content")), lambda b, j: part(b, F.concat(where, F.lit(" content:"), j.cast("string")))))
        results = F.array_sort(F.map_entries(F.try_variant_get(m, "$.Agent.tool_results", "map<string, string>")), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
        gave = lambda x: text_of(F.try_variant_get(F.try_parse_json(x["value"]), "$", "variant"))
        told = lambda x: F.coalesce(F.nullif(gave(x), F.lit("")), x["value"])
        answers = F.transform(results, lambda x: event("tool.result", payload(tool_use_id=x["key"], output=told(x), text=told(x)), F.concat(where, F.lit(" result:"), x["key"]), "tool"))
        ended = payload(text=F.coalesce(said(m, "Compaction.Summary"), text_of(at(m, "Compaction"))), compaction=F.lit(True), compaction_kind=tag_of(at(m, "Compaction")))
        resumed = is_a(m, "STRING") & (F.try_variant_get(m, "$", "string") == "Resume")
        return (
            F.when(resumed, F.array(event("config.snapshot", payload(text=F.lit("the thread was resumed")), where, "system")))
            .when(tag == "User", F.array(event("user.prompt", prompt, where, "user")))
            .when(tag == "Agent", F.concat(parts, F.coalesce(answers, nothing())))
            .when(tag == "Compaction", F.array(event("session.end", ended, where, "system")))
            .otherwise(F.array(event("unparsed.record", payload(message=m), where)))
        )

    began = F.array(event("session.start", start, "", "system", F.coalesce(_given("created_at"), _given("updated_at"))))
    made = F.concat(began, F.coalesce(F.flatten(F.transform(talk, message)), nothing()))
    return emit(rows, made, agent=agent, artifact=f"{agent}.threads", time=F.lit(None).cast("string"), kind=F.lit("thread"), session_id=_given("id"), project_path=project)


#: A workspace's document beside an editor's state, and its keys that say which folder was open.
WORKSPACE, WORKSPACE_KEYS = "workspace.json", ("folder", "workspace", "configuration")


def editor_state(items_: DataFrame, workspaces: DataFrame, *, path: str = "path", row_id: str = "rowid", agent: str = "vscode") -> DataFrame:
    """Keys and values of editors' state (path, rowid, key, value), with the folder that the document beside the store names; no time is claimed.

    workspaces: documents (path, place, v, text, problem) named workspace.json, each an event too. Only stores of a workspace
    are looked up; one without a document that names a folder says so.
    """
    v = F.col("v")
    folder_of = lambda c: F.regexp_replace(c, r"[/\\][^/\\]*$", "")
    uri = first_said(v, *WORKSPACE_KEYS)
    known = workspaces.withColumns({"_folder": folder_of(F.col("path")), "_project": uri_as_path(uri), "_remote": F.coalesce(remote_uri(uri), F.lit(False))})
    beside = known.where("_project is not null").groupBy("_folder").agg(F.min(F.struct("_project", "_remote")).alias("_beside"))
    rows = rows_of(items_.withColumn("_store", F.col(f"`{path}`")), "", "ItemTable", row_id, ("key", "value", "_store")).drop("path").withColumnRenamed("_store", "path")
    met = rows.withColumn("_folder", folder_of(F.col("path"))).join(beside, "_folder", "left")
    own = F.contains(F.translate("path", "\\", "/"), F.lit("/workspaceStorage/"))
    remote = "the folder is on another machine"
    note = F.when(own & F.col("_beside").isNull(), "no document beside the store names its folder").when(own & F.col("_beside._remote"), remote)
    value = F.try_parse_json("value")
    made = F.array(event("config.snapshot", payload(key=F.col("key"), text=F.col("value"), value=F.when(is_a(value, "OBJECT") | is_a(value, "ARRAY"), value)), "", "system"))
    none = F.lit(None).cast("string")
    told = emit(met.withColumn("problem", note), made, agent=agent, artifact=f"{agent}.state", time=none, kind=F.lit("item"), project_path=F.when(own, F.col("_beside._project")))
    named = F.array(event("config.snapshot", payload(key=F.lit(WORKSPACE), text=F.col("text"), uri=uri, value=v), "", "system"))
    said_all = _notes(F.col("problem"), F.when(F.col("_remote"), remote))
    return told.unionByName(emit(known.withColumn("problem", said_all), named, agent=agent, artifact=f"{agent}.workspace", time=none, kind=F.lit("workspace"), project_path=F.col("_project")))


def inventory(tables: dict[str, DataFrame], store: str, agent: str) -> DataFrame:
    """One event that says which tables a store has and how many rows each, beside the events of the rows themselves."""
    counts = None
    for name, rows in sorted(tables.items()):
        one = rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        counts = one if counts is None else counts.union(one)
    whole = counts.agg(F.array_sort(F.collect_list(F.struct("table", "rows"))).alias("tables"))  # a row for each table
    text = F.array_join(F.transform("tables", lambda x: F.concat(x["table"], F.lit(" "), x["rows"].cast("string"))), ", ")
    rows = whole.select(F.lit(store).alias("path"), F.lit("store").alias("place"), F.to_json(F.struct("tables")).alias("text"), F.lit(f"the store {UNINTERPRETED}").alias("problem"), payload(text=text, tables=F.col("tables")).alias("p"))
    return emit(rows, F.array(event("unparsed.record", F.col("p"), "", "system")), agent=agent, artifact=f"{agent}.store", time=F.lit(None).cast("string"), kind=F.lit("store"))
