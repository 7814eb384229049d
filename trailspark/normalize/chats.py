"""Normalizers of agents that record their conversations as JSON: lines, arrays or documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.normalize.records import Tools, at, body, carried, each, emit, event, first_said, is_a, items, lines_of, mark, models, nothing, payload, said, when

#: The agents' own names of their tools.
CLAUDE = Tools(
    command=("Bash", "BashOutput", "KillShell"), read=("Read", "NotebookRead", "Glob", "Grep"), write=("Write", "Edit", "MultiEdit", "NotebookEdit"), network=("WebFetch", "WebSearch"),
    paths=("file_path", "path", "notebook_path", "pattern"), contents=("content", "new_string", "new_source"),
)
GEMINI = Tools(
    command=("run_shell_command", "run_terminal_command", "shell"), read=("read_file", "read_many_files"), write=("write_file", "replace", "edit", "smart_edit"),
    network=("web_fetch", "google_web_search", "web_search"), memory=("save_memory",), paths=("absolute_path", "file_path", "path", "filename"), folders=("directory", "cwd"),
)
CLINE = Tools(
    command=("execute_command",), read=("read_file",), write=("write_to_file", "replace_in_file", "apply_diff", "insert_content", "search_and_replace", "new_rule"),
    network=("browser_action", "web_fetch", "fetch_instructions"),
)
CLINE_MCP = ("use_mcp_tool", "access_mcp_resource")
PERMISSION_ASKS = ("command", "tool", "browser_action_launch", "use_mcp_server", "auto_approval_max_req_reached")
PI = Tools(
    command=("bash", "shell", "run"), read=("read", "read_file"), write=("write", "write_file", "edit", "apply_patch"), network=("fetch", "web_fetch", "web_search"),
    paths=("path", "file_path", "filePath", "absolute_path"), commands=("command", "cmd"),
)
COPILOT = Tools(command=("bash", "shell", "powershell", "run_in_terminal"), read=("view", "read_file"), write=("create", "edit", "str_replace_editor", "apply_patch"), network=("web_fetch", "fetch"), commands=("command",))
#: The hooks of an audit log and what they stand for.
HOOKS = {
    "agent_start": "session.start", "agent_resume": "session.start", "prompt_submit": "user.prompt", "tool_call": "tool.call", "tool_result": "tool.result", "agent_end": "session.end",
    "agent_abort": "session.end", "agent_error": "session.end", "session_shutdown": "session.end",
}


def claude(lines: DataFrame, agent: str = "claude_code") -> DataFrame:
    """Transcript lines: prompts, text, thinking, refusals, tool calls with their effects, results; an answer's events carry its model and tokens."""
    rows, v = lines_of(lines), F.col("v")
    kind, content = said(v, "type"), at(v, "message.content")
    blocks = items(content)
    used = models(said(v, "message.model"), said(v, "message.usage.input_tokens"), said(v, "message.usage.output_tokens"))

    def answer(b: Column, i: Column) -> Column:
        name, call, given, of = F.coalesce(said(b, "name"), F.lit("")), said(b, "id"), at(b, "input"), said(b, "type")
        is_mcp, words = F.startswith(name, F.lit("mcp__")), F.split(name, "__")
        mcp = F.when(is_mcp, F.array(F.struct(F.get(words, F.lit(1)).alias("server"), F.array_join(F.slice(words, 3, 100), "__").alias("tool"))))
        called = event(F.when(is_mcp, "mcp.call").otherwise("tool.call"), payload(tool=name, tool_use_id=call, input=given, mcp=mcp, models=used), mark("tool", i), "assistant")
        return (
            F.when(is_a(b, "STRING"), F.array(event("assistant.text", payload(text=F.try_variant_get(b, "$", "string"), models=used), F.when(is_a(content, "ARRAY"), mark("text", i)).otherwise(""), "assistant")))
            .when(of == "text", F.array(event("assistant.text", payload(text=F.coalesce(said(b, "text"), F.lit("")), models=used), mark("text", i), "assistant")))
            .when(of.isin("thinking", "redacted_thinking"), F.array(event("assistant.thinking", payload(text=F.coalesce(said(b, "thinking"), F.lit("")), models=used), mark("thinking", i), "assistant")))
            .when(of == "tool_use", F.concat(F.array(called), CLAUDE.effect(name, given, call, mark("effect", i), said(v, "cwd"))))
            .otherwise(F.array(event("unparsed.record", payload(block=b), mark("block", i))))
        )

    def asked(b: Column, i: Column) -> Column:
        of = said(b, "type")
        result = payload(tool_use_id=said(b, "tool_use_id"), output=at(b, "content"), text=body(b, "content"), is_error=F.coalesce(said(b, "is_error") == "true", F.lit(False)))
        return (
            F.when(is_a(b, "STRING"), F.array(event("user.prompt", payload(text=F.try_variant_get(b, "$", "string")), F.when(is_a(content, "ARRAY"), mark("text", i)).otherwise(""), "user")))
            .when(of == "tool_result", F.array(event("tool.result", result, mark("result", i), "tool")))
            .when(of == "text", F.array(event("user.prompt", payload(text=F.coalesce(said(b, "text"), F.lit(""))), mark("text", i), "user")))
            .otherwise(F.array(event("user.prompt", payload(other_parts=F.array(b)), mark("part", i), "user")))
        )

    details = F.coalesce(first_said(v, "message.stop_details.type", "message.stop_details.category"), F.lit("refusal"))
    declined = event("safety.refusal", payload(refusal=details, stop_details=at(v, "message.stop_details"), text=body(v, "message.content"), models=used, message_id=said(v, "message.id")), "#refusal", "assistant")
    made = (
        F.when(kind == "user", each(blocks, asked))
        .when(kind == "assistant", F.concat(when(said(v, "message.stop_reason") == "refusal", declined), each(blocks, answer)))
        .when(kind == "permission-mode", F.array(event("permission.change", payload(permissions=F.array(F.struct(said(v, "permissionMode").alias("mode")))), "", "user")))
        .when(kind.isin("summary", "compact"), F.array(event("session.end", payload(text=body(v, "summary"), compaction=F.lit(True)), "", "system")))
        .otherwise(nothing())
    )
    return emit(
        rows, made, agent=agent, artifact=f"{agent}.transcript", time=said(v, "timestamp"), kind=kind, session_id=said(v, "sessionId"), project_path=said(v, "cwd"), git_branch=said(v, "gitBranch"), client=said(v, "version")
    )


def copilot(lines: DataFrame, agent: str = "copilot") -> DataFrame:
    """Session events: what the file says about model, folder and session holds for the records after it."""
    rows = lines_of(lines)
    data = at(F.col("v"), "data")
    rows = carried(rows, _model=first_said(data, "newModel", "model"), session_id=said(data, "sessionId"), project_path=first_said(data, "cwd", "workingDirectory"))
    kind, used = said(F.col("v"), "type"), models(F.col("_model"))
    stated = at(data, "arguments")
    arguments = F.when(is_a(stated, "OBJECT"), stated).when(said(data, "command").isNotNull(), F.to_variant_object(F.struct(said(data, "command").alias("command")))).otherwise(stated)
    tool, call, server = F.coalesce(said(data, "toolName"), F.lit("tool")), said(data, "toolCallId"), said(data, "mcpServerName")
    mcp = F.when(server.isNotNull(), F.array(F.struct(server.alias("server"), F.coalesce(said(data, "mcpToolName"), tool).alias("tool"))))
    started = F.concat(
        F.array(event(F.when(server.isNotNull(), "mcp.call").otherwise("tool.call"), payload(tool=tool, tool_use_id=call, input=arguments, mcp=mcp, models=used), "", "assistant")),
        COPILOT.effect(tool, arguments, call, F.lit("#effect"), F.col("project_path")),
    )
    name = F.coalesce(first_said(data, "agentDisplayName", "agentName"), F.lit(""))
    helper = payload(text=F.concat(kind, F.lit(": "), name, F.coalesce(F.concat(F.lit(" ("), said(data, "error"), F.lit(")")), F.lit(""))), subagent=said(data, "agentName"), models=used)
    decision = F.struct(said(data, "mode").alias("mode"), F.coalesce(first_said(data, "decision", "outcome"), F.lit("unknown")).alias("decision"), first_said(data, "toolName", "subject").alias("subject"))
    text = body(data, "content")
    made = (
        F.when(kind == "session.start", F.array(event("session.start", payload(version=said(data, "copilotVersion"), models=used), "", "system")))
        .when(kind.isin("session.end", "session.task_complete"), F.array(event("session.end", payload(text=body(data, "summary"), models=used), "", "system")))
        .when(kind == "session.model_change", F.array(event("config.snapshot", payload(text=F.concat(F.lit("model changed to "), said(data, "newModel")), models=models(said(data, "newModel")), previous_model=first_said(data, "previousModel", "oldModel")), "", "user")))
        .when(kind == "user.message", F.array(event("user.prompt", payload(text=text, models=used), "", "user")))
        .when(kind == "assistant.message", F.array(event("assistant.text", payload(text=text, models=used), "", "assistant")))
        .when(kind == "reasoning", F.array(event("assistant.thinking", payload(text=text, models=used), "", "assistant")))
        .when(kind == "tool.execution_start", started)
        .when(kind == "tool.execution_complete", F.array(event("tool.result", payload(tool=said(data, "toolName"), tool_use_id=call, is_error=F.coalesce(said(data, "success") == "false", F.lit(False)), text=body(data, "result"), models=used), "", "tool")))
        .when(F.startswith(kind, F.lit("subagent.")), F.array(event(F.when(kind == "subagent.started", "session.start").otherwise("session.end"), helper, "", "system")))
        .when(kind.isin("permission.request", "permission.decision", "tool.permission"), F.array(event("permission.decision", payload(permissions=F.array(decision), models=used), "", "user")))
        .otherwise(nothing())
    )
    return emit(rows, made, agent=agent, artifact=f"{agent}.events", time=said(F.col("v"), "timestamp"), kind=kind, client=F.lit("copilot-cli"), session_id=F.col("session_id"), project_path=F.col("project_path"))


def _parts(content: Column) -> dict[str, Column]:
    """The parts of a message: answers, thoughts, calls, their answers, and the rest."""
    every = items(content)
    has = lambda k: lambda p: is_a(at(p, k), "OBJECT")
    call, answer = has("functionCall"), has("functionResponse")
    spoken = F.filter(every, lambda p: ~call(p) & ~answer(p) & (is_a(p, "STRING") | at(p, "text").isNotNull()))
    words = lambda p: F.coalesce(F.when(is_a(p, "STRING"), F.try_variant_get(p, "$", "string")), said(p, "text"), F.lit(""))
    joined = lambda some: F.array_join(F.filter(F.transform(some, words), lambda t: t != ""), "\n")
    thought = lambda p: F.coalesce(said(p, "thought").isin("true"), F.lit(False))
    other = F.filter(every, lambda p: ~call(p) & ~answer(p) & ~is_a(p, "STRING") & at(p, "text").isNull())
    return {
        "text": joined(F.filter(spoken, lambda p: ~thought(p))), "thinking": joined(F.filter(spoken, thought)),
        "calls": F.transform(F.filter(every, call), lambda p: at(p, "functionCall")), "responses": F.transform(F.filter(every, answer), lambda p: at(p, "functionResponse")),
        "other": F.when(F.size(other) > 0, other),
    }


def _trio(tools: Tools, name: Column, arguments: Column, call: Column, suffix: Column, result: Column, used: Column, **more: Column) -> Column:
    """A call, what it did, and its result where the record has one."""
    plain = F.substring(suffix, 2, 1 << 20)
    return F.concat(
        F.array(event("tool.call", payload(tool=name, tool_use_id=call, input=arguments, models=used, **more), suffix, "assistant")),
        tools.effect(name, arguments, call, F.concat(F.lit("#effect-"), plain)),
        when(result.isNotNull(), event("tool.result", payload(tool=name, tool_use_id=call, output=result, text=F.coalesce(F.try_variant_get(result, "$", "string"), F.lit(""))), F.concat(F.lit("#result-"), plain), "tool")),
    )


def gemini(lines: DataFrame, agent: str = "gemini_cli") -> DataFrame:
    """Chat files: a record's kind shows in its keys; a rewind ends a session, a metadata update is a snapshot."""
    v = F.col("v")
    rows = lines_of(lines)
    field = lambda k: F.try_variant_get(v, f"$['{k}']", "variant")
    rewind, changed = F.try_variant_get(field("$rewindTo"), "$", "string"), field("$set")
    header = is_a(at(v, "sessionId"), "STRING") & is_a(at(v, "projectHash"), "STRING") & at(v, "id").isNull()
    rows = carried(rows, session_id=F.when(header, said(v, "sessionId")), _project=F.when(header, said(v, "projectHash")))
    used = models(said(v, "model"), said(v, "tokens.input"), said(v, "tokens.output"))
    parts, message, shown = _parts(at(v, "content")), said(v, "id"), F.nullif(body(v, "displayContent"), F.lit(""))
    thoughts, stated = items(at(v, "thoughts")), items(at(v, "toolCalls"))
    thinking = each(thoughts, lambda t, i: F.array(event("assistant.thinking", payload(text=F.coalesce(first_said(t, "description", "subject"), F.lit("")), subject=said(t, "subject"), models=used, message_id=message), mark("thought", i), "assistant", said(t, "timestamp"))))
    calls = F.concat(
        each(parts["calls"], lambda c, i: _trio(GEMINI, said(c, "name"), at(c, "args"), said(c, "id"), mark("part", i), F.lit(None).cast("variant"), used)),
        each(stated, lambda c, i: _trio(GEMINI, said(c, "name"), at(c, "args"), said(c, "id"), mark("tool", i), F.coalesce(at(c, "result"), at(c, "resultDisplay")), used, status=said(c, "status"), description=said(c, "description"))),
    )
    silent = (parts["text"] == "") & ((F.size(parts["calls"]) > 0) | (F.size(stated) > 0) | (F.size(thoughts) > 0) | (parts["thinking"] != ""))
    answer = F.concat(
        thinking, when(parts["thinking"] != "", event("assistant.thinking", payload(text=parts["thinking"], models=used, message_id=message), "#thinking", "assistant")),
        when(~silent, event("assistant.text", payload(text=parts["text"], displayed_text=shown, models=used, message_id=message, other_parts=parts["other"]), "", "assistant")), calls,
    )
    kind = said(v, "type")
    updated = F.array_sort(F.map_keys(F.try_variant_get(changed, "$", "map<string, variant>")))
    made = (
        F.when(rewind.isNotNull(), F.array(event("session.end", payload(rewind_to=rewind, text=F.concat(F.lit("rewound to message "), rewind, F.lit("; the turns after it are still in the file"))), "", "user")))
        .when(message.isNotNull() & (kind == "user"), F.array(event("user.prompt", payload(text=parts["text"], displayed_text=shown, message_id=message, other_parts=parts["other"]), "", "user")))
        .when(message.isNotNull() & (kind == "gemini"), answer)
        .when(message.isNotNull() & kind.isin("info", "error", "warning"), F.array(event("config.snapshot", payload(text=parts["text"], level=kind, message_id=message), "", "system")))
        .when(is_a(changed, "OBJECT"), F.array(event("config.snapshot", payload(updated=updated, values=changed, text=F.concat(F.lit("metadata updated: "), F.array_join(updated, ", "))), "", "system")))
        .when(header, F.array(event("session.start", payload(project_hash=said(v, "projectHash"), session_kind=said(v, "kind"), directories=at(v, "directories"), summary=said(v, "summary"), last_updated=said(v, "lastUpdated")), "", "system")))
        .otherwise(nothing())
    )
    return emit(rows, made, agent=agent, artifact=f"{agent}.chats", time=first_said(v, "timestamp", "startTime"), kind=kind, session_id=F.col("session_id"))


def qwen(lines: DataFrame, agent: str = "qwen_code") -> DataFrame:
    """Transcripts of records with parts; a compression ends a session."""
    rows, v = lines_of(lines), F.col("v")
    kind, subtype = said(v, "type"), said(v, "subtype")
    parts = _parts(F.coalesce(at(v, "message.parts"), at(v, "message.content")))
    used, ids = models(said(v, "model"), said(v, "usageMetadata.promptTokenCount"), said(v, "usageMetadata.candidatesTokenCount")), {"message_id": said(v, "uuid"), "parent_id": said(v, "parentUuid")}
    answer = F.concat(
        when(parts["thinking"] != "", event("assistant.thinking", payload(text=parts["thinking"], models=used, **ids), "#thinking", "assistant")),
        when((parts["text"] != "") | (F.size(parts["calls"]) == 0), event("assistant.text", payload(text=parts["text"], models=used, other_parts=parts["other"], **ids), "", "assistant")),
        each(parts["calls"], lambda c, i: _trio(GEMINI, said(c, "name"), at(c, "args"), said(c, "id"), mark("tool", i), at(v, "toolCallResult"), used)),
    )
    said_of = lambda r: F.when(parts["text"] != "", parts["text"]).otherwise(body(r, "response"))
    result = lambda r, i: F.array(event("tool.result", payload(tool=said(r, "name"), tool_use_id=said(r, "id"), output=at(r, "response"), text=said_of(r), tool_call_result=at(v, "toolCallResult")), mark("result", i), "tool"))
    lone = F.array(event("tool.result", payload(text=parts["text"], tool_call_result=at(v, "toolCallResult")), "#result0", "tool"))
    made = (
        F.when(subtype == "chat_compression", F.array(event("session.end", payload(compaction=F.lit(True), text=F.concat(F.lit("compressed: "), parts["text"]), system_payload=at(v, "systemPayload")), "", "system")))
        .when(kind == "user", F.array(event("user.prompt", payload(text=parts["text"], provenance_class=said(v, "provenance"), subtype=subtype, other_parts=parts["other"], **ids), "", "user")))
        .when(kind == "assistant", answer)
        .when(kind == "tool_result", F.when(F.size(parts["responses"]) > 0, each(parts["responses"], result)).otherwise(lone))
        .when(kind == "system", F.array(event("config.snapshot", payload(text=parts["text"], subtype=subtype, system_payload=at(v, "systemPayload")), "", "system")))
        .otherwise(nothing())
    )
    return emit(
        rows, made, agent=agent, artifact=f"{agent}.transcripts", time=said(v, "timestamp"), kind=kind, session_id=said(v, "sessionId"), project_path=said(v, "cwd"), git_branch=said(v, "gitBranch"), client=said(v, "version")
    )


def pi(lines: DataFrame, agent: str = "pi") -> DataFrame:
    """Sessions whose header and model changes hold for the records after them; compactions and branch summaries end a session."""
    v = F.col("v")
    rows = lines_of(lines)
    kind, role = said(v, "type"), said(v, "message.role")
    rows = carried(rows, session_id=F.when(kind == "session", said(v, "id")), project_path=F.when(kind == "session", said(v, "cwd")), _model=F.when(kind == "model_change", said(v, "modelId")))
    ids = {"message_id": said(v, "id"), "parent_id": said(v, "parentId")}
    used = models(F.coalesce(said(v, "message.model"), F.col("_model")), said(v, "message.usage.input"), said(v, "message.usage.output"), F.coalesce(said(v, "message.usage.cost.total"), said(v, "message.usage.cost")))
    blocks = F.filter(items(at(v, "message.content")), lambda b: is_a(b, "OBJECT") | is_a(b, "STRING"))
    of = lambda name: F.filter(blocks, lambda b: said(b, "type") == name)
    plain = F.array_join(F.transform(F.filter(blocks, lambda b: is_a(b, "STRING")), lambda b: F.try_variant_get(b, "$", "string")), "\n")
    joined = lambda name, key: F.trim(F.array_join(F.transform(of(name), lambda b: F.coalesce(said(b, key), F.lit(""))), "\n"))
    thinking, text, calls = joined("thinking", "thinking"), F.when(plain != "", plain).otherwise(joined("text", "text")), of("toolCall")

    def call(b: Column, i: Column) -> Column:
        name, server = F.coalesce(said(b, "name"), F.lit("")), said(b, "namespace")
        mcp = F.when(server.isNotNull(), F.array(F.struct(server.alias("server"), name.alias("tool"))))
        made = event(F.when(server.isNotNull(), "mcp.call").otherwise("tool.call"), payload(tool=name, tool_use_id=said(b, "id"), input=at(b, "arguments"), mcp=mcp, models=used, **ids), mark("tool", i), "assistant")
        return F.concat(F.array(made), PI.effect(name, at(b, "arguments"), said(b, "id"), mark("effect", i), F.col("project_path")))

    unknown = F.filter(blocks, lambda b: is_a(b, "OBJECT") & ~F.coalesce(said(b, "type").isin("text", "thinking", "toolCall"), F.lit(False)))
    answer = F.concat(
        when(thinking != "", event("assistant.thinking", payload(text=thinking, models=used, **ids), "#thinking", "assistant")),
        when((text != "") | ((F.size(calls) == 0) & (F.size(blocks) > 0) & (thinking == "")), event("assistant.text", payload(text=text, models=used, stop_reason=said(v, "message.stopReason"), provider=said(v, "message.provider"), **ids), "", "assistant")),
        each(calls, call), each(unknown, lambda b, i: F.array(event("unparsed.record", payload(block=b), mark("block", i)))),
    )
    message = (
        F.when(role == "user", F.array(event("user.prompt", payload(text=body(v, "message.content"), **ids), "", "user")))
        .when(role == "assistant", answer)
        .when(role == "toolResult", F.array(event("tool.result", payload(tool=said(v, "message.toolName"), tool_use_id=said(v, "message.toolCallId"), is_error=F.coalesce(said(v, "message.isError") == "true", F.lit(False)), output=at(v, "message.content"), details=at(v, "message.details"), text=body(v, "message.content"), **ids), "", "tool")))
        .when(role == "system", F.array(event("config.snapshot", payload(text=body(v, "message.content"), sections=at(v, "message.sections"), tools_added=at(v, "message.toolsAdded"), tools_removed=at(v, "message.toolsRemoved"), **ids), "", "system")))
        .otherwise(nothing())
    )
    summary = F.coalesce(F.nullif(body(v, "summary"), F.lit("")), body(v, "message"))
    made = (
        F.when(kind == "session", F.array(event("session.start", payload(format_version=said(v, "version"), parent_session=said(v, "parentSession"), text=F.concat(F.lit("session "), said(v, "id"))), "", "system")))
        .when(kind == "message", message)
        .when(kind == "model_change", F.array(event("config.snapshot", payload(models=models(said(v, "modelId")), provider=said(v, "provider"), text=F.concat(F.lit("model changed to "), said(v, "modelId"))), "", "user")))
        .when(kind.isin("compaction", "branch_summary"), F.array(event("session.end", payload(compaction=kind == "compaction", entry_type=kind, text=summary), "", "system")))
        .when(kind == "thinking_level_change", F.array(event("config.snapshot", payload(thinking_level=first_said(v, "level", "thinkingLevel"), text=F.lit("thinking level changed")), "", "user")))
        .when(kind.isin("label", "session_info", "custom", "custom_message"), F.array(event("config.snapshot", payload(entry_type=kind, text=F.col("text")), "", "system")))
        .otherwise(nothing())
    )
    return emit(rows, made, agent=agent, artifact=f"{agent}.sessions", time=said(v, "timestamp"), kind=F.coalesce(role, kind), session_id=F.col("session_id"), project_path=F.col("project_path"))


def prompt_log(entries: DataFrame, agent: str = "gemini_cli") -> DataFrame:
    """Entries (path, place, v, text, problem) of a prompt log that is one JSON array."""
    v = F.col("v")
    made = when(is_a(v, "OBJECT"), event("prompt.history", payload(text=body(v, "message"), message_id=said(v, "messageId"), sender_type=said(v, "type")), "", "user"))
    return emit(entries, made, agent=agent, artifact=f"{agent}.prompts", time=said(v, "timestamp"), kind=said(v, "type"), session_id=said(v, "sessionId"))


def task_of(path: Column) -> Column:
    """The task that a file of a task directory belongs to: the folder below `tasks`, or the one that the file lies in."""
    plain = F.translate(path, "\\", "/")
    return F.nullif(F.coalesce(F.nullif(F.regexp_extract(plain, "/tasks/([^/]+)/", 1), F.lit("")), F.element_at(F.split(plain, "/"), -2)), F.lit(""))


def cline_history(entries: DataFrame, agent: str = "cline") -> DataFrame:
    """Entries of an API history, which has no times: prompts, results, text, thinking and calls with their effects."""
    v, role = F.col("v"), said(F.col("v"), "role")
    content = at(v, "content")
    blocks = items(content)
    of = lambda *names: F.filter(blocks, lambda b: F.coalesce(said(b, "type").isin(*names), F.lit(False)))
    text = F.when(is_a(content, "STRING"), said(v, "content")).otherwise(F.trim(F.array_join(F.transform(of("text"), lambda b: F.coalesce(said(b, "text"), F.lit(""))), "\n")))
    text = F.coalesce(text, F.lit(""))
    thinking = F.trim(F.array_join(F.transform(of("thinking", "redacted_thinking"), lambda b: F.coalesce(said(b, "thinking"), F.lit(""))), "\n"))
    results, calls = of("tool_result"), of("tool_use")

    def call(b: Column, i: Column) -> Column:
        name, given = F.coalesce(said(b, "name"), F.lit("")), at(b, "input")
        is_mcp = name.isin(*CLINE_MCP)
        mcp = F.when(is_mcp, F.array(F.struct(F.coalesce(said(given, "server_name"), F.lit("")).alias("server"), F.coalesce(first_said(given, "tool_name", "uri"), F.lit("")).alias("tool"))))
        made = event(F.when(is_mcp, "mcp.call").otherwise("tool.call"), payload(tool=name, tool_use_id=said(b, "id"), input=given, mcp=mcp), mark("tool", i), "assistant")
        return F.concat(F.array(made), CLINE.effect(name, given, said(b, "id"), mark("effect", i)))

    result = lambda b, i: F.array(event("tool.result", payload(tool_use_id=said(b, "tool_use_id"), is_error=F.coalesce(said(b, "is_error") == "true", F.lit(False)), output=at(b, "content"), text=body(b, "content")), mark("result", i), "tool"))
    made = (
        F.when(role == "user", F.concat(each(results, result), when((text != "") | (F.size(results) == 0), event("user.prompt", payload(text=text), "", "user"))))
        .when(role == "assistant", F.concat(
            when(thinking != "", event("assistant.thinking", payload(text=thinking), "#thinking", "assistant")), when((text != "") | (F.size(calls) == 0), event("assistant.text", payload(text=text), "", "assistant")), each(calls, call)))
        .otherwise(nothing())
    )
    return emit(entries, made, agent=agent, artifact=f"{agent}.api_history", time=F.lit(None).cast("string"), kind=role, session_id=task_of(F.col("path")))


def cline_ui(entries: DataFrame, agent: str = "cline") -> DataFrame:
    """Entries of a UI log: what the agent asked for permission for, and what was said."""
    v = F.col("v")
    kind, ask, say, text = said(v, "type"), said(v, "ask"), said(v, "say"), body(v, "text")
    asked = F.struct(F.lit("asked").alias("decision"), F.coalesce(ask, F.lit("")).alias("subject"))
    made = (
        F.when(kind == "ask", F.array(event("permission.decision", payload(permissions=F.array(asked), ask=ask, known_ask_type=F.when(ask.isin(*PERMISSION_ASKS), F.lit(True)), text=text, partial=said(v, "partial")), "", "system")))
        .when((kind == "say") & F.coalesce(say.isin("user_feedback", "user_feedback_diff"), F.lit(False)), F.array(event("user.prompt", payload(text=text, say=say), "", "user")))
        .when((kind == "say") & F.coalesce(say == "reasoning", F.lit(False)), F.array(event("assistant.thinking", payload(text=text, say=say), "", "assistant")))
        .when(kind == "say", F.array(event("assistant.text", payload(text=text, say=say, images=at(v, "images")), "", "assistant")))
        .otherwise(nothing())
    )
    return emit(entries, made, agent=agent, artifact=f"{agent}.ui_messages", time=said(v, "ts"), kind=kind, session_id=task_of(F.col("path")))


def cline_documents(documents: DataFrame, agent: str = "cline") -> DataFrame:
    """Documents (path, place, v, text, problem) of a task: its metadata, how its context was cut, and its index entry."""
    v, name = F.col("v"), F.element_at(F.split(F.translate("path", "\\", "/"), "/"), -1)
    files = F.filter(items(at(v, "files_in_context")), lambda f: said(f, "path").isNotNull())
    listed = F.transform(files, lambda f: F.struct(said(f, "path").alias("path"), F.lit("unknown").alias("operation")))
    names = F.map_keys(F.try_variant_get(at(v, "model_usage"), "$", "map<string, variant>"))
    metadata = payload(files=listed, models=F.transform(names, lambda m: F.struct(m.alias("model"))), model_usage=at(v, "model_usage"), environment_history=at(v, "environment_history"), text=F.concat(F.size(files).cast("string"), F.lit(" files in context")))
    made = (
        F.when(F.col("problem").isNotNull(), nothing())
        .when(F.contains(name, F.lit("metadata")), F.array(event("config.snapshot", metadata, "", "system")))
        .when(F.contains(name, F.lit("context_history")), F.array(event("session.end", payload(compaction=F.lit(True), text=F.lit("the context was cut, so the model saw less than the history holds")), "", "system")))
        .when(is_a(v, "OBJECT"), F.array(event("config.snapshot", payload(file=name, task=at(v, "task"), text=F.coalesce(F.nullif(body(v, "task"), F.lit("")), name)), "", "system")))
        .otherwise(nothing())
    )
    return emit(documents, made, agent=agent, artifact=f"{agent}.documents", time=first_said(v, "ts", "createdAt"), kind=name, session_id=task_of(F.col("path")), project_path=first_said(v, "workspace", "cwd"))


def hook_log(lines: DataFrame, agent: str = "cline_cli") -> DataFrame:
    """Audit lines of hooks; a hook that isn't known stays unread."""
    rows, v = lines_of(lines), F.col("v")
    hook = first_said(v, "hookName", "hook", "event", "type")
    stands_for = F.create_map(*[F.lit(x) for kv in HOOKS.items() for x in kv])
    kind = F.element_at(stands_for, hook)
    actor = F.when(kind == "user.prompt", "user").when(kind == "tool.result", "tool").when(kind == "tool.call", "assistant").otherwise("system")
    call = F.coalesce(first_said(v, "toolCallId", "tool_call_id", "callId"), said(v, "data.toolCallId"))
    content = payload(hook=hook, text=first_said(v, "prompt", "text", "message"), tool=first_said(v, "toolName", "tool", "tool_name"), tool_use_id=call, input=F.coalesce(at(v, "input"), at(v, "args")), output=F.coalesce(at(v, "output"), at(v, "result")))
    made = when(kind.isNotNull(), event(kind, content, "", "system"))
    found = emit(rows, made, agent=agent, artifact=f"{agent}.hooks", time=first_said(v, "timestamp", "ts", "time"), kind=hook, session_id=first_said(v, "sessionId", "taskId", "session_id"), project_path=first_said(v, "cwd", "workspace"))
    return found.withColumn("actor", F.when(F.col("kind") == "user.prompt", "user").when(F.col("kind") == "tool.result", "tool").when(F.col("kind") == "tool.call", "assistant").otherwise(F.col("actor")))


def continue_sessions(documents: DataFrame, agent: str = "continue") -> DataFrame:
    """Session documents: a start, and the turns of their history, which have no times of their own."""
    v = F.col("v")

    def turn(entry: Column, i: Column) -> Column:
        message = F.coalesce(at(entry, "message"), entry)
        role, text = said(message, "role"), body(message, "content")
        calls = items(at(message, "toolCalls"))
        called = each(calls, lambda c, k: F.array(event("tool.call", payload(tool=said(c, "function.name"), tool_use_id=said(c, "id"), input=F.try_parse_json(said(c, "function.arguments"))), F.concat(mark("turn", i), mark("tool", k)), "assistant")))
        return F.concat(
            when(role == "user", event("user.prompt", payload(text=text), mark("turn", i), "user")), when((role == "assistant") & ((text != "") | (F.size(calls) == 0)), event("assistant.text", payload(text=text), mark("turn", i), "assistant")),
            when(role == "thinking", event("assistant.thinking", payload(text=text), mark("turn", i), "assistant")), when(role == "tool", event("tool.result", payload(tool_use_id=said(message, "toolCallId"), text=text), mark("turn", i), "tool")),
            when(role == "system", event("instruction.source", payload(text=text), mark("turn", i), "system")), called,
            when(~F.coalesce(role.isin("user", "assistant", "thinking", "tool", "system"), F.lit(False)), event("unparsed.record", payload(turn=entry), mark("turn", i))),
        )

    start = event("session.start", payload(title=said(v, "title"), text=F.coalesce(said(v, "title"), F.lit(""))), "", "system", said(v, "dateCreated"))
    made = F.when(is_a(v, "OBJECT"), F.concat(F.array(start), each(items(at(v, "history")), turn))).otherwise(nothing())
    return emit(documents, made, agent=agent, artifact=f"{agent}.sessions", time=F.lit(None).cast("string"), kind=F.lit("session"), session_id=said(v, "sessionId"), project_path=said(v, "workspaceDirectory"))


def session_times(events: DataFrame, index: DataFrame) -> DataFrame:
    """Session starts without a time get that of the index (path, place, v, text, problem), an array of sessions; turns stay undated."""
    from trailspark.functions.text import normalise_ts

    v = F.col("v")
    listed = index.select(said(v, "sessionId").alias("_session"), normalise_ts(said(v, "dateCreated")).alias("_t")).where("_session IS NOT NULL AND _t.ts_utc IS NOT NULL").dropDuplicates(["_session"])
    joined = events.join(listed, (F.col("session_id") == F.col("_session")) & (F.col("kind") == "session.start") & F.col("ts_utc").isNull(), "left")
    dated = F.col("_t.ts_utc").isNotNull()
    changed = {"ts_utc": F.coalesce("ts_utc", "_t.ts_utc"), "ts_precision": F.when(dated, F.col("_t.ts_precision")).otherwise(F.col("ts_precision")), "ts_source": F.when(dated, "index").otherwise(F.col("ts_source"))}
    return joined.withColumns(changed).select(*events.columns)
