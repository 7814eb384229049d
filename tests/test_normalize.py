"""Golden cases for the normalizers of chats and documents."""

import json

import pytest
from pyspark.sql import functions as F

from trailspark import normalize, sources
from trailspark.normalize import chats, documents
from trailspark.sources.documents import entries, json_documents, read_documents


def put(folder, name, data):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder / name)


def shown(rows):
    """{locator: (kind, payload)} of events, whose ids have to differ."""
    found = rows.collect()
    assert len({r.event_id for r in found}) == len(found)
    return {r.locator: (r.kind, json.loads(r.payload_json or "{}")) for r in found}


def lines(spark, folder, *records):
    return sources.read_jsonl(spark, put(folder, "f.jsonl", "\n".join(r if isinstance(r, str) else json.dumps(r) for r in records)))


def test_copilot(spark, tmp_path):
    event = lambda kind, **data: {"type": kind, "timestamp": "2024-01-01T00:00:00Z", "data": data}
    rows = chats.copilot(lines(
        spark, tmp_path, event("session.start", sessionId="s", model="m1", cwd="/w", copilotVersion="1"), event("user.message", content="go"), event("session.model_change", newModel="m2", previousModel="m1"),
        event("assistant.message", content=[{"text": "a"}, {"text": "b"}]), event("tool.execution_start", toolName="bash", toolCallId="t", arguments={"command": "A=1 ls -l"}), event("tool.execution_complete", toolName="bash", toolCallId="t", success=False, result="no"),
        event("tool.execution_start", toolName="x-y", toolCallId="u", mcpServerName="x", mcpToolName="y", arguments={}), event("subagent.failed", agentName="n", error="e"), event("permission.decision", decision="allow", toolName="bash"), event("later"), "bad",
    )).cache()
    found = shown(rows)
    assert [found[f"line:{i}"][0] for i in range(1, 12)] == ["session.start", "user.prompt", "config.snapshot", "assistant.text", "tool.call", "tool.result", "mcp.call", "session.end", "permission.decision", "unparsed.record", "unparsed.record"]
    assert found["line:5#effect"] == ("command.exec", {"tool": "bash", "tool_use_id": "t", "commands": [{"command": "A=1 ls -l", "executable": "ls", "cwd": "/w"}]})
    assert found["line:4"][1] == {"text": "a\nb", "models": [{"model": "m2"}]} and found["line:6"][1]["is_error"] is True and found["line:7"][1]["mcp"] == [{"server": "x", "tool": "y"}]
    assert {(r.session_id, r.project_path) for r in rows.collect()} == {("s", "/w")} and found["line:8"][1]["text"] == "subagent.failed: n (e)"


def test_gemini(spark, tmp_path):
    rows = chats.gemini(lines(
        spark, tmp_path, {"sessionId": "s", "projectHash": "h", "startTime": "2024-01-01T00:00:00Z"}, {"id": "1", "type": "user", "content": "hi"},
        {"id": "2", "type": "gemini", "model": "g", "tokens": {"input": 5, "output": 7}, "thoughts": [{"subject": "S", "description": "D", "timestamp": "2024-01-01T00:00:01Z"}], "content": [{"text": "hm", "thought": True}, {"text": "ok"}],
         "toolCalls": [{"id": "c", "name": "write_file", "args": {"file_path": "/a", "content": "é"}, "status": "success", "result": "done"}]},
        {"$set": {"summary": "x", "b": 1}}, {"$rewindTo": "1"}, {"id": "3", "type": "gemini", "content": [{"functionCall": {"id": "d", "name": "web_fetch", "args": {"prompt": "see https://Ex.org/p now"}}}]}, {"odd": 1},
    ))
    found = shown(rows)
    assert {k: v[0] for k, v in found.items()} == {
        "line:1": "session.start", "line:2": "user.prompt", "line:3#thought0": "assistant.thinking", "line:3#thinking": "assistant.thinking", "line:3": "assistant.text", "line:3#tool0": "tool.call", "line:3#effect-tool0": "file.write",
        "line:3#result-tool0": "tool.result", "line:4": "config.snapshot", "line:5": "session.end", "line:6#part0": "tool.call", "line:6#effect-part0": "network.request", "line:7": "unparsed.record",
    }
    assert found["line:3"][1] == {"text": "ok", "models": [{"model": "g", "input_tokens": 5, "output_tokens": 7}], "message_id": "2"} and found["line:3#thought0"][1]["text"] == "D"
    assert found["line:3#effect-tool0"][1]["files"] == [{"path": "/a", "operation": "write", "bytes": 2}] and found["line:6#effect-part0"][1]["network"] == [{"url": "https://Ex.org/p", "host": "ex.org"}]
    assert found["line:4"][1]["updated"] == ["b", "summary"] and found["line:5"][1]["rewind_to"] == "1"


def test_qwen_and_prompt_log(spark, tmp_path):
    base = {"sessionId": "s", "cwd": "/w", "uuid": "u", "timestamp": "2024-01-01T00:00:00Z"}
    rows = chats.qwen(lines(
        spark, tmp_path / "q", {**base, "type": "user", "message": {"parts": [{"text": "hi"}, {"inlineData": {"x": 1}}]}}, {**base, "type": "assistant", "model": "m", "usageMetadata": {"promptTokenCount": 2}, "message": {"parts": [{"functionCall": {"id": "c", "name": "run_shell_command", "args": {"command": "ls"}}}]}},
        {**base, "type": "tool_result", "message": {"parts": [{"functionResponse": {"id": "c", "name": "run_shell_command", "response": {"output": "x"}}}]}}, {**base, "type": "system", "subtype": "chat_compression", "message": {"parts": []}}, {**base, "type": "zzz"},
    ))
    found = shown(rows)
    assert {k: v[0] for k, v in found.items()} == {"line:1": "user.prompt", "line:2#tool0": "tool.call", "line:2#effect-tool0": "command.exec", "line:3#result0": "tool.result", "line:4": "session.end", "line:5": "unparsed.record"}
    assert found["line:1"][1]["other_parts"] == [{"inlineData": {"x": 1}}] and found["line:3#result0"][1]["output"] == {"output": "x"}
    path = put(tmp_path / "p", "logs.json", json.dumps([{"sessionId": "s", "messageId": 0, "type": "user", "message": "a", "timestamp": "2024-01-01T00:00:00Z"}, 7]))
    log = chats.prompt_log(entries(json_documents(read_documents(spark, path))))
    assert {k: v[0] for k, v in shown(log).items()} == {"index:0": "prompt.history", "index:1": "unparsed.record"}
    assert shown(chats.prompt_log(entries(json_documents(read_documents(spark, put(tmp_path / "o", "l.json", "{}"))))))["document"][0] == "unparsed.record"


def test_pi(spark, tmp_path):
    say = lambda role, content, **more: {"type": "message", "id": "i", "parentId": "p", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": role, "content": content, **more}}
    rows = chats.pi(lines(
        spark, tmp_path, {"type": "session", "id": "s", "cwd": "/w", "version": 3}, say("user", "go"), {"type": "model_change", "modelId": "m", "provider": "x"},
        say("assistant", [{"type": "thinking", "thinking": "t"}, {"type": "text", "text": "a"}, {"type": "toolCall", "id": "c", "name": "bash", "arguments": {"command": ["ls", "-l"]}}, {"type": "image"}], usage={"input": 1, "cost": {"total": 0.5}}),
        say("toolResult", [{"type": "text", "text": "r"}], toolName="bash", toolCallId="c", isError=True), {"type": "compaction", "summary": "s"}, {"type": "odd"},
    ))
    found = shown(rows)
    assert {k: v[0] for k, v in found.items()} == {
        "line:1": "session.start", "line:2": "user.prompt", "line:3": "config.snapshot", "line:4#thinking": "assistant.thinking", "line:4": "assistant.text", "line:4#tool0": "tool.call", "line:4#effect0": "command.exec",
        "line:4#block0": "unparsed.record", "line:5": "tool.result", "line:6": "session.end", "line:7": "unparsed.record",
    }
    assert found["line:4#effect0"][1]["commands"] == [{"command": "ls -l", "executable": "ls", "cwd": "/w"}] and found["line:4"][1]["models"] == [{"model": "m", "input_tokens": 1, "cost": 0.5}] and found["line:5"][1]["is_error"] is True


def test_cline(spark, tmp_path):
    folder = tmp_path / "tasks" / "77"
    history = [
        {"role": "user", "content": [{"type": "text", "text": "go"}, {"type": "tool_result", "tool_use_id": "c", "content": [{"type": "text", "text": "out"}], "is_error": False}]},
        {"role": "assistant", "content": [{"type": "thinking", "thinking": "t"}, {"type": "tool_use", "id": "d", "name": "execute_command", "input": {"command": "make", "cwd": "/b"}}, {"type": "tool_use", "id": "e", "name": "use_mcp_tool", "input": {"server_name": "s", "tool_name": "t"}}]},
        {"role": "assistant", "content": "plain"}, {"role": "robot"},
    ]
    read = lambda name, data: json_documents(read_documents(spark, put(folder, name, data)))
    rows = chats.cline_history(entries(read("api.json", json.dumps(history))))
    found = shown(rows)
    assert {k: v[0] for k, v in found.items()} == {
        "index:0": "user.prompt", "index:0#result0": "tool.result", "index:1#thinking": "assistant.thinking", "index:1#tool0": "tool.call", "index:1#effect0": "command.exec", "index:1#tool1": "mcp.call", "index:2": "assistant.text", "index:3": "unparsed.record",
    }
    assert found["index:2"][1]["text"] == "plain" and found["index:1#tool1"][1]["mcp"] == [{"server": "s", "tool": "t"}] and {r.session_id for r in rows.collect()} == {"77"}
    ui = chats.cline_ui(entries(read("ui.json", '[{"ts": 1700000000000, "type": "ask", "ask": "command", "text": "rm"}, {"type": "say", "say": "reasoning", "text": "r"}, {"type": "say", "say": "user_feedback", "text": "no"}, {"type": "say", "say": "text", "text": "t"}, // c\n]')))
    assert [v[0] for _, v in sorted(shown(ui).items())] == ["permission.decision", "assistant.thinking", "user.prompt", "assistant.text"] and shown(ui)["index:0"][1]["permissions"] == [{"decision": "asked", "subject": "command"}]
    meta = chats.cline_documents(read("task_metadata.json", '{"files_in_context": [{"path": "/a"}, {}], "model_usage": {"m": 1}}')).first()
    assert meta.kind == "config.snapshot" and json.loads(meta.payload_json)["files"] == [{"path": "/a", "operation": "unknown"}] and json.loads(meta.payload_json)["models"] == [{"model": "m"}]


def test_hooks_and_continue(spark, tmp_path):
    rows = chats.hook_log(lines(spark, tmp_path / "h", {"hookName": "prompt_submit", "prompt": "p", "taskId": "t", "timestamp": 1700000000}, {"hookName": "tool_call", "toolName": "x"}, {"hookName": "new"})).collect()
    assert sorted((r.kind, r.actor) for r in rows) == [("tool.call", "assistant"), ("unparsed.record", "unknown"), ("user.prompt", "user")]
    session = {"sessionId": "s", "title": "T", "workspaceDirectory": "/w", "history": [{"message": {"role": "user", "content": "q"}}, {"message": {"role": "assistant", "content": "", "toolCalls": [{"id": "c", "function": {"name": "f", "arguments": '{"a": 1}'}}]}}, {"message": {"role": "tool", "toolCallId": "c", "content": "r"}}]}
    read = lambda name, data: json_documents(read_documents(spark, put(tmp_path / "c", name, json.dumps(data))))
    rows = chats.continue_sessions(read("s.json", session))
    found = shown(rows)
    assert {k: v[0] for k, v in found.items()} == {"document": "session.start", "document#turn0": "user.prompt", "document#turn1#tool0": "tool.call", "document#turn2": "tool.result"} and found["document#turn1#tool0"][1]["input"] == {"a": 1}
    dated = chats.session_times(rows, entries(read("i.json", [{"sessionId": "s", "dateCreated": "1700000000000"}])))
    assert {(r.kind, r.ts_utc is not None) for r in dated.collect()} == {("session.start", True), ("user.prompt", False), ("tool.call", False), ("tool.result", False)}


def test_documents_and_relaxed_json(spark, tmp_path):
    put(tmp_path / "d", "a.json", '\ufeff{"x": "// kept, ]", /* c */ "l": [1, 2,], // end\n}')
    put(tmp_path / "d", "b.json", b"\x00\x01binary")
    put(tmp_path / "d", "c.json", b'{"a": "\xff"}')
    put(tmp_path / "d", "d.json", "{broken")
    rows = {r.path[-6:]: r for r in json_documents(read_documents(spark, str(tmp_path / "d"))).select("path", F.to_json("v").alias("v"), "problem", "binary", "size").collect()}
    assert (rows["a.json"].v, rows["a.json"].problem) == ('{"l":[1,2],"x":"// kept, ]"}', "read as relaxed JSON")
    assert rows["b.json"].binary and rows["b.json"].problem == "not a text file" and rows["c.json"].problem == "some bytes are no UTF-8" and rows["d.json"].problem == "not JSON"


def test_generic_documents(spark, tmp_path):
    put(tmp_path / "g", "a.json", json.dumps({"sessionId": "s", "messages": [{"text": "a", "timestamp": 1700000000}, {"text": "b"}], "n": [1, 2], "title": "T"}))
    put(tmp_path / "g", "b.json", "{}")
    rows = documents.generic_documents(json_documents(read_documents(spark, str(tmp_path / "g"))), "x", "x.d").collect()
    assert sorted((r.original_path[-6:], r.locator, r.ts_precision) for r in rows) == [("a.json", "document", "absent"), ("a.json", "document#messages[0]", "second"), ("a.json", "document#messages[1]", "absent"), ("b.json", "document", "absent")]
    assert all("uninterpreted" in r.parse_problem for r in rows) and [r for r in rows if r.original_path.endswith("b.json")][0].parse_problem.startswith("the file was read and is empty")
    few = documents.generic_documents(json_documents(read_documents(spark, str(tmp_path / "g" / "a.json"))), "x", "x.d", limit=1)
    assert few.count() == 1
    toml = json_documents(read_documents(spark, put(tmp_path / "t", "a.toml", 'a = 1\n[[l]]\nname = "n"\n')), "toml")
    assert {k: v[1].get("text") for k, v in shown(documents.generic_documents(toml, "x", "x.t", configuration=True)).items()} == {"document": None, "document#l[0]": "n"}
    assert json_documents(read_documents(spark, put(tmp_path / "y", "a.yaml", "a: [")), "yaml").first().problem == "not YAML"


def test_text_logs_and_prose(spark, tmp_path):
    rows = documents.text_log(sources.read_lines(spark, put(tmp_path / "l", "a.log", "[2024-01-01 10:00:00,5] start\n\nat 2024-01-01T10:00:00Z later\n")), "x", "x.log").collect()
    assert sorted((r.locator, r.ts_utc) for r in rows) == [("line:1", "2024-01-01T10:00:00.500000Z"), ("line:3", None)]
    row = documents.prose(read_documents(spark, put(tmp_path / "p", "plan.md", "do it")), "x", "x.plan").first()
    assert (row.kind, json.loads(row.payload_json)) == ("plan.write", {"text": "do it"})


@pytest.mark.parametrize(
    "path,roots,scope",
    [
        ("/etc/x/CLAUDE.md", ["/w"], "managed"), ("C:\\ProgramData\\x\\a.md", [], "managed"), ("/w/CLAUDE.local.md", ["/w"], "local"), ("/w/a/CLAUDE.md", ["/W/"], "project"), ("/home/u/CLAUDE.md", ["/w"], "user"), ("/home/u/CLAUDE.md", [], "unknown"),
        ("/wide/CLAUDE.md", ["/w"], "user"),
    ],
)
def test_scopes(spark, path, roots, scope):
    found = spark.createDataFrame([(path, roots)], "p string, r array<string>").select(documents.scope_of(F.col("p"), F.col("r"))).first()[0]
    assert found == scope


def test_instructions_and_memories(spark, tmp_path):
    put(tmp_path / "i", "SKILL.md", "---\nname: s\nallowed-tools: Bash, Read\n---\n# The skill\nbe\u200bkind")
    put(tmp_path / "i", "hook.sh", "#!/bin/sh\n# not a title\nls")
    put(tmp_path / "i", "p.json", '{"a": {"systemPrompt": "obey"}}')
    put(tmp_path / "i", "bad.md", "---\nname: [\n---\nx")
    root = str(tmp_path / "i")
    rows = documents.instructions(read_documents(spark, root), "x", "x.i", F.array(F.lit("file:" + root), F.lit(root))).collect()
    found = {r.original_path.rsplit("/", 1)[1]: (json.loads(r.payload_json), r.parse_problem) for r in rows}
    about = found["SKILL.md"][0]["instructions"][0]
    assert (about["title"], about["tools"], about["hidden_characters"], about["executable"]) == ("The skill", ["Bash", "Read"], [{"code": 0x200B, "n": 1}], False) and found["SKILL.md"][0]["front_matter"]["name"] == "s"
    assert found["hook.sh"][0]["instructions"][0]["executable"] and "title" not in found["hook.sh"][0]["instructions"][0]
    assert found["p.json"][0]["text"] == "obey" and found["p.json"][0]["instructions"][0]["from_json"] and "front matter" in found["bad.md"][1]
    memory = documents.memories(read_documents(spark, root + "/hook.sh"), "x", "x.m").first()
    assert memory.kind == "memory.write" and "instructions" not in json.loads(memory.payload_json)


def test_file_times_and_registry(spark, tmp_path):
    row = documents.file_times(read_documents(spark, put(tmp_path / "f", "a", "x")), "ag").first()
    assert (row.kind, row.ts_precision, row.ts_source, json.loads(row.payload_json)["files"][0]["bytes"]) == ("artifact.fs", "filesystem", "mtime", 1)
    put(tmp_path / "r", "a.json", json.dumps({"key": "HKCU\\Software\\X", "last_write_utc": "2024-01-01T00:00:00Z", "values": [{"name": "v", "type": "REG_SZ", "data": "d"}, 3]}))
    put(tmp_path / "r", "b.json", json.dumps({"key": "HKLM\\Y", "values": []}))
    put(tmp_path / "r", "c.json", "[]")
    rows = documents.registry(json_documents(read_documents(spark, str(tmp_path / "r"))), "x", "x.r").collect()
    assert sorted((r.original_path[-6:], r.kind, r.locator) for r in rows) == [
        ("a.json", "config.snapshot", "document:value:0"), ("a.json", "unparsed.record", "document:value:1"), ("b.json", "config.snapshot", "document:key"), ("c.json", "unparsed.record", "document"),
    ]


def test_prompt_and_shell_histories(spark, tmp_path):
    read = lambda name, text: sources.read_lines(spark, put(tmp_path / name, "h", text))
    rows = documents.prompt_toolkit(read("p", "\n# 2024-01-01 10:00:00.5\n+a\n+b\n\n+c\nstray\n")).collect()
    assert sorted((r.locator, r.kind, json.loads(r.payload_json)["text"], r.ts_precision) for r in rows) == [("line:3", "prompt.history", "a\nb", "exact"), ("line:6", "prompt.history", "c", "absent"), ("line:7", "unparsed.record", "stray", "absent")]
    rows = documents.rustyline(read("r", "#V2\na\\nb\\\\n\nc\\d\n"), "q").collect()
    assert sorted((r.locator, json.loads(r.payload_json)["text"], r.parse_problem is not None) for r in rows) == [("line:2", "a\nb\\n", False), ("line:3", "c\\d", True)]
    command = lambda rows: sorted((r.locator, r.kind, json.loads(r.payload_json).get("commands", [{}])[0].get("command"), r.ts_utc) for r in rows.collect())
    fish = normalize.shell_history(read("f", "junk\n- cmd: echo a\\nb\n  when: 1700000000\n  paths:\n    - x\n- cmd: ls\n"), "fish")
    assert command(fish) == [("line:1", "unparsed.record", None, None), ("line:2", "command.exec", "echo a\nb", "2023-11-14T22:13:20.000000Z"), ("line:6", "command.exec", "ls", None)]
    assert command(normalize.shell_history(read("w", "a `\nb\nc\n"), "powershell")) == [("line:1", "command.exec", "a \nb", None), ("line:3", "command.exec", "c", None)]
    assert command(normalize.shell_history(read("c", "a \\\nb\nc\\\\\nd\n"), "recall")) == [("line:1", "command.exec", "a  b", None), ("line:3", "command.exec", "c\\\\", None), ("line:4", "command.exec", "d", None)]
