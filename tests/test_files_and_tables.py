"""Golden cases for pattern lists, settings, shell scripts, snapshots and agents' own tables."""

import json

from pyspark.sql import functions as F

from trailspark import sources
from trailspark.normalize import files, tables
from trailspark.sources.documents import read_documents
from trailspark.sources.trees import read_tree


def put(folder, **named):
    for name, data in named.items():
        path = folder / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder)


def test_pattern_lists_and_settings(spark, tmp_path):
    folder = put(tmp_path / "a", **{"embeddable_files.txt": "# why\n\n *.env \nbuild/\n", "plain.txt": "k=v\n", "bin": b"\0\1", ".hidden": "x"})
    lines, docs = sources.read_lines(spark, folder), read_documents(spark, folder)
    hidden = {r.original_path: r.problem for r in read_tree(spark, folder).collect()}
    assert len(hidden) == 4 and [p for p, said in hidden.items() if said and "hides" in said] == ["/.hidden"]
    lines = lines.withColumn("path", F.replace("path", F.lit("embeddable_files.txt"), F.lit(".aiderignore")))
    docs = docs.withColumn("path", F.replace("path", F.lit("embeddable_files.txt"), F.lit(".aiderignore")))
    found = {r.locator: (json.loads(r.payload_json), json.loads(r.raw_json), r.parse_problem) for r in files.pattern_lists(lines, "aider", "aider.ignore").collect()}
    assert {k: v[0]["key"] for k, v in found.items()} == {"line:1": "ignore:# why", "line:3": "ignore:*.env", "line:4": "ignore:build/"}
    assert found["line:1"][1] == {"comment": "# why"} and "comment" in found["line:1"][2] and found["line:3"][1] == {"pattern": "*.env"} and "kept from" in found["line:3"][2]
    assert files.pattern_lists(lines, "x", "windsurf.ignore_files").count() == 5  # the artifact says what plain.txt is; the binary one has a line too
    kept = {r.original_path.rsplit("/", 1)[1]: (r.kind, r.parse_problem, json.loads(r.payload_json)) for r in files.settings_files(docs, "x", "x.config").collect()}
    assert set(kept) == {"plain.txt", "bin"} and kept["bin"][:2] == ("unparsed.record", "not a text file")
    assert kept["plain.txt"][2] == {"key": "file:plain.txt", "text": "k=v\n"}
    gone = files.settings_files(docs, "hermes", "hermes.profile_tombstones").where("original_path like '%plain.txt'").first()
    assert json.loads(gone.payload_json)["key"] == "deleted-profile:plain.txt" and "deleted" in gone.parse_problem


def test_shell_scripts(spark, tmp_path):
    script = "export A=1\nexport B\nexport C=''\nset -gx D 'x y'\nset -g E 1\nalias ll=\"ls -l\"\n}\nf() {\n  export INNER=1\n  g() {\n}\nfunction h () {\necho $A\n"
    found = {r.locator: r for r in files.shell_scripts(sources.read_lines(spark, put(tmp_path / "s", rc=script)), "claude_code", "claude_code.shell_snapshots").collect()}
    said = {k: json.loads(r.payload_json) for k, r in found.items()}
    assert {k: v.get("key") for k, v in said.items()} == {
        "line:1": "export:A", "line:2": "export:B", "line:3": "export:C", "line:4": "export:D", "line:5": None, "line:6": "alias:ll", "line:7": None, "line:8": "function:f", "line:12": "function:h",
    }
    assert [said[f"line:{i}"]["text"] for i in (1, 2, 3, 4, 6, 8)] == ["export A=1", "export B", "export C=", "export D=x y", "alias ll=ls -l", "f() {\n  export INNER=1\n  g() {\n}"]
    assert [found[f"line:{i}"].kind for i in (5, 7)] == ["unparsed.record"] * 2
    assert found["line:8"].parse_problem is None and "close" in found["line:12"].parse_problem
    assert json.loads(found["line:2"].raw_json) == {"kind": "export", "name": "B"} and json.loads(found["line:3"].raw_json)["value"] == ""


def test_file_snapshots(spark, tmp_path):
    folder = put(tmp_path / "f", **{"file-history__s1__0123456789abcdef@v2": "old", "file-history__s1__other": b"\0"})
    found = {r.original_path.rsplit("/", 1)[1]: r for r in files.file_snapshots(read_documents(spark, folder, recursive=True), "claude_code", "claude_code.file_history_snapshots").collect()}
    one = found["0123456789abcdef@v2"]
    raw = json.loads(one.raw_json)
    assert (one.kind, one.session_id, one.ts_utc, raw["original_path_sha256_prefix"], raw["version"], raw["content"]) == ("file.snapshot", "s1", None, "0123456789abcdef", 2, "old")
    assert "not a text file" in found["other"].parse_problem and json.loads(found["other"].payload_json) == {"file": "other", "bytes": 1}


def test_local_history(spark, tmp_path):
    index = lambda rows, resource="file:///w/a%20b.py": json.dumps({"version": 1, "resource": resource, "entries": rows})
    folder = put(
        tmp_path / "h",
        **{
            "1__entries.json": index([{"id": "aa.py", "timestamp": 1700000000000, "source": "Edit"}, "odd", {"id": "gone.py"}, {"id": "aa.py", "source": "later"}]), "1__aa.py": "text", "1__bb.py": "left over",
            "2__entries.json": "{broken", "2__cc.py": "x", "3__dd.py": "y", "4__entries.json": index([{"id": "ee.py"}], "vscode-remote://ssh/w/e.py"), "4__ee.py": "z", "5__entries.json": json.dumps({"entries": [{"id": "ff"}]}), "5__ff": b"\0",
        },
    )
    rows = files.local_history(read_documents(spark, folder, recursive=True), "vscode", "vscode.local_history").collect()
    found = {"/".join(r.original_path.rsplit("/", 2)[1:]): r for r in rows}
    assert len(rows) == len({r.event_id for r in rows}) == 10
    aa = found["1/aa.py"]
    assert (aa.ts_utc, json.loads(aa.raw_json)["version_source"], json.loads(aa.payload_json)["original_path"]) == ("2023-11-14T22:13:20.000000Z", "Edit", "/w/a b.py") and aa.parse_problem is None
    assert found["1/bb.py"].parse_problem == "the index beside this copy doesn't list it" and found["1/bb.py"].ts_utc is None
    assert found["2/cc.py"].parse_problem == "the index beside this copy can't be read" and found["3/dd.py"].parse_problem == "no index lies beside this copy"
    assert "another machine" in found["4/ee.py"].parse_problem and found["5/ff"].parse_problem == "not a text file; the index names no file"
    assert found["2/entries.json"].kind == "unparsed.record" and "can't be read" in found["2/entries.json"].parse_problem
    assert "gone.py" in found["1/entries.json"].parse_problem and [x["id"] for x in json.loads(found["1/entries.json"].payload_json)["versions"]] == ["aa.py", "gone.py", "aa.py"]


def table(spark, *rows):
    names = sorted({k for r in rows for k in r})
    kinds = {k: "double" if any(isinstance(r.get(k), float) for r in rows) else "long" if any(isinstance(r.get(k), int) for r in rows) else "string" for k in names}
    return spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], ", ".join(f"{k} {kinds[k]}" for k in names))


def shown(rows):
    found = {r.locator: r for r in rows.collect()}
    assert len(found) == len({r.event_id for r in found.values()})
    return found, {k: json.loads(r.payload_json) for k, r in found.items()}


def test_opencode(spark):
    sessions = table(spark, {"rowid": 1, "id": "s1", "directory": "/w", "agent": "build", "model": "m", "title": "T", "version": "1.0", "time_created": 1700000000000, "time_archived": 1700000001000, "tokens_input": 5, "cost": 0.5})
    inputs = table(spark, {"rowid": 1, "session_id": "s1", "prompt": "do", "delivery": "queue", "time_created": 1700000000500}, {"rowid": 2, "session_id": "s9", "prompt": "lost"})
    say = lambda i, session="s1", kind=None, **data: {"rowid": i, "session_id": session, "type": kind, "data": json.dumps(data) if data else "", "time_created": 1700000000000 + i}
    bash = {"type": "tool", "id": "c", "name": "bash", "state": {"status": "error", "input": {"command": "FOO=1 ls -l"}, "content": [{"text": "o1"}, {"uri": "u"}], "error": "bad"}}
    read = {"type": "tool", "id": "d", "name": "read", "state": {"status": "running", "input": {"filePath": "/w/a"}}}
    messages = table(
        spark, say(1, kind="user", text="hi", files=[{"uri": "file:///a"}, {"x": 1}], agents=[{"name": "sub"}]), say(2, kind="assistant", model={"providerID": "p", "modelID": "q"}, content=[{"type": "text", "text": "t"}, {"type": "reasoning", "text": "r"}, bash, read, {"type": "new"}, "no object"]),
        say(3, kind="assistant", finish="stop"), say(4, kind="synthetic", text="ins"), say(5, kind="shell", command="pwd", output="/w", callID="k"), say(6, kind="model-switched", model="m2"), say(7, kind="compaction", summary="sum", reason="auto"),
        say(8, kind="other", x=1), say(9, kind="user"), {"rowid": 10, "session_id": "s1", "type": "user", "data": "[1]"}, say(11, session="s7", kind="user", text="alone"), say(12, session=None, type="user", text="nobody"),
    )
    found, said = shown(tables.opencode(sessions, inputs, messages, "/db"))
    m = "table:session_message rowid:"
    assert found["table:session rowid:1"].kind == "session.start" and said["table:session rowid:1"]["models"] == [{"model": "m"}] and said["table:session rowid:1"]["tokens"]["input"] == 5 and found["table:session rowid:1"].client == "1.0"
    assert found["table:session rowid:1 archived"].kind == "session.end" and found["table:session rowid:1 archived"].ts_utc == "2023-11-14T22:13:21.000000Z"
    assert found["table:session_input rowid:1"].project_path == "/w" and found["table:session_input rowid:2"].parse_problem == "no row of the session's own is there" and said["table:session_input rowid:2"]["text"] == "lost"
    assert said[m + "1"]["files"] == [{"path": "file:///a", "operation": "unknown"}] and said[m + "1"]["subagents"] == ["sub"]
    assert {k.removeprefix(m + "2 content:"): r.kind for k, r in found.items() if k.startswith(m + "2 ")} == {
        "0": "assistant.text", "1": "assistant.thinking", "2": "tool.call", "2 effect": "command.exec", "2 result": "tool.result", "3": "tool.call", "3 effect": "file.read", "4": "unparsed.record",
    }
    assert said[m + "2 content:0"]["models"] == [{"model": "p/q"}] and said[m + "2 content:2 effect"]["commands"] == [{"command": "FOO=1 ls -l", "executable": "ls", "cwd": "/w"}]
    assert {k: said[m + "2 content:2 result"][k] for k in ("output", "is_error", "error")} == {"output": "o1\nu", "is_error": True, "error": "bad"}
    assert [found[m + str(i)].kind for i in (3, 4, 5, 6, 7, 8, 9, 10)] == ["assistant.text", "instruction.source", "command.exec", "config.snapshot", "session.end", "unparsed.record", "unparsed.record", "unparsed.record"]
    assert said[m + "3"] == {"text": "", "finish": "stop"} and said[m + "6"]["models"] == [{"model": "m2"}] and "other" in found[m + "8"].parse_problem and "empty" in found[m + "9"].parse_problem and "no JSON object" in found[m + "10"].parse_problem
    assert found[m + "11"].session_id == "s7" and "no row" in found[m + "11"].parse_problem and "names no session" in found[m + "12"].parse_problem and found[m + "12"].kind == "user.prompt"
    alone, _ = shown(tables.opencode(None, None, messages, "/db"))
    assert len(alone) == sum(k.startswith(m) for k in found) and alone[m + "1"].parse_problem is None


def test_goose(spark):
    sessions = table(spark, {"rowid": 1, "id": "s", "name": "N", "working_dir": "/w", "created_at": "2024-01-01 10:00:00", "goose_mode": "auto", "provider_name": "p", "model_config_json": '{"model_name": "m"}', "input_tokens": 3})
    block = lambda i, *blocks, role="user", meta=None, session="s": {"rowid": i, "session_id": session, "role": role, "content_json": json.dumps(list(blocks)), "metadata_json": json.dumps(meta) if meta else None, "created_timestamp": 1700000000 + i}
    request = {"type": "toolRequest", "id": "c", "toolCall": {"status": "success", "value": {"name": "developer__shell", "arguments": {"command": "ls"}}}}
    response = {"type": "toolResponse", "id": "c", "toolResult": {"status": "success", "value": {"content": [{"type": "text", "text": "out"}], "isError": True}}}
    messages = table(
        spark, block(1, {"type": "text", "text": "hi"}), block(2, {"type": "text", "text": "a"}, {"type": "thinking", "thinking": "t"}, {"type": "redactedThinking"}, request, role="assistant"), block(3, response, {"type": "image", "mimeType": "image/png"}),
        block(4, {"type": "text", "text": "ctx"}, meta={"turnContext": True, "userVisible": False}), block(5, {"type": "text", "text": "x"}, role="system"), block(6), {"rowid": 7, "session_id": "s", "role": "user", "content_json": "{"},
        block(8, {"type": "toolConfirmationRequest", "toolName": "shell", "id": "k"}, {"type": "error", "message": "oops"}, role="assistant"), block(9, {"type": "text", "text": "y"}, session="none"),
    )
    threads = table(spark, {"rowid": 1, "id": "t", "name": "Th", "working_dir": "/t", "created_at": "2024-01-02 10:00:00", "archived_at": "2024-01-03 10:00:00"})
    talk = table(spark, {"rowid": 1, "thread_id": "t", "role": "user", "content_json": '[{"type": "text", "text": "in thread"}]', "created_timestamp": 1700000100})
    found, said = shown(tables.goose(sessions, messages, threads, talk, "/db"))
    m = "table:messages rowid:"
    assert said["table:sessions rowid:1"]["models"] == [{"model": "p/m"}] and said["table:sessions rowid:1"]["permissions"] == [{"mode": "auto", "decision": "set"}] and found["table:sessions rowid:1"].ts_utc == "2024-01-01T10:00:00.000000Z"
    assert {k.removeprefix(m): r.kind for k, r in found.items() if k.startswith(m)} == {
        "1 content:0": "user.prompt", "2 content:0": "assistant.text", "2 content:1": "assistant.thinking", "2 content:2": "assistant.thinking", "2 content:3": "tool.call", "2 content:3 effect": "command.exec", "3 content:0": "tool.result",
        "3 content:1": "user.prompt", "4 content:0": "instruction.source", "5": "unparsed.record", "6": "unparsed.record", "7": "unparsed.record", "8 content:0": "permission.decision", "8 content:1": "unparsed.record", "9 content:0": "user.prompt",
    }
    assert said[m + "2 content:3"]["extension"] == "developer" and said[m + "2 content:3 effect"]["commands"][0] == {"command": "ls", "executable": "ls", "cwd": "/w"}
    assert said[m + "3 content:0"]["output"] == "out" and said[m + "3 content:0"]["is_error"] is True and said[m + "3 content:1"]["text"] == "[image: image/png]"
    assert "not shown" in found[m + "4 content:0"].parse_problem and "role" in found[m + "5"].parse_problem and "no JSON array" in found[m + "7"].parse_problem and "no row" in found[m + "9 content:0"].parse_problem
    assert found["table:thread_messages rowid:1 content:0"].project_path == "/t" and found["table:threads rowid:1 archived"].kind == "session.end"


def test_codex_items_and_turns(spark):
    item = lambda i, kind, column=None, **doc: {"rowid": i, "thread_id": "t", "turn_id": "u", "item_id": f"i{i}", "item_type": column or kind, "item_json": json.dumps({"type": kind, **doc}), "created_at_ms": 1700000000000 + i}
    rows = table(
        spark, item(1, "userMessage", content=[{"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "image"}]), item(2, "reasoning", summary=["x"], content=["y"]), item(3, "commandExecution", command="rm -rf z", cwd="/w", exitCode=1, aggregatedOutput="o"),
        item(4, "fileChange", changes=[{"path": "/a", "kind": {"type": "delete"}, "diff": "d"}, {"path": "/b"}]), item(5, "mcpToolCall", server="s", tool="t", error={"m": 1}), item(6, "webSearch", query="q", action={"url": "https://H.example/x"}), item(7, "agentMessage", column="plan", text="t"),
        item(8, "later"), {"rowid": 9, "thread_id": "t", "item_type": "plan", "item_json": None}, {"rowid": 10, "item_type": None, "item_json": "{"}, item(11, "subAgentActivity") | {"item_json": json.dumps({"type": "subAgentActivity", "kind": "started", "agentPath": "/p"})},
        item(12, "functionCallOutput", name="f", output=[{"text": "r"}]), item(13, "exitedReviewMode", review="r"), item(14, "imageGeneration", savedPath="/i.png"),
    )
    found, said = shown(tables.codex_items(rows, "/db"))
    m = "table:thread_items rowid:"
    assert [found[m + str(i)].kind for i in range(1, 15)] == [
        "user.prompt", "assistant.thinking", "command.exec", "file.write", "mcp.call", "network.request", "assistant.text", "unparsed.record", "plan.write", "unparsed.record", "session.start", "tool.result", "config.snapshot", "tool.call",
    ]
    assert said[m + "1"]["text"] == "a\nb" and said[m + "1"]["input"] == [{"type": "image"}] and said[m + "2"]["text"] == "x\ny" and said[m + "3"]["commands"] == [{"command": "rm -rf z", "executable": "rm", "cwd": "/w", "exit_code": 1}]
    assert said[m + "4"]["files"] == [{"path": "/a", "operation": "delete"}, {"path": "/b", "operation": "write"}] and said[m + "5"]["is_error"] is True and said[m + "6"]["network"][0]["host"] == "h.example"
    assert "says plan and the document says agentMessage" in found[m + "7"].parse_problem and "later" in found[m + "8"].parse_problem and "empty" in found[m + "9"].parse_problem and found[m + "9"].ts_utc is None
    assert found[m + "1"].ts_utc == "2023-11-14T22:13:20.001000Z" and said[m + "12"]["text"] == "r" and said[m + "14"]["files"] == [{"path": "/i.png", "operation": "write"}]
    turns, said = shown(tables.codex_turns(table(spark, {"rowid": 1, "thread_id": "t", "turn_id": "u", "status": "done", "duration_ms": 5, "error_json": "{}"}), "/db"))
    assert said["table:thread_turns rowid:1"]["text"] == "turn u is done, after 5 ms, and it recorded an error" and turns["table:thread_turns rowid:1"].ts_utc is None
    listed, said = shown(tables.inventory({"b": rows, "a": rows.limit(2)}, "/db", "codex"))
    assert said["store"]["tables"] == [{"table": "a", "rows": 2}, {"table": "b", "rows": 14}]


def test_cline_messages_and_manifests(spark, tmp_path):
    from trailspark.normalize import cline
    from trailspark.sources.documents import json_documents

    patch = "*** Begin Patch\n*** Add File: a b.txt\n+one\n+two\n*** Update File: /w/c.py\n*** Move to: /w/d.py\n@@\n-old\n+new\n keep\n*** Delete File: e\n*** End Patch"
    use = lambda name, given: {"type": "tool_use", "id": name, "name": name, "input": given}
    messages = [
        {"role": "user", "ts": 1700000000000, "content": [{"type": "text", "text": "go"}, {"type": "tool_result", "tool_use_id": "x", "content": [{"text": "out"}], "is_error": True}]},
        {"role": "assistant", "ts": 1700000001000, "modelInfo": {"id": "m"}, "metrics": {"inputTokens": 3}, "content": [
            {"type": "thinking", "thinking": "hm"}, use("run_commands", {"commands": ["FOO=1 ls -l", {"command": "git", "args": ["push", "-f"]}]}), use("read_files", {"files": [{"file_path": "/a"}, "/b"]}), use("editor", {"path": "/e"}),
            use("apply_patch", {"input": patch}), use("fetch_web_content", {"requests": [{"url": "https://x.test/y"}]}), use("run_commands", {"other": 1}), use("skills", {"skill": "s", "args": "q"}), {"type": "new"},
        ]},
        {"role": "user", "content": "text"},
    ]
    folder = put(tmp_path / "c", **{"s1.messages.json": json.dumps({"version": 1, "agent": "lead", "updated_at": "2024-01-01T00:00:00Z", "system_prompt": "be good", "messages": messages, "origin": {"subagent": "sub"}}), "bad.messages.json": "[1]"})
    found = {(r.original_path.rsplit("/", 1)[1], r.locator): r for r in cline.messages(json_documents(read_documents(spark, folder))).collect()}
    one = {k[1].removeprefix("document#"): (r.kind, json.loads(r.payload_json)) for k, r in found.items() if k[0] == "s1.messages.json"}
    assert found["bad.messages.json", "document"].kind == "unparsed.record" and {r.session_id for k, r in found.items() if k[0][0] == "s"} == {"s1"}
    c = "messages[1].content"
    assert {k: v[0] for k, v in one.items()} == {
        "header": "config.snapshot", "system_prompt": "instruction.source", "messages[0].content[0]": "user.prompt", "messages[0].content[1]": "tool.result", f"{c}[0]": "assistant.thinking", f"{c}[1]": "tool.call", f"{c}[1]#command": "command.exec",
        f"{c}[2]": "tool.call", f"{c}[2]#file0": "file.read", f"{c}[2]#file1": "file.read", f"{c}[3]": "tool.call", f"{c}[3]#file0": "file.write", f"{c}[4]": "tool.call", f"{c}[4]#file0": "file.write", f"{c}[4]#file1": "file.write", f"{c}[4]#file2": "file.write",
        f"{c}[5]": "tool.call", f"{c}[5]#network": "network.request", f"{c}[6]": "tool.call", f"{c}[7]": "tool.call", f"{c}[8]": "unparsed.record", "messages[2]": "unparsed.record",
    }
    assert one[f"{c}[1]#command"][1]["commands"] == [{"command": "FOO=1 ls -l", "executable": "ls"}, {"command": "git push -f", "executable": "git"}]
    assert [one[f"{c}[4]#file{i}"][1]["files"][0] for i in range(3)] == [
        {"path": "a b.txt", "operation": "write", "patch_verb": "add", "added": 2, "removed": 0}, {"path": "/w/c.py", "operation": "write", "patch_verb": "update", "moved_to": "/w/d.py", "added": 1, "removed": 1},
        {"path": "e", "operation": "delete", "patch_verb": "delete", "added": 0, "removed": 0},
    ]
    assert "no command" in one[f"{c}[6]"][1]["unread"] and one[f"{c}[7]"][1]["skill"] == "s" and one[f"{c}[0]"][1]["models"] == [{"model": "m", "input_tokens": 3}]
    assert found["s1.messages.json", f"document#{c}[0]"].ts_utc == "2023-11-14T22:13:21.000000Z" and one["header"][1]["subagent"] == "sub" and one["messages[0].content[1]"][1]["is_error"] is True
    folder = put(tmp_path / "m", **{"s2.json": json.dumps({"session_id": "s2", "cwd": "/w", "source": "cli", "started_at": "2024-01-01T00:00:00Z", "status": "failed", "prompt": "p", "model": "m", "exit_code": 1}), "s3.json": "{"})
    rows = {(r.original_path.rsplit("/", 1)[1], r.locator): r for r in cline.manifests(json_documents(read_documents(spark, folder))).collect()}
    assert {k: r.kind for k, r in rows.items()} == {("s2.json", "document#started_at"): "session.start", ("s2.json", "document#prompt"): "user.prompt", ("s2.json", "document#ended_at"): "session.end", ("s3.json", "document"): "unparsed.record"}
    assert rows["s2.json", "document#started_at"].client == "cli" and rows["s2.json", "document#ended_at"].project_path == "/w" and "no time" in json.loads(rows["s2.json", "document#ended_at"].payload_json)["note"]


def test_hermes(spark):
    sessions = table(spark, {"rowid": 1, "id": "s", "title": "T", "model": "m", "cwd": "/w", "git_branch": "b", "system_prompt": "be good", "started_at": 1700000000.5, "ended_at": 1700000002.0, "end_reason": "done"})
    calls = json.dumps([{"id": "c", "function": {"name": "terminal", "arguments": '{"command": "ls"}'}}, {"id": "d", "name": "other", "arguments": {"x": 1}}])
    messages = table(
        spark, {"rowid": 1, "session_id": "s", "role": "user", "content": "hi", "timestamp": 1700000001.0}, {"rowid": 2, "session_id": "s", "role": "assistant", "content": "a", "reasoning": "r", "tool_calls": calls},
        {"rowid": 3, "session_id": "s", "role": "tool", "content": "out", "tool_name": "terminal", "tool_call_id": "c"}, {"rowid": 4, "session_id": "s", "role": "assistant", "codex_message_items": '[{"text": "late"}]'},
        {"rowid": 5, "session_id": "s", "role": "assistant", "reasoning_content": "only"}, {"rowid": 6, "session_id": "x", "role": "system", "content": "sys"}, {"rowid": 7, "session_id": "s", "role": "assistant", "tool_calls": "{"}, {"rowid": 8, "role": "odd"},
    )
    found, said = shown(tables.hermes(sessions, messages, "/db"))
    m = "table:messages rowid:"
    assert {k: r.kind for k, r in found.items()} == {
        "table:sessions rowid:1": "session.start", "table:sessions rowid:1#system_prompt": "instruction.source", "table:sessions rowid:1#end": "session.end", m + "1": "user.prompt", m + "2": "assistant.text", m + "2#reasoning": "assistant.thinking",
        m + "2#tool0": "tool.call", m + "2#tool0effect": "command.exec", m + "2#tool1": "tool.call", m + "3": "tool.result", m + "4#items": "assistant.text", m + "5#reasoning": "assistant.thinking", m + "6": "instruction.source", m + "7": "unparsed.record", m + "8": "unparsed.record",
    }
    assert found[m + "1"].project_path == "/w" and found[m + "1"].git_branch == "b" and found[m + "1"].ts_utc == "2023-11-14T22:13:21.000000Z" and found["table:sessions rowid:1#system_prompt"].ts_utc is None
    assert said[m + "2#tool0effect"]["commands"] == [{"command": "ls", "executable": "ls", "cwd": "/w"}] and said[m + "2#tool1"]["input"] == {"x": 1} and said[m + "4#items"]["text"] == "late" and said[m + "5#reasoning"]["reasoning_only_reply"] is True
    assert "no JSON" in found[m + "7"].parse_problem and "odd" in found[m + "8"].parse_problem and "no row" in found[m + "6"].parse_problem


def test_editor_state(spark, tmp_path):
    from trailspark.sources.documents import json_documents

    base = "/u/workspaceStorage"
    rows = [(f"{base}/1/state.vscdb", 1, "k", '{"a": 1}'), (f"{base}/2/state.vscdb", 1, "k", "x"), (f"{base}/3/state.vscdb", 1, "k", None), ("/u/globalStorage/state.vscdb", 1, "k", "y")]
    items = spark.createDataFrame(rows, "path string, rowid long, key string, value string")
    docs = [(f"{base}/1/workspace.json", '{"folder": "file:///w/a%20b"}'), (f"{base}/2/workspace.json", '{"folder": "vscode-remote://ssh/w"}'), ("/u/globalStorage/workspace.json", '{"folder": "file:///no"}'), (f"{base}/4/workspace.json", "{")]
    documents = json_documents(spark.createDataFrame([(*d, None) for d in docs], "path string, text string, problem string"))
    found = {r.original_path: r for r in tables.editor_state(items, documents).collect()}
    assert len(found) == 8 and found[f"{base}/1/state.vscdb"].project_path == "/w/a b" and json.loads(found[f"{base}/1/state.vscdb"].payload_json)["value"] == {"a": 1}
    assert "another machine" in found[f"{base}/2/state.vscdb"].parse_problem and "no document" in found[f"{base}/3/state.vscdb"].parse_problem
    assert found["/u/globalStorage/state.vscdb"].project_path is None and found["/u/globalStorage/state.vscdb"].parse_problem is None and "not JSON" in found[f"{base}/4/workspace.json"].parse_problem


def test_zed(spark):
    data = {
        "title": "t", "model": {"provider": "p", "model": "m"},
        "messages": [
            {"User": {"id": "u", "content": [{"Text": "a"}, {"Mention": {"uri": "f", "content": "c"}}, {"Image": {}}, {"Text": "b"}, {"New": 1}]}}, "Resume",
            {"Agent": {"content": [{"Text": "x"}, {"Thinking": {"text": "h"}}, {"RedactedThinking": "z"}, {"ToolUse": {"id": "c", "name": "n", "input": {"k": 1}}}, {"A": 1, "B": 2}], "tool_results": {"d": "plain", "c": {"text": "out"}}}},
            {"Compaction": {"Summary": "short"}}, {"Other": 1},
        ],
    }
    rows = table(spark, {"rowid": 1, "id": "s", "summary": "S", "data": json.dumps(data), "folder_paths": "/a,1\n/b", "folder_paths_order": "1,0", "created_at": "2024-01-01T00:00:00Z"}, {"rowid": 2, "id": "r", "data": "{", "folder_paths": "/x\n/y", "folder_paths_order": "0", "updated_at": "2024-01-02T00:00:00Z"})
    found, said = shown(tables.zed(rows, "/db"))
    m = "table:threads rowid:1 message:"
    assert {k.removeprefix(m): r.kind for k, r in found.items() if k.startswith(m)} == {
        "0": "user.prompt", "1": "config.snapshot", "2 content:0": "assistant.text", "2 content:1": "assistant.thinking", "2 content:2": "assistant.thinking", "2 content:3": "tool.call", "2 content:4": "unparsed.record",
        "2 result:c": "tool.result", "2 result:d": "tool.result", "3": "session.end", "4": "unparsed.record",
    }
    assert said[m + "0"] == {"text": "a\nb", "mentions": [{"uri": "f", "content": "c"}], "images": 1, "message_id": "u", "unknown_parts": 1} and said[m + "2 result:c"]["text"] == "out" and said[m + "2 result:d"]["text"] == "plain"
    one, two = found["table:threads rowid:1"], found["table:threads rowid:2"]
    assert said["table:threads rowid:1"]["models"] == [{"model": "p/m"}] and said["table:threads rowid:1"]["folder_paths"] == ["/b", "/a,1"] and one.project_path == "/b" and one.parse_problem is None and found[m + "0"].ts_utc is None
    assert two.project_path == "/x" and "no JSON object" in two.parse_problem and "last change" in two.parse_problem and two.ts_utc == "2024-01-02T00:00:00.000000Z" and said[m + "3"]["text"] == "short"
