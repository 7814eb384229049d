"""Raw agent records to unified events. Unknown records keep their text, time and session as unparsed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions.text import fish_unescape, text_of as _text_of
from trailspark.normalize import chats, documents
from trailspark.normalize.chats import claude
from trailspark.normalize.records import finish, payload as _payload
from trailspark.schema import UNINTERPRETED
from trailspark.sources import line_runs
from trailspark.sources.positions import carry_forward, previous, runs, texts_of_runs


def _said(path: str, column: str = "value") -> Column:
    return F.get_json_object(column, f"$.{path}")


def codex(lines: DataFrame) -> DataFrame:
    """Rollout lines: session facts and the model are carried forward in a file; mirrors of turns become config snapshots; shell
    calls are tool calls and commands.
    """
    kind, item = _said("type"), _said("payload.type")
    header = kind.isin("session_meta", "turn_context")
    facts = {
        "session_id": F.when(kind == "session_meta", _said("payload.id")), "project_path": F.when(header, _said("payload.cwd")), "git_branch": F.when(header, _said("payload.git.branch")),
        "_model": F.when(header, F.coalesce(_said("payload.model"), F.when(kind == "session_meta", _said("payload.model_provider")))),
    }
    rows = carry_forward(lines, facts).withColumn("_v", F.try_parse_json("value"))
    role, call = _said("payload.role"), item.isin("function_call", "custom_tool_call", "local_shell_call")
    made = (
        F.when(kind == "session_meta", "session.start").when(kind == "turn_context", "config.snapshot").when(kind == "event_msg", "config.snapshot").when(kind == "compacted", "session.end")
        .when((kind == "response_item") & (item == "message") & (role == "user"), "user.prompt").when((kind == "response_item") & (item == "message"), "assistant.text")
        .when((kind == "response_item") & (item == "reasoning"), "assistant.thinking").when((kind == "response_item") & call, "tool.call")
        .when((kind == "response_item") & item.isin("function_call_output", "custom_tool_call_output"), "tool.result").otherwise("unparsed.record")
    )
    at = lambda path, v="_v": F.try_variant_get(v, f"$.{path}", "variant")
    of = lambda path: F.coalesce(F.nullif(_text_of(at(f"payload.{path}")), F.lit("")), _said(f"payload.{path}"))
    text = F.when(item == "reasoning", F.coalesce(F.nullif(_text_of(at("payload.summary")), F.lit("")), of("content"))).when(made == "tool.result", of("output")).otherwise(of("content"))
    stated = at("payload.arguments")
    arguments = F.when(item == "function_call", F.when(F.startswith(F.schema_of_variant(stated), F.lit("OBJECT")), stated).otherwise(F.try_parse_json(_said("payload.arguments")))).when(item == "custom_tool_call", at("payload.input")).when(item == "local_shell_call", at("payload.action"))
    inside = lambda k: at(k, arguments)
    asked = F.coalesce(inside("command"), F.when(item == "local_shell_call", at("payload.command")))
    words = F.array_join(F.try_variant_get(asked, "$", "array<string>"), " ")
    command = F.when(made == "tool.call", F.nullif(F.when(F.startswith(F.schema_of_variant(asked), F.lit("ARRAY")), words).otherwise(F.try_variant_get(asked, "$", "string")), F.lit("")))
    folder = F.coalesce(*[F.try_variant_get(arguments, f"$.{k}", "string") for k in ("workdir", "cwd", "working_directory")], F.col("project_path"))
    tool, call_id = F.when(call, F.coalesce(_said("payload.name"), item)).otherwise(_said("payload.name")), F.coalesce(_said("payload.call_id"), F.when(call, _said("payload.id")))
    models = F.when(F.col("_model").isNotNull() & ~made.isin("tool.result", "session.end", "unparsed.record"), F.array(F.struct(F.col("_model").alias("model"))))
    failed = F.when(made == "tool.result", F.coalesce(_said("payload.output.success") == "false", F.lit(False)))
    given = F.coalesce(_said("payload.arguments"), F.when(item == "custom_tool_call", _said("payload.input")), F.when(item == "local_shell_call", F.coalesce(_said("payload.action"), F.to_json(F.struct(_said("payload.command").alias("command"))))))
    payload = _payload(text=text, tool=tool, tool_use_id=call_id, input=given, output=_said("payload.output"), is_error=failed, models=models)
    run = _payload(tool=tool, tool_use_id=call_id, commands=F.array(F.struct(command.alias("command"), folder.alias("cwd"))))
    event = lambda k, body, suffix: F.struct(k.alias("kind"), body.alias("payload_json"), F.lit(suffix).alias("suffix"))
    effect = F.when(command.isNotNull(), event(F.lit("command.exec"), run, "#exec"))
    rows = rows.withColumn("e", F.explode(F.array_compact(F.array(event(made, payload, ""), effect))))
    made = F.col("e.kind")
    unknown = F.when(made == "unparsed.record", F.coalesce(F.col("problem"), F.concat(F.lit("a record of type "), F.coalesce(kind, F.lit("(none)")), F.lit(f" {UNINTERPRETED}"))))
    return finish(
        rows, kind=made, agent=F.lit("codex"), actor=F.when(made == "user.prompt", "user").when(made == "tool.result", "tool").when(made.isin("session.start", "session.end", "config.snapshot"), "system").otherwise("assistant"), time=_said("timestamp"), artifact_id=F.lit("codex.rollout"), original_path=F.col("path"),
        locator=F.concat(F.lit("line:"), F.col("line_no"), F.col("e.suffix")), payload_json=F.col("e.payload_json"), raw_json=F.col("text"), parse_problem=unknown,
    )


def prompt_history(lines: DataFrame, agent: str, text: tuple[str, ...] = ("display", "text"), time: tuple[str, ...] = ("timestamp", "ts"), session: tuple[str, ...] = ("sessionId", "session_id")) -> DataFrame:
    """Histories of prompts, one object a line."""
    first = lambda names: F.coalesce(*[_said(n) for n in names])
    bad = F.col("value").isNull()
    return finish(
        lines, kind=F.when(bad, "unparsed.record").otherwise("prompt.history"), agent=F.lit(agent), actor=F.lit("user"), time=first(time), session_id=first(session), project_path=_said("project"), original_path=F.col("path"),
        artifact_id=F.lit(f"{agent}.history"), locator=F.concat(F.lit("line:"), F.col("line_no")), payload_json=_payload(text=first(text)), raw_json=F.col("text"), parse_problem=F.col("problem"),
    )


def generic_jsonl(lines: DataFrame, agent: str) -> DataFrame:
    """The floor for formats that nobody has mapped: literal fields only, all marked as uninterpreted."""
    first = lambda *names: F.coalesce(*[F.nullif(_said(n), F.lit("")) for n in names])
    return finish(
        lines, kind=F.lit("unparsed.record"), agent=F.lit(agent), actor=F.lit("unknown"), time=first("timestamp", "ts", "createdAt", "time"), session_id=first("sessionId", "session_id"), project_path=first("cwd", "workspace"),
        original_path=F.col("path"), locator=F.concat(F.lit("line:"), F.col("line_no")), payload_json=_payload(text=first("text", "content")), raw_json=F.col("text"),
        parse_problem=F.coalesce(F.col("problem"), F.lit(f"the record {UNINTERPRETED}")),
    )


def aider(lines: DataFrame) -> DataFrame:
    """A Markdown log (path, line_no, text): banners, prompts, quoted lines and answers are runs of lines."""
    kind = F.when(F.rlike("text", F.lit("^# aider chat started at ")), "session.start").when(F.startswith("text", F.lit("#### ")), "user.prompt").when(F.startswith("text", F.lit("> ")), "unparsed.record").otherwise("assistant.text")
    runs = line_runs(lines, kind).where(F.trim("text") != "")
    bare = F.when(F.col("kind") == "user.prompt", F.regexp_replace("text", r"(?m)^#### ?", "")).otherwise(F.col("text"))
    return finish(
        runs, agent=F.lit("aider"), actor=F.when(F.col("kind") == "user.prompt", "user").otherwise("assistant"), time=F.when(F.col("kind") == "session.start", F.regexp_extract("text", r"started at (.*)$", 1)), artifact_id=F.lit("aider.history"),
        original_path=F.col("path"), locator=F.concat(F.lit("line:"), F.col("first_line")), payload_json=_payload(text=bare), raw_json=F.col("text"), parse_problem=F.when(F.col("kind") == "unparsed.record", F.lit(f"a quoted line {UNINTERPRETED}")),
    )


def _joined(lines: DataFrame, goes_on: Column, between: str) -> DataFrame:
    """Lines with those that go on put together (path, line_no, text)."""
    rows = previous(lines, goes_on, "_goes_on")
    rows = runs(rows.withColumn("_new", ~F.coalesce("_goes_on", F.lit(False))), opens=F.col("_new"))
    return texts_of_runs(rows, ["path", "run"], between).withColumnRenamed("first_line", "line_no")


def _fish(lines: DataFrame) -> DataFrame:
    """Records of a fish history: a command, its time and the paths it names; what precedes the first one is unread."""
    opens = F.startswith("text", F.lit("- cmd:"))
    rows = runs(lines, opens=opens)
    field = lambda name: F.nullif(F.regexp_extract("text", rf"^\s+{name}:\s*(\S+)", 1), F.lit(""))
    named = F.when(F.rlike("text", F.lit(r"^\s+- ")), F.regexp_replace("text", r"^\s+- ", ""))
    whole = rows.groupBy("path", "run").agg(
        F.min("line_no").alias("line_no"), F.max(F.when(opens, F.trim(F.substring("text", 7, 1 << 20)))).alias("_cmd"), F.max(field("when")).alias("time"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.transform(F.array_sort(F.collect_list(F.when(named.isNotNull(), F.struct("line_no", named.alias("p"))))), lambda x: fish_unescape(x["p"])).alias("paths"),
    )
    return whole.withColumn("command", fish_unescape(F.col("_cmd")))


def shell_history(lines: DataFrame, shell: str) -> DataFrame:
    """Commands of bash (times in lines of their own), zsh (extended, with continued lines), fish, PowerShell (a backtick goes on),
    an agent's own recall file (an odd number of backslashes goes on) and plain histories.
    """
    none = F.lit(None).cast("string")
    if shell == "bash":
        stamp = F.nullif(F.regexp_extract("text", r"^#(\d{9,})$", 1), F.lit(""))
        rows = previous(lines.withColumn("_stamp", stamp), F.col("_stamp"), "time").where(F.col("_stamp").isNull()).withColumn("command", F.col("text"))
    elif shell == "zsh":
        whole = _joined(lines, F.endswith("text", F.lit("\\")), "\n")
        rows = whole.withColumns({"time": F.nullif(F.regexp_extract("text", r"^: (\d+):\d+;", 1), F.lit("")), "command": F.regexp_replace(F.regexp_replace("text", r"^: \d+:\d+;", ""), r"\\\n", "\n")})
    elif shell == "fish":
        rows = _fish(lines)
    elif shell == "powershell":
        rows = _joined(lines, F.endswith("text", F.lit("`")), "\n").withColumns({"time": none, "command": F.regexp_replace("text", r"`\n", "\n")})
    elif shell == "recall":
        odd = F.char_length(F.regexp_extract("text", r"(\\*)$", 1)) % 2 == 1
        rows = _joined(lines.where(F.trim("text") != ""), odd, "\n").withColumns({"time": none, "command": F.regexp_replace("text", r"\\\n", " ")})
    else:
        rows = lines.withColumns({"time": none, "command": F.col("text")})
    unread = F.col("command").isNull()
    return finish(
        rows.where(F.coalesce(F.trim("command") != "", F.trim("text") != "")), kind=F.when(unread, "unparsed.record").otherwise("command.exec"), agent=F.lit("shell"), actor=F.lit("user"), artifact_id=F.lit(f"shell.{shell}"),
        original_path=F.col("path"), locator=F.concat(F.lit("line:"), F.col("line_no")), payload_json=F.when(unread, F.lit("{}")).otherwise(_payload(commands=F.array(F.struct("command")))), raw_json=F.col("text"),
        parse_problem=F.when(unread, "no record begins here"),
    )


#: Normalizers of JSON lines, by the artifact that they read.
REGISTRY = {
    "claude_code.transcript": claude, "codex.rollout": codex, "copilot.events": chats.copilot, "gemini_cli.chats": chats.gemini, "qwen_code.transcripts": chats.qwen, "pi.sessions": chats.pi, "cline_cli.hooks": chats.hook_log,
}
#: Of arrays and documents of JSON, as sources.documents gives them.
ENTRIES = {"gemini_cli.prompts": chats.prompt_log, "cline.api_history": chats.cline_history, "cline.ui_messages": chats.cline_ui}
DOCUMENTS = {"cline.documents": chats.cline_documents, "continue.sessions": chats.continue_sessions}
__all__ = ["DOCUMENTS", "ENTRIES", "REGISTRY", "aider", "chats", "claude", "codex", "documents", "finish", "generic_jsonl", "prompt_history", "shell_history"]
