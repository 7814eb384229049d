"""Normalizers of whole files: generic documents and logs, prose, instructions, memories, registry keys, file times."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from trailspark.functions.text import hidden_characters, normalise_ts
from trailspark.normalize.records import emit, event, finish, first_said, is_a, nothing, payload, said, when
from trailspark.schema import UNINTERPRETED

#: A longer list of a document stays whole.
SPLIT_LIMIT = 10_000
#: Where a machine's administrator puts files; the mark of a personal override; what is run, not read.
MANAGED = (
    "/etc/", "/library/application support/", "/library/managed preferences/", "/opt/", "/usr/", "c:/program files", "c:/programdata/", "c:/windows/", "/programdata/",
)
LOCAL_MARK = ".local."
EXECUTABLE = (".sh", ".bash", ".zsh", ".ps1", ".psm1", ".cmd", ".bat", ".py", ".js", ".ts")
#: Keys that hold a prompt in JSON, and keys by which a document grants itself tools.
PROMPT_KEYS = ("systemPrompt", "system_prompt", "instructions", "prompt", "customInstructions", "custom_instructions")
TOOL_KEYS = ("allowed-tools", "allowedTools", "allowed_tools", "tools", "permissions")
SCOPES = ("managed", "user", "project", "local", "unknown")


def generic_documents(documents: DataFrame, agent: str, artifact: str, configuration: bool = False, limit: int = SPLIT_LIMIT) -> DataFrame:
    """The floor for documents (path, place, v, text, problem): the root, and an event for each element of each of its lists of objects."""
    v, kind = F.col("v"), "config.snapshot" if configuration else "unparsed.record"
    fields = F.try_variant_get(v, "$", "map<string, variant>")
    lists = F.when(is_a(v, "ARRAY"), F.create_map(F.lit("$"), v)).otherwise(F.coalesce(fields, F.create_map().cast("map<string, variant>")))
    elements = lambda x: F.try_variant_get(x, "$", "array<variant>")
    objects = lambda x: is_a(x, "ARRAY") & F.coalesce((F.size(elements(x)) > 0) & (F.size(elements(x)) <= limit) & F.forall(elements(x), lambda e: is_a(e, "OBJECT")), F.lit(False))
    split = F.map_entries(F.map_filter(lists, lambda k, x: objects(x)))
    own = lambda e: payload(text=first_said(e, "text", "content", "message", "title", "name"))
    time = lambda e: first_said(e, "timestamp", "ts", "createdAt", "created_at", "time", "date")
    parts = F.flatten(F.transform(split, lambda kv: F.transform(elements(kv["value"]), lambda e, i: event(kind, own(e), F.concat(F.lit("#"), kv["key"], F.lit("["), i.cast("string"), F.lit("]")), "unknown", time(e)))))
    empty = F.col("text").isNotNull() & ((F.trim("text") == "") | F.coalesce(F.regexp_replace(F.to_json(v), r"\s", "").isin("{}", "[]"), F.lit(False)))
    root = event(kind, F.when(v.isNotNull(), own(v)).otherwise("{}"), "", "unknown", time(v))
    made = F.concat(F.array(root), F.coalesce(parts, nothing()))
    note = F.concat_ws("; ", "problem", F.when(empty, F.lit("the file was read and is empty")), F.lit(f"the document {UNINTERPRETED}"))
    return emit(documents.withColumn("problem", note), made, agent=agent, artifact=artifact, time=F.lit(None).cast("string"), kind=F.lit("document"), session_id=first_said(v, "sessionId", "session_id"), project_path=first_said(v, "cwd", "workspace"))


#: A time at the start of a line of a log.
_LEADING = r"^\W{0,2}(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)"


def text_log(lines: DataFrame, agent: str, artifact: str) -> DataFrame:
    """An event for each line (path, line_no, text) that isn't blank; only a time that the line begins with is taken."""
    stamp = F.nullif(F.translate(F.regexp_extract("text", _LEADING, 1), ",", "."), F.lit(""))
    return finish(
        lines.where(F.trim("text") != ""), kind=F.lit("unparsed.record"), agent=F.lit(agent), actor=F.lit("unknown"), time=stamp, ts_source=F.when(stamp.isNotNull(), "line"), artifact_id=F.lit(artifact), original_path=F.col("path"),
        locator=F.concat(F.lit("line:"), F.col("line_no")), payload_json=payload(text=F.col("text")), raw_json=F.col("text"), parse_problem=F.lit(f"a line of a log that {UNINTERPRETED}"),
    )


def prose(documents: DataFrame, agent: str, artifact: str, kind: str = "plan.write") -> DataFrame:
    """A file of prose as one event; a binary one stays unread."""
    made = when(F.col("text").isNotNull(), event(kind, payload(text=F.col("text")), "", "assistant"))
    return emit(documents.withColumn("place", F.lit("document")), made, agent=agent, artifact=artifact, time=F.lit(None).cast("string"), kind=F.lit("document"))


def _slashed(path: Column) -> Column:
    return F.lower(F.translate(path, "\\", "/"))


def scope_of(path: Column, roots: Column) -> Column:
    """Whose instruction a file is: managed, local, project, user, or unknown where no working copies (array) are known."""
    plain, known = _slashed(path), F.transform(roots, lambda r: F.rtrim(_slashed(r), F.lit("/")))
    inside = F.exists(known, lambda r: (r != "") & ((plain == r) | F.startswith(plain, F.concat(r, F.lit("/")))))
    managed = F.lit(False)
    for prefix in MANAGED:
        managed = managed | F.startswith(plain, F.lit(prefix))
    name = F.element_at(F.split(plain, "/"), -1)
    return F.when(managed, "managed").when(F.contains(name, F.lit(LOCAL_MARK)), "local").when(F.coalesce(inside, F.lit(False)), "project").when(F.coalesce(F.size(roots), F.lit(0)) <= 0, "unknown").otherwise("user")


def title_of(text: Column) -> Column:
    """The first heading in the first forty lines; null if there is none."""
    lines = F.transform(F.slice(F.split(text, r"\r\n|\n|\r"), 1, 40), lambda line: F.regexp_extract(F.trim(line), r"^#{1,6}\s+(\S.*)$", 1))
    return F.get(F.filter(lines, lambda t: t != ""), F.lit(0))


#: A block that a text opens with, up to its closing line; without one the whole rest is left over.
_BLOCK = re.compile(r"---[^\n]*\n(?P<yaml>.*?)(?:^(?:---|\.\.\.)[ \t]*$|(?P<open>\Z))", re.S | re.M)
#: The names of tools in a value, by the value's kind; others name themselves.
_NAMED = {str: lambda v: v.split(","), list: lambda v: v, tuple: lambda v: v, set: lambda v: v, dict: lambda v: v, type(None): lambda v: ()}


def _front(text: str) -> str | None:
    """The mapping that a text opens with and the tools that it names, or what is wrong with it, as JSON; null if it opens with none."""
    import yaml

    block = _BLOCK.match(text.replace("\r\n", "\n").replace("\r", "\n") + "\n") if text.startswith("---") else None
    if not block or block["open"] is not None:
        return json.dumps({"problem": "front matter that is never closed"}) if block else None
    try:
        mapping = yaml.safe_load(block["yaml"])
        problem = "front matter that is no mapping" if not isinstance(mapping, dict | None) else None
    except Exception as error:  # noqa: BLE001  of any parser; the text is kept
        mapping, problem = None, f"unreadable front matter: {type(error).__name__}"
    if problem or mapping is None:
        return problem and json.dumps({"problem": problem})
    values = [mapping.get(key) for key in TOOL_KEYS]
    names = {str(name).strip() for v in values for name in _NAMED.get(type(v), lambda x: (x,))(v)} - {""}
    return json.dumps({"front_matter": mapping, "tools": sorted(names)}, default=str, ensure_ascii=False)


@pandas_udf(StringType())
def front_matter(texts: pd.Series) -> pd.Series:
    """YAML front matter as JSON: {front_matter, tools} or {problem}. YAML has no built-in function."""
    return texts.map(_front, na_action="ignore")


def prompt_in(v: Column) -> Column:
    """The prompt that a JSON document holds under one of a few keys, at the top or one level down; null if it holds none."""

    def under(x: Column) -> Column:
        out = []
        for k in PROMPT_KEYS:
            value = F.try_variant_get(x, f"$['{k}']", "variant")
            listed = F.array_join(F.try_variant_get(value, "$", "array<string>"), "\n")
            text = F.when(is_a(value, "STRING"), F.try_variant_get(value, "$", "string")).when(is_a(value, "ARRAY"), listed)
            out.append(F.when(F.trim(text) != "", text))
        return F.coalesce(*out)

    inner = F.transform(F.filter(F.map_values(F.try_variant_get(v, "$", "map<string, variant>")), lambda x: is_a(x, "OBJECT")), under)
    return F.coalesce(under(v), F.get(F.array_compact(inner), F.lit(0)))


def instructions(documents: DataFrame, agent: str, artifact: str, roots: Column | None = None, kind: str = "instruction.source") -> DataFrame:
    """Files that an agent obeys (path, text, size, mtime, problem): text, scope, title, front matter, tools, hidden characters."""
    roots = F.array().cast("array<string>") if roots is None else roots
    name = F.element_at(F.split(_slashed(F.col("path")), "/"), -1)
    runs = F.rlike(name, F.lit("(" + "|".join(x.replace(".", r"\.") for x in EXECUTABLE) + ")$"))
    rows = documents.withColumn("_front", F.try_parse_json(front_matter(F.when(F.startswith("text", F.lit("---")), F.col("text")))))
    rows = rows.withColumns({"_prompt": prompt_in(F.when(F.endswith(name, F.lit(".json")), F.try_parse_json("text"))), "_scope": scope_of(F.col("path"), roots), "_hidden": hidden_characters(F.col("text"))})
    tools = F.try_variant_get("_front", "$.tools", "array<string>")
    about = F.struct(
        F.col("_scope").alias("scope"), F.when(~runs, title_of(F.col("text"))).alias("title"), runs.alias("executable"), F.when(F.size(tools) > 0, tools).alias("tools"),
        F.when(F.size("_hidden") > 0, F.col("_hidden")).alias("hidden_characters"), F.col("_prompt").isNotNull().alias("from_json"), F.octet_length("text").alias("bytes"),
    )
    shown = F.coalesce("_prompt", "text")
    body = payload(text=shown, front_matter=F.try_variant_get("_front", "$.front_matter", "variant"), instructions=F.array(about) if kind == "instruction.source" else F.lit(None).cast("array<string>"))
    made = when(F.col("text").isNotNull(), event(kind, body, "", "system" if kind == "instruction.source" else "assistant"))
    unknown = F.when(F.col("_scope") == "unknown", "no working copies are known, so the scope is unknown") if kind == "instruction.source" else F.lit(None).cast("string")
    note = F.nullif(F.concat_ws("; ", "problem", F.try_variant_get("_front", "$.problem", "string"), unknown), F.lit(""))
    return emit(rows.withColumns({"place": F.lit("document"), "problem": note}), made, agent=agent, artifact=artifact, time=F.lit(None).cast("string"), kind=F.lit("document"))


def memories(documents: DataFrame, agent: str, artifact: str) -> DataFrame:
    """Files of an agent's memory: as instructions, but written by the agent."""
    return instructions(documents, agent, artifact, kind="memory.write")


def file_times(files: DataFrame, agent: Column | str, artifact: Column | str | None = None) -> DataFrame:
    """An event for each collected file (path, mtime, size, sha256): the file system's time, marked as such."""
    as_column = lambda x: F.lit(x) if x is None or isinstance(x, str) else x
    shown = F.date_format(F.col("mtime").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return finish(
        files, kind=F.lit("artifact.fs"), agent=as_column(agent), actor=F.lit("system"), ts_utc=shown, ts_precision=F.when(shown.isNull(), "absent").otherwise("filesystem"), ts_source=F.when(shown.isNotNull(), "mtime"),
        artifact_id=as_column(artifact), original_path=F.col("path"), file_sha256=F.col("sha256"), locator=F.lit("file"), payload_json=payload(files=F.array(F.struct(F.col("path"), F.lit("exists").alias("operation"), F.col("size").alias("bytes")))),
    )


def registry(documents: DataFrame, agent: str, artifact: str) -> DataFrame:
    """Exported registry keys (path, v, text, problem): an event for each value with the key's time, or one for an empty key."""
    v = F.col("v")
    key = F.coalesce(said(v, "key"), F.col("path"))
    hive = F.nullif(F.regexp_extract(key, r"(?i)^(?:\\\\.\\)?(HK[A-Z]+|HKEY_[A-Z_]+)\\", 1), F.lit(""))
    values, subkeys = F.try_variant_get(v, "$.values", "array<variant>"), F.try_variant_get(v, "$.subkeys", "array<string>")
    common = {"key": key, "hive": hive, "subkeys": subkeys}
    one = lambda x, i: event(
        F.when(is_a(x, "OBJECT"), "config.snapshot").otherwise("unparsed.record"),
        payload(**common, name=said(x, "name"), type=said(x, "type"), value=F.try_variant_get(x, "$.data", "variant"), text=F.concat(key, F.lit("\\"), F.coalesce(said(x, "name"), F.lit("")), F.lit(" = "), F.coalesce(said(x, "data"), F.lit("")))),
        F.concat(F.lit(":value:"), i.cast("string")), "system",
    )
    made = F.when(said(v, "key").isNull(), nothing()).when(F.size(values) > 0, F.transform(values, one)).otherwise(F.array(event("config.snapshot", payload(**common, text=key), ":key", "system")))
    return emit(documents, made, agent=agent, artifact=artifact, time=said(v, "last_write_utc"), kind=F.lit("registry document"))


def prompt_toolkit(lines: DataFrame, agent: str = "aider") -> DataFrame:
    """A history of stamps (`# time`) and entries of lines that begin with a plus sign; other lines stay unread."""
    order = W.partitionBy("path").orderBy("line_no")
    entry = F.startswith("text", F.lit("+"))
    stamp = F.when(F.startswith("text", F.lit("#")), F.trim(F.substring("text", 2, 1 << 20)))
    rows = lines.withColumns({"_entry": entry, "_stamp": stamp})
    rows = rows.withColumn("_new", (~(F.col("_entry") & F.coalesce(F.lag("_entry").over(order), F.lit(False)))).cast("int"))
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({"_run": F.sum("_new").over(so_far), "_last": F.lag("_stamp").over(order)})
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: F.substring(x["text"], 2, 1 << 20)), "\n")
    whole = rows.where("_entry").groupBy("path", "_run").agg(F.min("line_no").alias("line_no"), joined.alias("prompt"), F.min_by("_last", "line_no").alias("time"))
    entries = finish(whole, kind=F.lit("prompt.history"), agent=F.lit(agent), actor=F.lit("user"), artifact_id=F.lit(f"{agent}.input_history"), original_path=F.col("path"), locator=F.concat(F.lit("line:"), F.col("line_no")), payload_json=payload(text=F.col("prompt")), raw_json=F.col("prompt"))
    stray = rows.where(~F.col("_entry") & F.col("_stamp").isNull() & (F.trim("text") != ""))
    unread = finish(stray, kind=F.lit("unparsed.record"), agent=F.lit(agent), actor=F.lit("unknown"), artifact_id=F.lit(f"{agent}.input_history"), original_path=F.col("path"), locator=F.concat(F.lit("line:"), F.col("line_no")), payload_json=payload(text=F.col("text")), raw_json=F.col("text"), parse_problem=F.lit("neither a time nor an entry"))
    return entries.unionByName(unread)


def rustyline(lines: DataFrame, agent: str) -> DataFrame:
    """A history whose first line may be #V2: then \\n and two backslashes are escapes; a line with others stays as it is, and says so."""
    first = F.first("text").over(W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = lines.withColumn("_v2", first == "#V2").where(~(F.col("_v2") & (F.col("line_no") == 1)) & (F.col("text") != ""))
    good = F.rlike("text", F.lit(r"^(?:[^\\]|\\n|\\\\)*$"))
    mark = "\ue000"
    plain = F.replace(F.replace(F.replace("text", F.lit("\\\\"), F.lit(mark)), F.lit("\\n"), F.lit("\n")), F.lit(mark), F.lit("\\"))
    text = F.when(F.col("_v2") & good, plain).otherwise(F.col("text"))
    return finish(
        rows, kind=F.lit("prompt.history"), agent=F.lit(agent), actor=F.lit("user"), artifact_id=F.lit(f"{agent}.history"), original_path=F.col("path"), locator=F.concat(F.lit("line:"), F.col("line_no")), payload_json=payload(text=text),
        raw_json=F.col("text"), parse_problem=F.when(F.col("_v2") & ~good, "a backslash that the format doesn't write, kept as it is"),
    )


def index_times(files: DataFrame) -> DataFrame:
    """files with their times normalised: (ts_utc, ts_precision, note) of `time`."""
    return files.withColumn("_t", normalise_ts(F.col("time"))).select("*", "_t.*").drop("_t")
