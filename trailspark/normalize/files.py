"""Normalizers of files that agents and editors leave beside their transcripts: pattern lists, settings, shell scripts, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions.text import remote_uri, uri_as_path
from trailspark.normalize.records import emit, event, finish, payload, said, when
from trailspark.schema import UNINTERPRETED
from trailspark.sources.documents import json_documents
from trailspark.sources.positions import running_sum, texts_of_runs

#: Lists of patterns, by the artifact and by the file's name, and what a line of them is.
LIST_ARTIFACTS = {"claude_code.git_global_excludes": "exclude", "claude_code.worktreeinclude": "include", "windsurf.ignore_files": "ignore"}
LIST_NAMES = {".aiderignore": "ignore", ".codeiumignore": "ignore", ".continueignore": "ignore", ".devinignore": "ignore", ".windsurfignore": "ignore", "embeddable_files.txt": "indexed"}
#: Fixed value: files whose name is that of a profile which was deleted.
TOMBSTONES = ("hermes.profile_tombstones",)
MEANING = {
    "ignore": "a pattern of files that the agent was kept from",
    "include": "a file that is copied into each working copy the agent makes",
    "exclude": "a pattern of files that the version control leaves out",
    "indexed": "a path that was listed for indexing, whether or not it was sent",
}


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\][^/\\]*$", "")


def list_kind(path: Column, artifact: Column) -> Column:
    """What the lines of a file are, if it is a list of patterns: its artifact says so, or its name; null otherwise."""
    known = lambda names, of: F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), of)
    return F.coalesce(known(LIST_ARTIFACTS, artifact), known(LIST_NAMES, F.lower(name_of(path))))


def pattern_lists(lines: DataFrame, agent: str, artifact: str) -> DataFrame:
    """An event for each line (path, line_no, text) of pattern lists that isn't blank, comments too. Lists of any length are read whole."""
    kind, line = F.col("_kind"), F.trim("text")
    comment = F.startswith(line, F.lit("#"))
    meaning = F.element_at(F.create_map(*[F.lit(x) for kv in MEANING.items() for x in kv]), kind)
    rows = lines.withColumn("_kind", list_kind(F.col("path"), F.lit(artifact))).where((line != "") & F.col("_kind").isNotNull())
    return finish(
        rows, kind=F.lit("config.snapshot"), agent=F.lit(agent), actor=F.lit("user"), artifact_id=F.lit(artifact), original_path=F.col("path"), locator=F.concat(F.lit("line:"), F.col("line_no")),
        payload_json=payload(key=F.concat(kind, F.lit(":"), line), text=line), raw_json=F.to_json(F.struct(F.when(~comment, line).alias("pattern"), F.when(comment, line).alias("comment"))),
        parse_problem=F.when(comment, "a comment in the list, kept because somebody wrote it").otherwise(meaning),
    )


def settings_files(documents: DataFrame, agent: str, artifact: str) -> DataFrame:
    """Files (path, size, sha256, text, binary, problem) of settings as they stand, each an event; the name of a tombstone is that of a deleted profile."""
    name, gone = name_of(F.col("path")), artifact in TOMBSTONES
    rows = documents.where(list_kind(F.col("path"), F.lit(artifact)).isNull())
    key = F.concat(F.lit("deleted-profile:" if gone else "file:"), name)
    made = when(F.col("text").isNotNull(), event("config.snapshot", payload(key=key, text=F.col("text")), "", "system"))
    note = F.concat_ws("; ", "problem", F.when(F.col("text").isNotNull(), F.lit("a mark that a profile was deleted or renamed; its own files are gone" if gone else f"a file of settings that {UNINTERPRETED}")))
    raw = F.to_json(F.struct(name.alias("file"), "size", "sha256", F.col("text").alias("content")))
    return emit(rows.withColumns({"problem": note, "place": F.lit("file")}), made, agent=agent, artifact=artifact, time=F.lit(None).cast("string"), kind=F.lit("file"), raw=raw)


#: Declarations of shells, one a line: the pattern, with a name and a value, and what it declares.
_NAME = r"([A-Za-z_][A-Za-z0-9_]*)"
_DECLARED = (
    (rf"^\s*export\s+{_NAME}(?:=(.*))?$", "export"),
    (rf"^\s*set\s+(?:-[A-Za-z]*x[A-Za-z]*|--export)\s+{_NAME}(?:\s+(.*))?$", "export"),
    (r"^\s*alias\s+([^\s=]+)=(.*)$", "alias"),
)
_OPENS, _CLOSES = r"^(?:function\s+)?([A-Za-z_][A-Za-z0-9_:.-]*)\s*\(\s*\)\s*\{\s*$", r"^\}\s*$"


def _unquoted(value: Column) -> Column:
    """A value without one pair of quotes around it, and not expanded."""
    bare = F.trim(value)
    return F.when(F.rlike(bare, F.lit(r"(?s)^'.*'$|^\".*\"$")) & (F.char_length(bare) > 1), F.substr(bare, F.lit(2), F.char_length(bare) - 2)).otherwise(bare)


def shell_scripts(lines: DataFrame, agent: str, artifact: str) -> DataFrame:
    """Exports, aliases and functions of shell scripts (path, line_no, text); all other lines that aren't blank stay unread.

    A function goes from the line that opens it to the next closing brace on a line of its own, or to the file's end, which
    is said. What lies between two such braces is a stretch, and the first opening line in it begins the function.
    """
    opens, closes = F.rlike("text", F.lit(_OPENS)), F.rlike("text", F.lit(_CLOSES))
    rows = running_sum(lines.withColumn("_closes", closes), F.col("_closes").cast("int"), "_braces")
    rows = rows.withColumn("_stretch", F.col("_braces") - F.col("_closes").cast("int"))
    begins = rows.where(opens).groupBy("path", "_stretch").agg(F.min("line_no").alias("_begin"))
    rows = rows.join(begins, ["path", "_stretch"], "left")
    inside = F.coalesce(F.col("line_no") >= F.col("_begin"), F.lit(False))
    bodies = texts_of_runs(rows.where(inside), ["path", "_stretch"], closed=F.max("_closes")).withColumnRenamed("first_line", "line_no")
    name = F.regexp_extract(F.substring_index("text", "\n", 1), _OPENS, 1)
    common = {"agent": F.lit(agent), "actor": F.lit("system"), "artifact_id": F.lit(artifact), "original_path": F.col("path"), "locator": F.concat(F.lit("line:"), F.col("line_no"))}
    record = lambda kind, named, value: F.to_json(F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), named.alias("name"), value.alias("value")))
    functions = finish(
        bodies, **common, kind=F.lit("config.snapshot"), payload_json=payload(key=F.concat(F.lit("function:"), name), text=F.col("text")), raw_json=record("function", name, F.col("text")),
        parse_problem=F.when(~F.col("closed"), "a function that the file doesn't close"),
    )
    kind, named, value = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, what in reversed(_DECLARED):
        hit = F.rlike("text", F.lit(pattern))
        # an export without a value is another record than one of an empty string
        with_value = F.rlike("text", F.lit(pattern.replace(")?$", ")$")))
        kind, named = F.when(hit, what).otherwise(kind), F.when(hit, F.regexp_extract("text", pattern, 1)).otherwise(named)
        value = F.when(hit, F.when(with_value, _unquoted(F.regexp_extract("text", pattern, 2)))).otherwise(value)
    single = rows.where(~inside & (F.trim("text") != "")).withColumns({"_kind": kind, "_name": named, "_value": value})
    text = F.concat("_kind", F.lit(" "), "_name", F.coalesce(F.concat(F.lit("="), "_value"), F.lit("")))
    told = F.col("_kind").isNotNull()
    declared = finish(
        single, **common, kind=F.when(told, "config.snapshot").otherwise("unparsed.record"), payload_json=F.when(told, payload(key=F.concat("_kind", F.lit(":"), "_name"), text=text)).otherwise(payload(text=F.col("text"))),
        raw_json=F.when(told, record(F.col("_kind"), F.col("_name"), F.col("_value"))).otherwise(F.col("text")), parse_problem=F.when(~told, F.lit(f"a line of a script that {UNINTERPRETED}")),
    )
    return functions.unionByName(declared)


#: The index of an editor's local history, and names of copies by digest and version.
INDEX_NAME = "entries.json"
_DIGEST_NAME = r"^([0-9a-f]{16})@v(\d+)$"


def file_snapshots(documents: DataFrame, agent: str, artifact: str) -> DataFrame:
    """Copies of files (path, size, sha256, text, binary, problem) that an agent took before it changed them. No time is claimed for them."""
    name = name_of(F.col("path"))
    session = F.nullif(F.regexp_extract("path", r"[/\\]file-history[/\\]([^/\\]+)[/\\]", 1), F.lit(""))
    prefix, version = F.nullif(F.regexp_extract(name, _DIGEST_NAME, 1), F.lit("")), F.regexp_extract(name, _DIGEST_NAME, 2).try_cast("int")
    made = F.array(event("file.snapshot", payload(text=F.col("text"), file=name, bytes=F.col("size")), "", "assistant"))
    note = F.concat_ws("; ", "problem", F.lit("a copy whose own path isn't recorded with it"))
    raw = F.to_json(F.struct(name.alias("file"), F.col("size").alias("bytes"), "sha256", prefix.alias("original_path_sha256_prefix"), version.alias("version"), F.col("text").alias("content")))
    rows = documents.withColumns({"problem": note, "place": F.lit("file")})
    return emit(rows, made, agent=agent, artifact=artifact, time=F.lit(None).cast("string"), kind=F.lit("file"), raw=raw, session_id=session)


def local_history(documents: DataFrame, agent: str, artifact: str) -> DataFrame:
    """An editor's local history: copies with the path, time and source that the index in their folder gives them by their name.

    A copy says what it lacks: an index, one that can be read, or a row in it; an index says so where it can't be read, names
    no file or one on another machine, and which of its copies aren't there. Copies and rows meet by folder and name.
    """
    is_index = name_of(F.col("path")) == INDEX_NAME
    indexes = json_documents(documents.where(is_index).select("path", "text", "problem")).withColumn("_folder", folder_of(F.col("path")))
    v = F.col("v")
    broken = F.coalesce(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(True))
    resource = said(v, "resource")
    known = indexes.withColumns({"_broken": broken, "_file": uri_as_path(resource), "_remote": F.coalesce(remote_uri(resource), F.lit(False)), "_rows": F.filter(F.try_variant_get(v, "$.entries", "array<variant>"), lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))})
    about = F.concat_ws("; ", F.when(F.col("_file").isNull(), "the index names no file"), F.when(F.col("_remote"), "the file is on another machine"))
    listed = known.where(~F.col("_broken")).select("_folder", "_file", about.alias("_about"), F.posexplode("_rows").alias("_at", "x"))
    listed = listed.select("_folder", said(F.col("x"), "id").alias("_name"), "_at", "_file", "_about", *[said(F.col("x"), k).alias(f"_{k}") for k in ("timestamp", "source", "sourceDescription")])
    # of several rows with one id the first counts
    rows = listed.where("_name is not null").groupBy("_folder", "_name").agg(F.min_by(F.struct("_file", "_about", "_timestamp", "_source", "_sourceDescription"), "_at").alias("_row"))
    copies = documents.where(~is_index).withColumns({"_folder": folder_of(F.col("path")), "_name": name_of(F.col("path"))})
    state = known.groupBy("_folder").agg(F.max(F.struct(~F.col("_broken"))).alias("_state"))
    met = copies.join(rows, ["_folder", "_name"], "left").join(state, "_folder", "left")
    lacks = F.when(F.col("_state").isNull(), "no index lies beside this copy").when(~F.col("_state")["col1"], "the index beside this copy can't be read").when(F.col("_row").isNull(), "the index beside this copy doesn't list it")
    note = F.nullif(F.concat_ws("; ", "problem", lacks, F.nullif(F.col("_row._about"), F.lit(""))), F.lit(""))
    name = F.col("_name")
    made = F.array(event("file.snapshot", payload(text=F.col("text"), file=name, bytes=F.col("size"), original_path=F.col("_row._file")), "", "assistant", F.col("_row._timestamp")))
    raw = F.to_json(F.struct(name.alias("file"), F.col("size").alias("bytes"), "sha256", F.col("_row._file").alias("original_path"), F.col("_row._source").alias("version_source"), F.col("_row._sourceDescription").alias("version_source_description"), F.col("text").alias("content")))
    told = emit(met.withColumns({"problem": note, "place": F.lit("file")}), made, agent=agent, artifact=artifact, time=F.lit(None).cast("string"), kind=F.lit("file"), raw=raw)
    # what an index lists and no file is
    gone = listed.join(copies.select("_folder", "_name"), ["_folder", "_name"], "left_anti").groupBy("_folder").agg(F.array_sort(F.collect_set("_name")).alias("_gone"))
    shown = known.join(gone, "_folder", "left")
    missing = F.when(F.size("_gone") > 0, F.concat(F.lit("copies that it lists and that aren't there: "), F.array_join("_gone", ", ")))
    said_all = F.concat_ws("; ", "problem", F.when(F.col("_broken"), "the index can't be read").otherwise(F.nullif(about, F.lit(""))), missing)
    versions = F.transform("_rows", lambda x: F.struct(*[said(x, k).alias(k) for k in ("id", "timestamp", "source", "sourceDescription")]))
    index = when(~F.col("_broken"), event("file.snapshot", payload(file=F.lit(INDEX_NAME), original_path=F.col("_file"), versions=versions), "", "assistant"))
    return told.unionByName(emit(shown.withColumns({"problem": F.nullif(said_all, F.lit("")), "place": F.lit("$")}), index, agent=agent, artifact=artifact, time=F.lit(None).cast("string"), kind=F.lit("index")))
