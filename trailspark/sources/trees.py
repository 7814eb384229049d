"""Collected trees and catalogues: where a file was on its endpoint, and which paths belong to which artifact."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions.text import decode_segments, literal_length, user_from_path
from trailspark.sources.documents import read_documents

#: Folders that collectors put a tree in.
CONTAINERS = ("uploads/auto", "uploads/ntfs", "uploads/file", "files", "collection", "root")
#: Variables of Windows and where they lie below a user's or the machine's folders.
VARIABLES = {
    "%USERPROFILE%": "~", "%APPDATA%": "~/AppData/Roaming", "%LOCALAPPDATA%": "~/AppData/Local", "%PROGRAMDATA%": "C:/ProgramData", "%PROGRAMFILES%": "C:/Program Files", "$HOME": "~", "$XDG_CONFIG_HOME": "~/.config", "$XDG_DATA_HOME": "~/.local/share",
}
HOMES = ("/home/*", "/Users/*", "/root", "?:/Users/*", "?:/Documents and Settings/*")


def endpoint_path(path: Column, root: str) -> Column:
    """Where a file of a tree under root was: without root and the collector's folders, decoded, with its drive."""
    plain = F.regexp_replace(F.translate(path, "\\", "/"), "^file:/*", "/")
    below = F.regexp_replace(F.replace(plain, F.lit(root.rstrip("/")), F.lit("")), "^/+", "")
    inside = F.regexp_replace(below, f"(?i)^({'|'.join(CONTAINERS)})/", "")
    decoded = decode_segments(inside)
    device = F.regexp_replace(decoded, r"^(\\\\|//)?[.?]/", "")
    drive = F.regexp_replace(device, "^([A-Za-z])(:)?/", "$1:/")
    return F.when(F.rlike(device, F.lit("^[A-Za-z]:?/")), drive).otherwise(F.concat(F.lit("/"), F.regexp_replace(device, "^/+", "")))


def tree_roots(spark: SparkSession, root: str) -> tuple[list[str], list[tuple[str, int, int]]]:
    """root and all folders below it whose names begin with a dot or an underscore; and (path, size, milliseconds) of such files.

    Spark's file sources leave both out when they meet them in a folder. Folders they read when they are asked for by name,
    files they don't. Names only go through the driver.
    """
    out, unread, todo = [root], [], [spark._jvm.org.apache.hadoop.fs.Path(root)]
    files = todo[0].getFileSystem(spark._jsc.hadoopConfiguration())
    while todo:
        for status in files.listStatus(todo.pop()):
            path = status.getPath()
            hidden = path.getName()[:1] in "._"
            if status.isDirectory():
                todo.append(path)
                if hidden:
                    out.append(path.toString())
            elif hidden:
                unread.append((path.toString(), status.getLen(), status.getModificationTime()))
    return out, unread


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, original_path, user, size, sha256, mtime, text, binary, problem) of every file below root; one that Spark can't read says so."""
    roots, unread = tree_roots(spark, root)
    found = read_documents(spark, roots, recursive=True)
    if unread:
        rows = spark.createDataFrame(unread, "path string, size long, at long")
        known = {"mtime": F.timestamp_millis("at"), "problem": F.lit("a file whose name hides it from Spark's sources")}
        found = found.unionByName(rows.withColumns(known).drop("at"), allowMissingColumns=True)
    original = endpoint_path(F.col("path"), root.removeprefix("file:"))
    return found.withColumn("original_path", original).withColumn("user", user_from_path(F.col("original_path")))


def expand(pattern: str, products: tuple[str, ...] = ("Code", "Code - Insiders", "Cursor", "Windsurf", "VSCodium")) -> list[str]:
    """The globs of a catalogue's pattern: variables and ~ as homes of any user, <vscode-user> as each product's folder, other <names> as one segment."""
    text = pattern.replace("\\", "/")
    for name, stands_for in VARIABLES.items():
        text = text.replace(name, stands_for)
    out = [text]
    if "<vscode-user>" in text:
        folders = ["~/.config/{}/User", "~/Library/Application Support/{}/User", "~/AppData/Roaming/{}/User"]
        out = [text.replace("<vscode-user>", f.format(p)) for p in products for f in folders]
    out = [h + t[1:] if t.startswith("~") else t for t in out for h in (HOMES if t.startswith("~") else ("",))]
    globs = {re.sub(r"<[^>/]+>", "*", g) for t in out for g in _anchored(t)}
    return sorted(g for g in globs if literal_length(g) >= LEAST)


#: Letters that a glob has at least; named segments and letters of one whose root is a variable that nothing here knows.
LEAST, NAMED_SEGMENTS, NAMED_LETTERS = 4, 2, 8


def _anchored(pattern: str) -> list[str]:
    """A pattern with its root: itself, or what stands below a working copy or an unknown variable, anywhere, if it names enough.

    Below a placeholder a single segment has to begin with a letter of its own, or `<project>/*.json` would claim every file
    of its kind; below a variable two segments are asked for.
    """
    root, _, tail = pattern.partition("/")
    if root[:1] not in ("<", "$"):
        return [pattern]
    named = [x for x in tail.split("/") if x not in ("", "**")]
    letters = sum(len(re.sub(r"<[^>]*>|[*?]", "", x)) for x in named)
    if root[0] == "$":
        enough = len(named) >= NAMED_SEGMENTS and letters >= NAMED_LETTERS
    else:
        enough = letters > 0 and (len(named) > 1 or not named[0].startswith("*"))
    return [f"**/{tail}"] if enough else []


def load_catalogue(folder: str | Path) -> list[dict]:
    """Artifacts of a catalogue's YAML or JSON files, by id: artifact_id, agent, category, systems, priority, patterns."""
    out = []
    for file in sorted(Path(folder).rglob("*")):
        if file.suffix not in (".yaml", ".yml", ".json"):
            continue
        text = file.read_text(encoding="utf-8")
        if file.suffix == ".json":
            data = json.loads(text)
        else:
            import yaml

            data = yaml.safe_load(text)
        agent = data.get("agent") or data.get("id") or file.stem
        for a in data.get("artifacts") or []:
            paths = a.get("paths") or {}
            systems = sorted(paths) if isinstance(paths, dict) else list(a.get("systems") or [])
            patterns = [p for v in (paths.values() if isinstance(paths, dict) else [paths]) for p in ([v] if isinstance(v, str) else v)]
            patterns = [p["pattern"] if isinstance(p, dict) else p for p in patterns]
            out.append({"artifact_id": str(a["id"]), "agent": str(a.get("agent") or agent), "category": a.get("category"), "systems": systems, "priority": str(a.get("priority") or "normal"), "patterns": patterns})
    ids = [a["artifact_id"] for a in out]
    if len(set(ids)) < len(ids):
        raise ValueError(f"artifacts named twice: {sorted({i for i in ids if ids.count(i) > 1})}")
    return sorted(out, key=lambda a: a["artifact_id"])


def catalogue_tables(spark: SparkSession, catalogue: list[dict]) -> dict[str, DataFrame]:
    """artifacts and patterns of a catalogue as small tables; patterns as operators.artifacts takes them."""
    from trailspark.operators.artifacts import patterns

    rows = [(a["artifact_id"], a["agent"], a["category"], a["systems"], a["priority"]) for a in catalogue]
    root = lambda p: "named" if p.startswith(("~", "%", "$", "/", "<vscode")) else "working"
    entries = [(a["artifact_id"], a["agent"], g, root(p)) for a in catalogue for p in a["patterns"] for g in expand(p)]
    return {"artifacts": spark.createDataFrame(rows, "artifact_id string, agent string, category string, systems array<string>, priority string"), "patterns": patterns(spark, entries)}
