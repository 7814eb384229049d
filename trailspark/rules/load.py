"""Rules from files: a folder for each pack, a YAML or JSON file for each rule.

Strict, because a rule that is silently left out finds nothing: an unknown pack, a bad selector or pattern, an id used
twice, and a rule without a sample that should match and one that shouldn't, are errors.
"""

from __future__ import annotations

import json
from pathlib import Path

from trailspark.rules.scan import Rule, check_rules

NEEDED = ("id", "pack", "title", "severity", "match", "tests")


class RuleError(ValueError):
    """A rule file that may not be used."""


def _data(path: Path):
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuleError(f"{path}: YAML can't be read here; use JSON") from e
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise RuleError(f"{path}: {e}") from e


def _in_one_line(value) -> str:
    """A text, or the English one of a mapping by language."""
    return " ".join(str(value.get("en", "") if isinstance(value, dict) else value or "").split())


def load_file(path: str | Path, pack: str | None = None) -> Rule:
    path = Path(path)
    data = _data(path)
    if not isinstance(data, dict) or (lacking := [k for k in NEEDED if k not in data]):
        raise RuleError(f"{path}: no rule, or without {lacking if isinstance(data, dict) else NEEDED}")
    if pack and data["pack"] != pack:
        raise RuleError(f"{path}: lies in the pack {pack} and names {data['pack']}")
    samples = {True: [], False: []}
    for t in data["tests"]:
        if t.get("out_of_scope") and t["match"]:
            raise RuleError(f"{path}: {t.get('name')} is out of scope and should match")
        samples[bool(t["match"])].append(dict(t.get("event") or {}))
    if not all(samples.values()):
        raise RuleError(f"{path}: needs a sample that should match and one that shouldn't")
    applies = data.get("applies_to") or {}
    named = lambda k: tuple(x for x in applies.get(k) or () if x != "any")
    aggregate = None
    if block := data.get("aggregate"):
        wanted = {"by": tuple(block["group_by"]), "min_count": int(block.get("distinct_gte") or block["min_count"]), "window_minutes": block.get("window_minutes"), "distinct": block.get("distinct")}
        aggregate = {k: v for k, v in wanted.items() if v is not None}
    try:
        return Rule(
            str(data["id"]), str(data["title"]), str(data["severity"]), data["match"], named("kinds"), named("agents"), bool(data.get("redact")), aggregate,
            tuple(samples[True]), tuple(samples[False]), str(data["pack"]), _in_one_line(data.get("description")), tuple(data.get("tags") or ()),
        )
    except ValueError as e:
        raise RuleError(f"{path}: {e}") from e


def load(folder: str | Path, packs: list[str] | None = None, known: tuple[str, ...] | None = None) -> list[Rule]:
    """The rules of all packs under a folder, or of those named, by id. known: the only packs there may be."""
    root = Path(folder)
    there = sorted(p.name for p in root.iterdir() if p.is_dir() and p.name != "schema") if root.is_dir() else []
    if unknown := set(there) - set(known or there) | set(packs or ()) - set(there):
        raise RuleError(f"unknown packs: {sorted(unknown)}")
    rules = [load_file(f, pack) for pack in (packs or there) for f in sorted((root / pack).iterdir()) if f.suffix in (".yaml", ".json")]
    if not rules:
        raise RuleError(f"{root} holds no rules")
    try:
        return check_rules(rules)
    except ValueError as e:
        raise RuleError(str(e)) from e
