"""The unified event model."""

from __future__ import annotations

#: The closed vocabulary of event kinds.
KINDS = (
    "session.start", "session.end", "user.prompt", "assistant.text", "assistant.thinking", "tool.call", "tool.result",
    "file.read", "file.write", "file.snapshot", "command.exec", "network.request", "mcp.call", "permission.decision",
    "permission.change", "safety.refusal", "config.snapshot", "instruction.source", "memory.write", "plan.write",
    "prompt.history", "artifact.fs", "unparsed.record",
)
PRECISIONS = ("exact", "second", "minute", "hour", "day", "filesystem", "absent")
#: Marks, in parse_problem, a record that was read but has no mapping.
UNINTERPRETED = "is returned uninterpreted"

EVENT = (
    "event_id string, bundle_uuid string, kind string, agent string, ts_utc string, ts_precision string, ts_source string, "
    "actor string, client string, host string, user string, session_id string, project_path string, git_branch string, "
    "artifact_id string, original_path string, file_sha256 string, locator string, payload_json string, raw_json string, parse_problem string"
)
EVENT_COLUMNS = [c.strip().split(" ")[0] for c in EVENT.split(",")]
