"""Golden cases for views and reports that no query over the driver's tables shows."""

import json

import pytest
from pyspark.sql import functions as F

from trailspark.functions import flatten
from trailspark.functions import text as T
from trailspark.operators import artifacts, views
from trailspark.schema import EVENT, EVENT_COLUMNS


def events(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c) for c in EVENT_COLUMNS) for r in rows], EVENT)


@pytest.mark.parametrize(
    "since,until,expected",
    [
        ("2024-01-01", "2024-01-01", ("2024-01-01T00:00:00.000000Z", "2024-01-01T23:59:59.999999Z", None)), (None, "2024-01-01 10:05", (None, "2024-01-01T10:05:59.999999Z", None)),
        ("2024-01-01T10:00:00Z", None, ("2024-01-01T10:00:00.000000Z", None, None)), ("soon", None, (None, None, "not a time: soon")), ("2024-02-30", None, (None, None, "not a time: 2024-02-30")),
    ],
)
def test_bounds(since, until, expected):
    found = views.bounds(since, until)
    assert (found["since"], found["until"], found["problem"]) == expected


def test_inverted_bounds():
    assert views.bounds("2024-01-02", "2024-01-01")["problem"] == "the window ends before it begins"


def test_instructions(spark):
    say = lambda text, **about: json.dumps({"text": text, "instructions": [about]})
    rows = events(
        spark, {"event_id": "a", "bundle_uuid": "b", "kind": "instruction.source", "original_path": "/p", "payload_json": say("x", scope="project", tools=["Bash"], executable=True)}, {"event_id": "c", "kind": "instruction.source", "payload_json": say("x", scope="user")},
        {"event_id": "d", "kind": "instruction.source", "payload_json": say("", scope="user")}, {"event_id": "e", "kind": "user.prompt"},
    )
    shown = {r.event_id: r for r in views.instructions_view(rows).collect()}
    assert set(shown) == {"a", "c", "d"} and [shown[k].equal_texts for k in "acd"] == [2, 2, 1] and not any(r.recorded_elsewhere for r in shown.values()) and (shown["a"].scope_order, shown["c"].scope_order) == (3, 2)
    counts = {r.scope: r for r in views.instruction_counts(rows).collect()}
    assert set(counts) == set(views.SCOPES) and (counts["project"].instructions, counts["project"].grants_tools, counts["project"].executable, counts["user"].empty, counts["local"].instructions) == (1, 1, 1, 1, 0)
    files = spark.createDataFrame([("b", "/p", "2024", 3, "parsed")], "bundle_uuid string, path string, mtime string, size long, status string")
    assert {r.event_id: r["size"] for r in views.instruction_files(views.instructions_of(rows), files).collect()} == {"a": 3, "c": None, "d": None}
    assert views.by_id(rows, "c").count() == 1


def test_instructions_recorded_elsewhere(spark):
    """The flag is about the paths that an instruction names, not about equal texts."""
    say = lambda *paths, text="x" * 400: json.dumps({"text": text, "instructions": [{"path": p} for p in paths]})
    cases = {"own": say("/s#thread"), "other": say("/rules.md"), "both": say("/rules.md", "/s"), "none": say(), "null": say(None), "longer": say("/r#x", text="x" * 400 + "y")}
    rows = events(spark, *[{"event_id": k, "kind": "instruction.source", "original_path": "/s", "payload_json": v} for k, v in cases.items()])
    shown = {r.event_id: (r.recorded_elsewhere, r.equal_texts) for r in views.instructions_view(rows).collect()}
    assert shown == {"own": (False, 5), "other": (True, 5), "both": (False, 5), "none": (False, 5), "null": (False, 5), "longer": (True, 1)}


def test_equal_files_name_each_other(spark):
    rows = [(f"/f{i}", "h", "parsed", True) for i in range(9)] + [("/x", "k", "parsed", True), ("/y", None, "parsed", True), ("/z", None, "parsed", True)]
    found = {r.path: r for r in views.artifacts_view(spark.createDataFrame(rows, "path string, sha256 string, status string, collected boolean")).collect()}
    assert found["/f0"].other_paths == ["/f1", "/f2", "/f3", "/f4", "/f5"] and found["/f3"].other_paths == ["/f0", "/f1", "/f2", "/f4", "/f5"] and found["/f8"].other_paths == ["/f0", "/f1", "/f2", "/f3", "/f4"]
    assert (found["/f8"].copies, found["/f0"].same_as, found["/f8"].same_as) == (9, None, "/f0") and all(found[p].copies == 1 and found[p].other_paths is None for p in ("/x", "/y", "/z"))


def test_case_summary_names_models(spark):
    rows = events(spark, *[{"event_id": str(i), "agent": "a", "kind": "assistant.text", "payload_json": json.dumps({"models": [{"model": f"m{i % 2}"}, {"model": "m0"}]})} for i in range(3)])
    assert {(r.name, r.n) for r in views.case_summary(rows).where("section = 'model'").collect()} == {("m0", 3), ("m1", 1)}


def test_catalogue_views(spark):
    catalogue = spark.createDataFrame([("a.t", "a", "transcript", ["linux"], "durable"), ("a.c", "a", "config", ["linux", "mac"], "live_only"), ("a.g", "a", "log", ["mac"], "first")], "artifact_id string, agent string, category string, systems array<string>, priority string")
    r = views.reader_coverage(catalogue, ("a.t", "a.g"), ("a.g",)).first()
    assert (r.transcripts, r.transcripts_read, r.artifacts, r["read"], r.at_floor, r.not_read) == (1, 1, 3, 1, 1, 1)
    assert [x.artifact_id for x in views.in_collection_order(catalogue, "linux").orderBy("place").collect()] == ["a.c", "a.t"]
    databases = spark.createDataFrame([("/x/a.db",), ("/x/b.db",), ("/y/c.db",)], "path string")
    asked = artifacts.patterns(spark, [("w", "a", "/x/a.db-wal", "named"), ("v", "a", "/y/*-wal", "named")])
    assert [x.path for x in views.missing_wal(databases, asked).collect()] == ["/x/b.db"]
    unread = events(spark, *[{"event_id": str(i), "kind": "unparsed.record", "artifact_id": f"a{i % 2}"} for i in range(5)])
    assert [(x.artifact_id, x.unreadable) for x in views.top_unread(unread, 1).collect()] == [("a0", 3)]


def test_cells_and_csv(spark, tmp_path):
    table = spark.createDataFrame([(1, True, ["a", "b"], {"k": 1}, None)], "n long, b boolean, l array<string>, m map<string, int>, x string").withColumn("s", F.array(F.struct(F.lit(1).alias("q"))))
    assert tuple(table.select(*[views.cell(F.col(c), k).alias(c) for c, k in table.dtypes]).first()) == ("1", "true", "a; b", '{"k":1}', "", '{"q":1}')
    views.export_csv(table, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().l == "a; b"


def test_values(spark):
    number = lambda v: spark.createDataFrame([(v,)], "v string").select(T.number_of(F.try_parse_json("v"))).first()[0]
    assert [number(v) for v in ("3", '" 2.5 "', "true", '"x"', "null")] == [3.0, 2.5, None, None, None]
    r = spark.createDataFrame([('{"b": 1.0, "a": "é"}', '{"a": {"b": 1}, "sha256": "x"}', "-src-app", "vscode-remote://h/p", "file:///p")], "c string, h string, p string, u string, f string").select(
        flatten.canonical("c"), flatten.custody_hash("h"), T.project_from_folder(F.col("p")), T.remote_uri(F.col("u")), T.remote_uri(F.col("f"))
    ).first()
    import hashlib

    assert tuple(r) == ('{"a": "é", "b": 1.0}', hashlib.sha256(b'{"a":{"b":1}}').hexdigest(), "/src/app", True, False)
