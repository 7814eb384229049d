"""Scans: rules over events, in one pass for all that look at single events, and one shuffle for each other."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions.identity import finding_id, uninterpreted
from trailspark.operators.bursts import bursts, large_groups, members
from trailspark.operators.summaries import beside
from trailspark.rules.compile import NUMBERS, TEXT_VIEWS, check, condition, fields, leaves, prepared, resolve, test_of, within_words
from trailspark.schema import KINDS

#: Severities, the gravest first.
SEVERITIES = ("critical", "high", "medium", "low", "info")
QUOTED_VALUES, QUOTED_CHARACTERS = 6, 300


@dataclass(frozen=True)
class Rule:
    """One rule. aggregate: {"by": columns, "min_count": n, "window_minutes": m?, "distinct": selector?}; samples are events that match or don't."""

    id: str
    title: str
    severity: str
    match: dict
    kinds: tuple[str, ...] = ()
    agents: tuple[str, ...] = ()
    redact: bool = False
    aggregate: dict | None = None
    positive: tuple[dict, ...] = field(default=(), compare=False)
    negative: tuple[dict, ...] = field(default=(), compare=False)
    pack: str = ""
    description: str = field(default="", compare=False)
    tags: tuple[str, ...] = ()

    def __post_init__(self):
        if self.severity not in SEVERITIES:
            raise ValueError(f"{self.id}: unknown severity {self.severity}")
        if bad := set(self.kinds) - set(KINDS):
            raise ValueError(f"{self.id}: unknown kinds {sorted(bad)}")
        try:
            check(self.match)
        except ValueError as e:
            raise ValueError(f"{self.id}: {e}") from e

    def fields(self) -> set[str]:
        """The selectors that it reads."""
        distinct = (self.aggregate or {}).get("distinct")
        return fields(self.match) | ({distinct} if distinct else set())

    def applies(self) -> Column:
        """Its kinds and agents; a record that was read but not mapped may be of any kind."""
        out = F.lit(True)
        if self.kinds:
            out &= F.col("kind").isin(*self.kinds) | uninterpreted()
        if self.agents:
            out &= F.coalesce(F.col("agent").isin(*self.agents), F.lit(False))
        return out

    def matches(self) -> Column:
        # a CASE keeps the cheap gate before the patterns
        return F.when(self.applies(), condition(self.match)).otherwise(False)


def check_rules(rules: list[Rule]) -> list[Rule]:
    """The rules by id; ids have to be unique, and every rule needs a positive and a negative sample."""
    if len({r.id for r in rules}) < len(rules):
        raise ValueError("two rules have one id")
    if lacking := [r.id for r in rules if not (r.positive and r.negative)]:
        raise ValueError(f"without samples: {lacking}")
    return sorted(rules, key=lambda r: r.id)


def quoted(rule: Rule) -> Column:
    """Up to six distinct matched values, cut to 300 characters, and how many more there are; of a redacting rule their lengths only."""
    none = F.array().cast("array<string>")
    tested = [within_words(f, o, x, F.filter(resolve(f), _holds(o, x, i)), none) for f, o, x, i in leaves(rule.match)]
    show = (lambda v: F.concat(F.lit("<redacted, "), F.char_length(v).cast("string"), F.lit(" characters>"))) if rule.redact else (lambda v: F.substring(v, 1, QUOTED_CHARACTERS))

    def said(values: Column) -> Column:
        rest = F.size(values) - QUOTED_VALUES
        more = F.when(rest > 0, F.array(F.concat(F.lit("("), rest.cast("string"), F.lit(" more)")))).otherwise(none)
        return F.concat(F.transform(F.slice(values, 1, QUOTED_VALUES), show), more)

    # a list of one list names the values, so that they are found once and not at every use
    return F.get(F.transform(F.array(F.array_distinct(F.flatten(F.array(*tested))) if tested else none), said), F.lit(0))


def _holds(operator: str, wanted, ignore_case):
    """The test of a leaf, for one value."""
    if operator in NUMBERS:
        return lambda v: F.coalesce(NUMBERS[operator](v, wanted), F.lit(False))
    return test_of(operator, wanted, ignore_case) or (lambda v: F.lit(True))


def prepare(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """events with what the rules' Columns read, made once a row whatever the number of rules."""
    distinct = {(r.aggregate or {}).get("distinct") for r in rules}
    return prepared(events, {f for r in rules for f in r.fields()}, None if distinct & set(TEXT_VIEWS) else [r.match for r in rules])


FINDING = ["finding_id", "rule_id", "severity", "title", "ts_utc", "agent", "session_id", "event_count", "matched", "summary"]


def scan_events(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of the rules on single events: one pass over the events, whatever the number of rules."""
    single = [r for r in rules if not r.aggregate]
    hits = [
        F.when(r.matches(), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.title).alias("title"), quoted(r).alias("matched")))
        for r in single
    ]
    found = prepare(events, single).select("event_id", "ts_utc", "agent", "session_id", "kind", uninterpreted().alias("_unmapped"), F.explode(F.array_compact(F.array(*hits))).alias("f"))
    flat = found.select("event_id", "ts_utc", "agent", "session_id", "kind", "_unmapped", "f.*")
    said = F.concat(F.col("title"), F.lit(": "), F.col("kind"), F.when(F.col("_unmapped"), F.lit(" (a format that nobody has mapped)")).otherwise(F.lit("")))
    return flat.withColumns({"finding_id": finding_id(F.col("rule_id"), F.array("event_id")), "event_count": F.lit(1).cast("long"), "summary": said}).select(*FINDING, "event_id")


def scan_groups(events: DataFrame, rule: Rule) -> DataFrame:
    """Groups or bursts of an aggregate rule: the keys, size, first and last."""
    a = rule.aggregate
    hits = prepare(events, [rule]).where(rule.matches())
    if a.get("window_minutes"):
        return bursts(hits, list(a["by"]), a["window_minutes"], a["min_count"])
    distinct = F.get(resolve(a["distinct"]), F.lit(0)) if a.get("distinct") else None
    return large_groups(hits, list(a["by"]), a["min_count"], distinct)


def evidence(events: DataFrame, rule: Rule) -> DataFrame:
    """(rule_id, keys, event_id) of the events behind the groups of an aggregate rule."""
    keys, found = list(rule.aggregate["by"]), scan_groups(events, rule)
    hits = prepare(events, [rule]).where(rule.matches())
    if rule.aggregate.get("window_minutes"):
        some = members(hits, found, keys)
    else:
        some = hits.join(found, reduce(lambda x, y: x & y, [hits[k].eqNullSafe(found[k]) for k in keys]), "left_semi")
    return some.select(F.lit(rule.id).alias("rule_id"), *keys, "event_id")


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"), F.countDistinct("rule_id").alias("rules"))


def finding_order() -> list[Column]:
    rank = reduce(lambda c, x: c.when(F.col("severity") == x[1], x[0]), enumerate(SEVERITIES), F.when(F.lit(False), -1))
    return [rank, F.asc_nulls_first("ts_utc"), F.asc("rule_id")]


def silent_rules(spark: SparkSession, rules: list[Rule], findings: DataFrame) -> DataFrame:
    """Rules without a finding."""
    return spark.createDataFrame([(r.id,) for r in rules], "rule_id string").join(findings.select("rule_id").distinct(), "rule_id", "left_anti")


def untouched(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Events to which no rule applies."""
    return events.where(~reduce(lambda x, y: x | y, [r.applies() for r in rules]))


def self_test(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(rule_id, sample, expected, found) of every inline sample, by the Columns that scans use, in one pass."""
    import json

    from trailspark.schema import EVENT, EVENT_COLUMNS

    rows = []
    for r in rules:
        for expected, samples in ((True, r.positive), (False, r.negative)):
            for i, s in enumerate(samples):
                row = {"kind": "unparsed.record", **{k: v for k, v in s.items() if k not in ("payload", "raw")}, "locator": f"{int(expected)}:{i}"}
                row |= {"payload_json": json.dumps(s.get("payload", {})), "raw_json": json.dumps(s["raw"]) if "raw" in s else None}
                rows.append((r.id, *(row.get(c) for c in EVENT_COLUMNS)))
    table = prepare(spark.createDataFrame(rows, f"rule_id string, {EVENT}"), rules)
    found = reduce(lambda c, r: c.when(F.col("rule_id") == r.id, r.matches()), rules, F.when(F.lit(False), F.lit(False)))
    return table.select("rule_id", F.col("locator").alias("sample"), F.startswith("locator", F.lit("1:")).alias("expected"), found.alias("found"))


def scan_record(events: DataFrame, rules: list[Rule], findings: DataFrame, run: str) -> DataFrame:
    """One row that says what a scan did: run, ids of its rules, events read, findings made. An empty scan is a scan too."""
    ids = F.array(*[F.lit(r.id) for r in sorted(rules, key=lambda r: r.id)]) if rules else F.array().cast("array<string>")
    read, made = events.agg(F.count("*").alias("events_read")), findings.agg(F.count("*").alias("findings"), F.countDistinct("rule_id").alias("rules_found"))
    return beside(read, made).select(F.lit(run).alias("run_id"), F.lit(len(rules)).alias("rules_run"), ids.alias("rule_ids"), "events_read", "findings", "rules_found")


def session_marks(sessions: DataFrame, findings: DataFrame) -> DataFrame:
    """sessions with the number of their findings, the gravest severity, and whether any record is unread."""
    rank = reduce(lambda c, x: c.when(F.col("severity") == x[1], x[0]), enumerate(SEVERITIES), F.when(F.lit(False), -1))
    found = findings.groupBy("agent", F.col("session_id").alias("session")).agg(F.count("*").alias("findings"), F.min(rank).alias("_worst"))
    worst = F.get(F.array(*[F.lit(x) for x in SEVERITIES]), F.col("_worst"))
    joined = sessions.alias("s").join(found.alias("f"), F.col("s.agent").eqNullSafe(F.col("f.agent")) & F.col("s.session").eqNullSafe(F.col("f.session")), "left")
    return joined.select("s.*", F.coalesce("f.findings", F.lit(0)).cast("long").alias("findings"), worst.alias("worst"), (F.col("s.unreadable") > 0).alias("has_unread"))
