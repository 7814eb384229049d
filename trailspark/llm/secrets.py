"""Secret scans with DataFrame functions only.

Three rules find assignments, access keys and long hexadecimal runs. Two first-order character Markov models,
one of random strings and one of ordinary identifiers, add other runs whose mean log-likelihood ratio per
character exceeds a threshold. The models are trained on a bounded labelled sample: words of some documents
(random where a rule marks them, ordinary otherwise) and uniformly random strings.

Defined cases: a null text counts as empty and holds nothing; each of several equal rows gets its own result;
columns other than the id and the text are not read; an empty table gives no rows. Positions are code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailspark.llm.common import let, sized, table

#: The rules, in the order in which spans of one start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
#: A match is a maximal run, so its least length can stand in the pattern.
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
TRAINING_WORD = r"([A-Za-z0-9+/_=-]{6,})"
#: Documents whose words train the models, and random strings beside them.
TRAINING_DOCUMENTS = 2000
RANDOM_STRINGS = 4096
#: Nats a character.
THRESHOLD = 0.75


def _matches(text: Column, pattern: str, kind: int, when: Column | None, passes) -> Column:
    """array<struct<kind, nth, gap, width, passes>>: each match with the code points since the match before it."""
    none = F.array().cast("array<struct<kind:int,nth:int,gap:int,width:int,passes:boolean>>")
    found = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: F.when(F.size(hits) == 0, none).otherwise(
            let(
                F.split(text, pattern, -1),
                lambda gaps: F.transform(
                    hits,
                    lambda hit, i: F.struct(
                        F.lit(kind).alias("kind"),
                        i.alias("nth"),
                        F.char_length(F.get(gaps, i)).alias("gap"),
                        F.char_length(hit).alias("width"),
                        passes(hit).alias("passes"),
                    ),
                ),
            )
        ),
    )
    return found if when is None else F.when(when, found).otherwise(none)


def train(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", documents: int = TRAINING_DOCUMENTS, strings: int = RANDOM_STRINGS) -> list[float]:
    """Log-likelihood ratios, random against ordinary, of each pair of characters of ALPHABET (row-major).

    The sample: about `documents` rows, chosen by a hash of the id, and `strings` random strings.
    """
    share = min(1.0, documents / max(1, docs.count()))
    place = F.shiftrightunsigned(F.xxhash64(F.lit("train"), doc), 11)
    some = docs.where((place <= share * float(1 << 53)) & F.col(text).isNotNull())
    said = some.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TRAINING_WORD), F.lit(1)))).alias("word"))
    labelled = said.select("word", F.col("word").rlike(f"{ACCESS}|{HEX}").cast("int").alias("random"))
    drawn = docs.sparkSession.range(strings).select(
        F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("random string "), F.col("id").cast("string")), 256))), "=", "").alias("word"),
        F.lit(1).alias("random"),
    )
    pairs = labelled.unionByName(drawn).select(
        "random", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substr(F.col("word"), i, F.lit(2)))).alias("pair")
    )
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}  # at most 2 * 67 * 67
    size = len(ALPHABET)
    totals = {(k, a): sum(counts.get((k, a + b), 0) + 1 for b in ALPHABET) for k in (0, 1) for a in ALPHABET}
    ratio = lambda a, b: math.log((counts.get((1, a + b), 0) + 1) / totals[1, a]) - math.log((counts.get((0, a + b), 0) + 1) / totals[0, a])
    return [ratio(ALPHABET[i // size], ALPHABET[i % size]) for i in range(size * size)]


def mean_ratio(word: Column, ratios: list[float]) -> Column:
    """The mean log-likelihood ratio per pair of characters of a word over ALPHABET."""
    size, weights = len(ALPHABET), F.lit(ratios)
    places = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(
        places,
        lambda at: F.aggregate(
            F.sequence(F.lit(1), F.size(at) - 1),
            F.lit(0.0),
            lambda total, i: total + F.get(weights, (F.get(at, i - 1) - 1) * size + F.get(at, i) - 1),
        )
        / (F.size(at) - 1),
    )


def scan(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", ratios: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, text_hash, spans) for every row of docs; spans: array<struct<start, kind, end, before>> by start and kind.

    kind indexes KINDS; before is the furthest end of the spans listed earlier, so that text can be cut
    without merging spans first. Spans of the models that overlap a rule's span are left out.
    """
    ratios = train(docs, doc=doc, text=text) if ratios is None else ratios
    rows = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    body, yes = F.col("text"), lambda hit: F.lit(True)
    named = let(F.lower(body), lambda low: F.exists(F.array(*map(F.lit, ASSIGN_WORDS)), lambda w: F.contains(low, w)))
    found = F.concat(
        F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("nth"), F.lit(0).alias("gap"), F.lit(0).alias("width"), F.lit(True).alias("passes"))),  # one row a document at least
        _matches(body, ASSIGN, 0, named, lambda hit: F.char_length(F.regexp_extract(hit, ASSIGN, 2)) >= MIN_VALUE),
        _matches(body, ACCESS, 1, F.contains(body, F.lit("AKIA")), yes),
        _matches(body, HEX, 2, None, yes),
        _matches(body, CANDIDATE, 3, None, lambda hit: mean_ratio(hit, ratios) > threshold),
    )
    hits = rows.select("doc", "text_hash", "row", F.explode(found).alias("h")).select("doc", "text_hash", "row", "h.*").repartition("row")
    so_far = W.partitionBy("row", "kind").orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = hits.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(so_far)).where("passes").withColumn("start", F.col("end") - F.col("width"))
    rule = F.col("kind").between(0, 2)
    by_start = W.partitionBy("row").orderBy("start", "kind")
    earlier, later = by_start.rowsBetween(W.unboundedPreceding, -1), by_start.rowsBetween(1, W.unboundedFollowing)
    clear = (F.coalesce(F.max(F.when(rule, F.col("end"))).over(earlier), F.lit(0)) <= F.col("start")) & (
        F.coalesce(F.min(F.when(rule, F.col("start"))).over(later), F.col("end")) >= F.col("end")
    )
    kept = ends.withColumn("clear", clear).where((F.col("kind") != 3) | F.col("clear"))
    kept = kept.withColumn("before", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    return kept.groupBy("row", "doc", "text_hash").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") >= 0, F.struct("start", "kind", "end", "before")))).alias("spans")
    ).select("doc", "text_hash", "spans")


def redact(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", mark: str = "<secret>", **options) -> DataFrame:
    """docs with each found span replaced by a mark; rows without spans and all other columns stay as they are."""
    found = sized(scan(docs, doc=doc, text=text, **options).where(F.size("spans") > 0).dropDuplicates(["doc", "text_hash"]), 200_000)
    same = docs[doc].eqNullSafe(found["doc"]) & (F.xxhash64(docs[text]) == found["text_hash"])
    body = docs[text]
    piece = lambda s: F.when(
        s["start"] >= s["before"], F.concat(F.substr(body, (s["before"] + 1).cast("int"), (s["start"] - s["before"]).cast("int")), F.lit(mark))
    ).otherwise(F.lit(""))
    tail = F.substr(body, (F.array_max(F.transform(found["spans"], lambda s: s["end"])) + 1).cast("int"))
    cut = F.when(found["spans"].isNull(), body).otherwise(F.concat(F.array_join(F.transform(found["spans"], piece), ""), tail))
    return docs.join(found, same, "left").select(*[cut.alias(c) if c == text else docs[c] for c in docs.columns])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("doc").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(shown(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )
