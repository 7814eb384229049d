"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

On a bounded, documented sample of labelled texts, tasks count in how many texts of either label each hashed
n-gram of three to five characters is present. The log ratio of the smoothed shares is an n-gram's scale. Logistic
regression is fitted on the scaled presence bits of the n-grams that separate the labels most, and its constant is
corrected for the share of toxic rows among all labelled ones. Every row is scored by its whole text.

Defined cases: a null text counts as empty; empty texts get the score of a text without n-grams; a row with
several labels counts as toxic if one says so; null labels and labels without a document are left out; without
both labels the score is the smoothed share of toxic rows; equal rows are scored alike; columns other than those
asked for are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailspark.llm.common import stored, table
from trailspark.llm.langid import held_out
from trailspark.llm.ngrams import hashed

LEAST, MOST, BITS = 3, 5, 18
#: Labelled texts of either label that are fitted on, and n-grams in the classifier.
EACH, FEATURES = 2000, 3000
_RIDGE, _STEPS = 1e-3, 300


@dataclass
class Model:
    """place: for each n-gram number its feature or -1; weights: of the features, scales included; constant."""

    place: np.ndarray
    weights: np.ndarray
    constant: float


def _features(text: str | None, place: np.ndarray, n: int) -> np.ndarray:
    """Which features a text has."""
    found = np.zeros(n + 1, bool)  # -1 falls on the last
    for codes in hashed(f" {(text or '').lower()} ", LEAST, MOST, BITS):
        found[place[codes]] = True
    return found[:n]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("body").to_pylist()):
            flags = np.zeros(1 << BITS, bool)
            for codes in hashed(f" {(text or '').lower()} ", LEAST, MOST, BITS):
                flags[codes] = True
            counts[toxic] += flags
    at = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["code", "clean", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", label: str = "toxic", each: int = EACH, features: int = FEATURES) -> Model:
    """Fit on at most `each` documents of either label, chosen by a hash of their id."""
    spark = docs.sparkSession
    known = labels.where(F.col(doc).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc).alias("doc")).agg(F.max(label).cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    constant = math.log(share / (1 - share))
    none = Model(np.full(1 << BITS, -1, np.int32), np.zeros(0), constant)
    if len(totals) < 2:
        return none
    # the first `each` ids of either label by a fine hash; a rate before that keeps the sort small
    place = F.shiftrightunsigned(F.xxhash64(F.lit("toxicity sample"), "doc"), 11)
    rates = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, min(1.0, 1.2 * each / n))])
    first = F.row_number().over(W.partitionBy("toxic").orderBy("place", "doc"))
    some = known.withColumn("place", place).where(F.col("place") < F.element_at(rates, F.col("toxic")) * float(1 << 53))
    few = some.withColumn("first", first).where(F.col("first") <= each).select("doc", "toxic")
    # at most 2 * each ids, so that the documents need no shuffle; of several texts of an id the least counts
    texts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("body")).join(F.broadcast(few), "doc").groupBy("doc", "toxic").agg(F.min(F.coalesce("body", F.lit(""))).alias("body")).select("toxic", "body")
    sample = stored(texts, "toxicity-sample")
    counted = sample.mapInArrow(_counts, "code long, clean long, toxic long").groupBy("code").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rows = counted.toPandas()  # at most 2**18
    numbers = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(numbers) < 2:
        return none
    counts = np.zeros((2, 1 << BITS))
    counts[:, rows["code"].to_numpy()] = rows[["clean", "toxic"]].to_numpy().T
    shares = [(counts[k] + 1) / (numbers[k] + 2) for k in (0, 1)]
    ratio = np.log(shares[1] / shares[0])
    # the distance of both shares, in their standard errors
    spread = np.sqrt(sum(s * (1 - s) / numbers[k] for k, s in enumerate(shares)))
    chosen = np.sort(np.argsort(-np.abs(shares[1] - shares[0]) / spread, kind="stable")[:features])
    chosen = chosen[counts[:, chosen].sum(0) > 0]
    at = np.full(1 << BITS, -1, np.int32)
    at[chosen] = np.arange(len(chosen))
    sent = spark.sparkContext.broadcast(at)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(_features(t, sent.value, len(chosen))).tobytes() for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(bits, pa.binary())], names=["toxic", "bits"])

    found = sorted(sample.mapInArrow(held, "toxic int, bits binary").collect(), key=lambda r: (r.toxic, bytes(r.bits)))  # features / 8 bytes a row
    data = np.unpackbits(np.array([np.frombuffer(r.bits, np.uint8) for r in found]), axis=1)[:, : len(chosen)].astype(np.float32)
    data *= ratio[chosen].astype(np.float32)
    target = np.array([r.toxic for r in found], np.float32)
    weights, bias = _logistic(data, target)
    odds = math.log(share / (1 - share)) - math.log(numbers[1] / numbers[0])
    return Model(at, weights * ratio[chosen], bias + odds)


def _logistic(data: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and constant of logistic regression with a ridge, by accelerated gradient steps."""
    n, d = data.shape
    vector = np.ones(d, np.float32) / math.sqrt(max(1, d))
    for _ in range(20):  # the largest curvature
        vector = data.T @ (data @ vector)
        norm = float(np.linalg.norm(vector))
        vector /= max(norm, 1e-9)
    step = 1 / (0.25 * (norm / n + 1) + _RIDGE)
    at = ahead = np.zeros(d, np.float32)
    bias = bias_ahead = 0.0
    for k in range(_STEPS):
        error = 1 / (1 + np.exp(-np.clip(data @ ahead + bias_ahead, -30, 30))) - target
        new, new_bias = ahead - step * (data.T @ error / n + _RIDGE * ahead), bias_ahead - step * float(error.mean())
        pull = k / (k + 3)
        ahead, bias_ahead = new + pull * (new - at), new_bias + pull * (new_bias - bias)
        at, bias = new, new_bias
    return at.astype(np.float64), bias


def score(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep` and the score of each row: how likely label 1 is."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 places
    held = [f"k{i}" for i in range(len(keep))]
    chosen = docs.selectExpr(*[f"`{c}` as {h}" for c, h in zip(keep, held)], f"`{text}` as body")
    kinds = ", ".join(f"{c} {t}" for c, t in chosen.dtypes if c != "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            found = [known.constant + float(known.weights @ _features(t, known.place, len(known.weights))) for t in batch.column("body").to_pylist()]
            scores = 1 / (1 + np.exp(-np.clip(np.array(found), -500, 500)))
            yield pa.RecordBatch.from_arrays([*[batch.column(h) for h in held], pa.array(scores, pa.float64())], names=[*held, "s"])

    return chosen.mapInArrow(run, f"{kinds}, s double").toDF(*keep, "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out("doc_id", 5, 0)))
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
