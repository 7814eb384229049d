"""Quality: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are of three kinds: n-grams of its shape (letters, capitals, digits and blanks stand for themselves once a
run, marks as they are), how far back each word stood before, and character n-grams. Their frequencies are damped,
weighted by rarity, scaled to length one a kind, and projected on the first singular vectors of a bounded, documented
sample of labelled texts. The sample's vectors, scaled to length one, are broadcast with their labels. Every document's
exact cosines with all of them are computed in blocks, and its nearest ones vote for their label, each by its cosine and
by how many labelled rows a row of the sample stands for.

Defined cases: a null text counts as empty; a text without terms, or one that is like no labelled text, gets the smoothed
share of label 1; a row with several labels counts as good if one says so; null labels and labels without a document are
left out; a label that never occurs gives the smoothed share of label 1 for all; of neighbours with equal cosines that of
the smaller place in the sample (good ones after bad ones, then by a hash of the id) comes first; equal rows are scored
alike; texts of any length are taken whole, a piece at a time; columns other than those asked for are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailspark.llm.common import released, stored, table, texts_of
from trailspark.llm.langid import held_out
from trailspark.llm.ngrams import PIECE, hashed, rolled

#: Labelled texts of either label that are fitted on.
EACH = 750
#: Dimensions of the vectors, and neighbours that vote.
DIMENSIONS, NEIGHBOURS = 32, 31
#: Longest n-grams of shapes and of characters, and bits of their numbers; kinds of distances between equal words.
SHAPE_MOST, SHAPE_BITS, GRAM_MOST, GRAM_BITS, DISTANCES = 4, 11, 3, 11, 16
#: What a kind of terms weighs.
WEIGHTS = (1.0, 1.0, 0.5)
#: A text has this many terms of a kind, when frequencies are damped.
_SCALE = 1000.0
#: Documents whose cosines are computed together.
BLOCK = 256
_CUTS = (0, 1 << SHAPE_BITS, (1 << SHAPE_BITS) + DISTANCES, (1 << SHAPE_BITS) + DISTANCES + (1 << GRAM_BITS))
TERMS = _CUTS[-1]


def _kinds() -> np.ndarray:
    """What a character counts as in a shape, for those that have capitals or are marks."""
    found = np.full(0x250, ord("a"), np.uint32)
    for i in range(len(found)):
        c = chr(i)
        found[i] = ord("A") if c.isupper() else ord("a") if c.isalpha() else ord("0") if c.isdigit() else ord("\n") if c in "\n\r" else ord(" ") if c.isspace() else i
    return found


_KIND = _kinds()


def shape(text: str) -> np.ndarray:
    """The shape of a piece of text, each run of equal characters once."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _KIND[np.minimum(codes, len(_KIND) - 1)]
    kinds[codes >= len(_KIND)] = ord("a")
    return kinds[np.concatenate(([True], kinds[1:] != kinds[:-1]))] if len(kinds) else kinds


def terms(text: str | None) -> np.ndarray:
    """How often each term stands in a whole text."""
    text = text or ""
    found = np.zeros(TERMS)
    shapes, distances, grams = (found[a:b] for a, b in zip(_CUTS, _CUTS[1:]))
    last: dict[str, int] = {}
    count = [0] * DISTANCES
    at = 0
    for start in range(0, len(text), PIECE):
        for codes in rolled(shape(text[start : start + PIECE]), 1, SHAPE_MOST, SHAPE_BITS):
            shapes += np.bincount(codes, minlength=len(shapes))
        for word in text[start : start + PIECE].split():  # a word on the border of two pieces is two
            before = last.get(word)
            count[0 if before is None else min(DISTANCES - 1, (at - before).bit_length())] += 1
            last[word] = at
            at += 1
    distances += count
    for codes in hashed(text.lower(), 1, GRAM_MOST, GRAM_BITS):
        grams += np.bincount(codes, minlength=len(grams))
    return found


def damped(counts: np.ndarray) -> np.ndarray:
    """Frequencies of the rows' terms, damped, a kind at a time."""
    parts = [counts[:, a:b] for a, b in zip(_CUTS, _CUTS[1:])]
    return np.concatenate([np.log1p(_SCALE * p / np.maximum(1, p.sum(1, keepdims=True))) for p in parts], 1)


def _scaled(rows: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Rows of damped frequencies, weighted, each kind of the length it weighs."""
    rows = rows * rarity
    for (a, b), weight in zip(zip(_CUTS, _CUTS[1:]), WEIGHTS):
        rows[:, a:b] *= weight / np.maximum(np.linalg.norm(rows[:, a:b], axis=1, keepdims=True), 1e-12)
    return rows


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """rarity of terms; axes: terms by dimensions; vectors, labels and weights of the sample; share of label 1."""

    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    share: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        """The vectors of rows of terms."""
        return _unit(_scaled(damped(counts), self.rarity) @ self.axes)

    def vote(self, vectors: np.ndarray, neighbours: int) -> np.ndarray:
        """The score of each vector; that of a text without terms is zero and has no neighbours."""
        if not len(self.vectors):
            return np.full(len(vectors), self.share)
        cosines = vectors @ self.vectors.T
        k = min(neighbours, cosines.shape[1])
        least = np.partition(cosines, -k, axis=1)[:, -k][:, None]
        # all above the k-th, and of those equal to it the first ones
        above, equal = cosines > least, cosines == least
        taken = above | (equal & (np.cumsum(equal, 1) <= k - above.sum(1, keepdims=True)))
        votes = np.where(taken, np.maximum(cosines, 0), 0) * self.weights
        total = votes.sum(1)
        return np.where(total > 1e-9, (votes * self.labels).sum(1) / np.maximum(total, 1e-9), self.share)


def _sample(docs: DataFrame, labels: DataFrame, totals: dict[int, int], doc: str, text: str, label: str, each: int) -> DataFrame:
    """(good, place, body) of at most `each` documents of either label, chosen by a hash of their id."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit("quality sample"), "doc"), 11)
    rates = F.create_map(*[F.lit(x) for k, n in sorted(totals.items()) for x in (k, min(1.0, 1.2 * each / n))])
    some = labels.withColumn("place", place).where(F.col("place") < F.element_at(rates, F.col("good")) * float(1 << 53))
    first = F.row_number().over(W.partitionBy("good").orderBy("place", "doc"))
    few = some.withColumn("first", first).where(F.col("first") <= each).select("doc", "good", "place")
    # at most 2 * each ids, so that the documents need no shuffle; of several texts of an id the least counts
    texts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("body")).join(F.broadcast(few), "doc")
    return texts.groupBy("doc", "good", "place").agg(F.min(F.coalesce("body", F.lit(""))).alias("body")).drop("doc")


def fit(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", label: str = "quality", each: int = EACH, dimensions: int = DIMENSIONS) -> Model:
    """Fit on at most `each` documents of either label."""
    known = labels.where(F.col(doc).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc).alias("doc")).agg(F.max(label).cast("int").alias("good"))
    totals = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    none = Model(np.zeros(TERMS), np.zeros((TERMS, 0)), np.zeros((0, 0)), np.zeros(0), np.zeros(0), share)
    if len(totals) < 2:
        return none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [damped(terms(t)[None, :])[0].astype(np.float32).tobytes() for t in texts_of(batch.column("body"))]
            yield pa.RecordBatch.from_arrays([batch.column("good"), batch.column("place"), pa.array(rows, pa.binary())], names=["good", "place", "row"])

    sample = stored(_sample(docs, known, totals, doc, text, label, each), "quality-sample")
    # 16 kB a row, of 2 * each rows at most
    found = sorted(sample.mapInArrow(released(run), "good int, place long, row binary").collect(), key=lambda r: (r.good, r.place, bytes(r.row)))
    good = np.array([r.good for r in found], np.float64)
    if len(set(good)) < 2:
        return none
    rows = np.array([np.frombuffer(r.row, np.float32) for r in found]).astype(np.float64)
    rarity = np.log((1 + len(rows)) / (1 + (rows > 0).sum(0)))
    rarity[_CUTS[1] : _CUTS[2]] = 1  # all texts have distances
    scaled = _scaled(rows, rarity)
    # the axes by the products of rows, which are fewer than the terms
    values, sides = np.linalg.eigh(scaled @ scaled.T)
    top = np.argsort(-values, kind="stable")[: min(dimensions, len(rows))]
    top = top[values[top] > 1e-9 * values.max()]
    axes = scaled.T @ (sides[:, top] / np.sqrt(values[top]))
    weights = np.where(good == 1, share / good.mean(), (1 - share) / (1 - good.mean()))
    return Model(rarity, axes, _unit(scaled @ axes), good, weights, share)


def score(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """The columns `keep` and the score of each row: the share of label 1 in its neighbours' votes."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 * EACH vectors, and TERMS rows of axes
    held = [f"k{i}" for i in range(len(keep))]
    chosen = docs.selectExpr(*[f"`{c}` as {h}" for c, h in zip(keep, held)], f"`{text}` as body")
    kinds = ", ".join(f"{c} {t}" for c, t in chosen.dtypes if c != "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            found = []
            for start in range(0, batch.num_rows, BLOCK):
                counts = np.array([terms(t) for t in texts_of(batch.column("body").slice(start, BLOCK))])
                found.append(known.vote(known.project(counts), neighbours))
            scores = np.clip(np.concatenate(found), 0, 1) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(h) for h in held], pa.array(scores, pa.float64())], names=[*held, "s"])

    return chosen.mapInArrow(released(run), f"{kinds}, s double").toDF(*keep, "score")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out("doc_id", 4, 2)))
    return score(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
