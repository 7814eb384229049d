"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams, of one to three characters, that both hold (a
blended spectrum of presence bits), over the root of the product of their own numbers. Nyström landmarks turn it
into features; kernel ridge regression, one language against the rest, is fitted on them. A score is a product
of the presence bits of a text with the landmarks' bits and of that with the coefficients; both factors to the
right are fixed once the model is fitted, so they are multiplied beforehand, and batches of texts are scored by
one matrix product.

The model is fitted on a bounded, documented sample of labelled rows; every row is scored, by its whole text.

A score tells languages apart, not whether a text is in any of them: a text unlike all that was fitted on scores
about 0.5. For that there is the share of a text's letter n-grams that the sample's rows of any language hold.
Each language asks for a share that its own sampled rows, each left out of the counts, reach but for a few.

Defined cases: a null text, or one without a letter, is `und` with score 0; a null language is not learned from;
each of several equal rows is scored alike; columns other than those asked for are not read; an empty table gives
no rows; without a labelled row every text is `und`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailspark.llm.common import released, table
from trailspark.llm.ngrams import present

MOST, BITS = 3, 15
#: Labelled texts that are fitted on, landmarks among them, and the ridge per text.
SAMPLE, LANDMARKS, RIDGE = 2000, 256, 1e-3
UNKNOWN = "und"
#: An n-gram is known if this part of a language's sampled rows hold it. What a text has to reach: SLACK times the
#: share that all but STRAY of the sampled rows of its language reach.
OFTEN, STRAY, SLACK = 0.02, 0.005, 0.9
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
#: Keys and numbers, which are in no language: runs of letters and digits with a digit.
_MIXED = regex.compile(r"(?<![\p{L}\p{M}\p{N}])[\p{L}\p{M}]*+\p{N}[\p{L}\p{M}\p{N}]*+")
_BATCH = 32


@dataclass
class Model:
    """languages, and for each n-gram number the weight of each language; known n-grams, and the share each language asks for."""

    languages: list[str]
    weights: np.ndarray
    known: np.ndarray
    least: np.ndarray


def _letters(text: str) -> np.ndarray:
    """The n-grams of a text's words without digits (of all its letters if it has none), with one space for all between."""
    text = text.lower()
    words = _OTHER.sub(" ", _MIXED.sub(" ", text))
    return present(words if words.strip() else _OTHER.sub(" ", text), 1, MOST, BITS)


def _sample(docs: DataFrame, lang: str, text: str, key: str, sample: int) -> list:
    """Rows (lang, place, bits, letters): sample / number of languages of each at most, chosen by a hash of key and text."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}  # a row for each language
    if not counts:
        return []
    each = max(1, sample // len(counts))
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 1.2 * each / n))])
    # a fine place, so that the sample doesn't grow with the table; equal rows count once, so that no row fills it
    place = F.shiftrightunsigned(F.xxhash64(F.lit("language sample"), F.col(key).cast("string"), F.col(text)), 11)
    chosen = known.where(place < F.element_at(share, F.col(lang)) * float(1 << 53)).groupBy(F.col(lang).alias("lang"), place.alias("place")).agg(F.min(text).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("body").to_pylist()
            bits = [np.packbits(present(t.lower(), 1, MOST, BITS)).tobytes() for t in texts]
            letters = [np.packbits(_letters(t)).tobytes() if _LETTER.search(t) else None for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array(bits, pa.binary()), pa.array(letters, pa.binary())], names=["lang", "place", "bits", "letters"])

    found = chosen.mapInArrow(released(run), "lang string, place long, bits binary, letters binary")
    first = F.row_number().over(W.partitionBy("lang").orderBy("place"))  # at most `each` rows of a language come to the driver
    rows = found.withColumn("first", first).where(F.col("first") <= each).collect()
    return sorted(rows, key=lambda r: (r.lang, r.place))


def _claims(rows: list, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(known, least): which n-grams are known, and the share of them that each language asks for."""
    groups = [[r.letters for r in rows if r.lang == k and r.letters is not None] for k in languages]
    unpacked = lambda b: np.unpackbits(np.frombuffer(b, np.uint8))
    counts = np.zeros((len(languages), 1 << BITS), np.int64)
    for k, group in enumerate(groups):
        for b in group:
            counts[k] += unpacked(b)
    needs = np.array([max(1.0, OFTEN * len(g)) for g in groups])[:, None]
    enough, least = counts >= needs, np.zeros(len(languages))
    for k, group in enumerate(groups):
        others = np.delete(enough, k, axis=0).any(0)
        shares = []
        for b in group:
            own = unpacked(b).astype(bool)
            shares.append((others | (counts[k] - 1 >= needs[k]))[own].mean())
        if shares:
            least[k] = SLACK * np.quantile(shares, STRAY, method="lower")
    return enough.any(0), least


def _landmarks(rows: list, landmarks: int) -> list:
    """At most that many rows, the languages taking turns for as long as they have any."""
    turn, order = Counter(), []
    for i, r in enumerate(rows):
        order.append((turn[r.lang], i))
        turn[r.lang] += 1
    return [rows[i] for _, i in sorted(order)[:landmarks]]


def fit(docs: DataFrame, *, lang: str = "lang", text: str = "text", key: str = "doc_id", sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on at most about `sample` rows of docs with a language; `landmarks` of them, spread over the languages."""
    rows = _sample(docs, lang, text, key, sample)
    languages = sorted({r.lang for r in rows})
    if not rows:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(1 << BITS, bool), np.zeros(0))
    bits = lambda some: np.unpackbits(np.array([np.frombuffer(r.bits, np.uint8) for r in some]), axis=1)
    marks = bits(_landmarks(rows, landmarks)).astype(np.float32)
    marks /= np.sqrt(np.maximum(1, marks.sum(1, keepdims=True)))
    kernel = []
    for i in range(0, len(rows), 128):
        part = bits(rows[i : i + 128]).astype(np.float32)
        kernel.append(part @ marks.T / np.sqrt(np.maximum(1, part.sum(1, keepdims=True))))
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    features = np.concatenate(kernel).astype(np.float64) @ whiten
    targets = np.array([[1.0 if r.lang == k else -1.0 for k in languages] for r in rows])
    solved = np.linalg.solve(features.T @ features + ridge * len(rows) * np.eye(len(whiten)), features.T @ targets)
    return Model(languages, (marks.T @ (whiten @ solved)).astype(np.float32), *_claims(rows, languages))


def identify(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", claims: bool = False) -> DataFrame:
    """The columns `keep`, lang_pred and score (0 to 1: half of one plus the best language's score) of each row.

    With claims, also claimed: whether the text has as large a share of known letter n-grams as lang_pred asks for.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**15 weights a language
    held = [f"k{i}" for i in range(len(keep))]
    chosen = docs.selectExpr(*[f"`{c}` as {h}" for c, h in zip(keep, held)], f"`{text}` as body")
    kinds = ", ".join(f"{c} {t}" for c, t in chosen.dtypes if c != "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            texts = [t if known.languages and t and _LETTER.search(t) else None for t in batch.column("body").to_pylist()]
            names, scores, claimed = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
            at = [i for i, t in enumerate(texts) if t]
            for start in range(0, len(at), _BATCH):
                some = at[start : start + _BATCH]
                bits = np.stack([present(texts[i].lower(), 1, MOST, BITS) for i in some]).astype(np.float32)
                found = bits @ known.weights / np.sqrt(bits.sum(1, keepdims=True))
                best = found.argmax(1)
                for i, k, s in zip(some, best.tolist(), found[np.arange(len(some)), best].tolist()):
                    names[i], scores[i] = known.languages[k], min(1.0, max(0.0, (1 + s) / 2))
                    if claims:
                        claimed[i] = bool(known.known[_letters(texts[i])].mean() >= known.least[k])
            yield pa.RecordBatch.from_arrays([*[batch.column(h) for h in held], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(claimed, pa.bool_())], names=[*held, "l", "s", "c"])

    found = chosen.mapInArrow(released(run), f"{kinds}, l string, s double, c boolean").toDF(*keep, "lang_pred", "score", "claimed")
    return found if claims else found.drop("claimed")


def held_out(key, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id", 4, 2)))
    found = identify(docs, model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
