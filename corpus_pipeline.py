"""The corpus pipeline: its stages in order, each written as Parquet and read again as the next one's documents.

Language ID drops documents without a letter and those that no language claims: those with a smaller share of known
letter n-grams than labelled texts of the best language have (see langid), and those that score too little. The n-gram Jaccard
join (five words, 0.8) leaves the document with the least id of each group. Benchmark decontamination drops
documents that hold a benchmark window. Secret scans replace secrets in the text by a mark and set n_chars to the
new length. Byte-level BPE gives, for each document left, the number and digest of its ids, and the digest of the
bytes that they decode to.

Defined cases: a null or empty text has no letter and goes in the first stage, whatever its other columns hold; nulls in
id, lang, source or n_chars keep no document from any stage; of equal rows and of rows with equal texts one stays (the
second stage); of a group's documents with the least id, as ids may repeat, the one with the least hash stays; texts of
any length are taken whole; an empty table, or one without a labelled language, gives no rows; an empty benchmark drops
none; further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm import bpe, decontaminate, jaccard, langid, secrets
from trailspark.llm.common import shared_path, table

#: A text whose best language scores less is rejected; 0.5 is where a classifier is undecided. Unlike texts score about 0.5,
#: so this only meets texts that are torn between languages.
LEAST_SCORE = 0.3


#: Rows that a Python worker gets at once. A batch lies in the JVM's buffers and in the worker's memory, both of which keep
#: what they once needed, so that the widest batch of any stage counts for all that follow.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language claims; the model is fitted on the stage's own labelled rows. Null texts and those without a letter go."""
    _small_batches(spark)
    found = langid.identify(docs, langid.fit(docs), keep=tuple(docs.columns), claims=True)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & F.col("claimed") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, one with the least id; documents without words would all stay."""
    _small_batches(spark)
    return jaccard.keep_one(docs, n=5, num=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; null texts and an empty benchmark hit nothing."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark and n_chars as the text then has; a null text stays null. No row goes."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; null texts count as empty. No row goes."""
    import public_tokenizers

    _small_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, finish=bpe.digests, schema=bpe.DIGEST_SCHEMA)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("byte-level BPE encoding and decoding", byte_bpe),
]
#: The classifier of the first stage and the ids of the last have no SQL; tests/llm has a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
