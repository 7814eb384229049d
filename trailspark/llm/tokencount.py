"""Token counts of the documents in flat token files that have no index.

A file holds token ids of a fixed width, one document after another, each ended by the end-of-document id. Tasks
read blocks of the files as Spark splits them, search each block for the id's bytes with array comparisons, and
give the matches by their place in the block. A prefix sum over the blocks of a file then places them, drops
matches across two ids, numbers the documents, and finds where a document begins that an earlier block opened.

Blocks are Spark's own splits of a text source whose line separator is a byte that the end-of-document id does
not hold, so no match crosses a line or a block, and any store that Spark reads will do.

`write_tokens` writes files of bounded size, each in a folder of its own. The task that writes a file also writes,
in the same job, which documents are in it; so the two agree however the input is split, and if tasks run again.

Defined cases: a null text counts as empty, a document without tokens; what follows the last separator of a file
is a document too, if it isn't empty; a null id stays null; an empty table writes no token file and gives no rows;
texts of any length are encoded whole; columns other than the id and the text are not read. Whole ids are expected:
a file whose size isn't a multiple of the width ends in a partial id, which is not counted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailspark.llm.bpe import load_ranks
from trailspark.llm.common import exists, shared_path, table

#: Bytes that are searched at once.
CHUNK_BYTES = 4 << 20
#: Bytes and documents of a file that write_tokens writes, about.
FILE_BYTES, FILE_DOCUMENTS = 32 << 20, 100_000


def write_tokens(docs: DataFrame, path: str, ranks: str, pattern: str, *, doc: str = "doc_id", text: str = "text", end: int | None = None, width: int = 2) -> DataFrame:
    """Write the ids of each text, ended by the id `end` (by default the first free one), to flat files under path/kind=tokens.

    Returns (doc, piece, nth): which document is the nth of the file in which folder.
    """
    tokens = load_ranks(ranks)
    end = len(tokens) if end is None else end
    separator = end.to_bytes(width, "little")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(tokens)  # fixed size, about a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        coder = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(sent.value)}, special_tokens={})
        task, turn, names, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def file() -> pa.RecordBatch:
            # the writer ends each value with the separator
            values = [separator.join(held), json.dumps(names).encode()]
            return pa.RecordBatch.from_arrays([pa.array(["tokens", "order"]), pa.array([f"{task}x{turn}"] * 2), pa.array(values, pa.binary())], names=["kind", "piece", "value"])

        for batch in batches:
            for name, body in zip(*(batch.column(c).to_pylist() for c in ("doc", "body"))):
                names.append(name)
                held.append(coder.encode_to_numpy(body or "", disallowed_special=()).astype(f"<u{width}").tobytes())
                size += len(held[-1])
                if size > FILE_BYTES or len(held) >= FILE_DOCUMENTS:
                    yield file()
                    turn, names, held, size = turn + 1, [], [], 0
        if held:
            yield file()

    named = docs.select(F.col(doc).alias("doc"), F.col(text).alias("body"))
    kind = dict(named.dtypes)["doc"]
    flat = named.mapInArrow(run, "kind string, piece string, value binary")
    none = spark.range(1).select(F.lit("order").alias("kind"), F.lit("none").alias("piece"), F.lit(b"[]").alias("value"))
    whole = flat.unionByName(none).withColumn("value", F.col("value").cast("string"))
    whole.write.partitionBy("kind", "piece").option("encoding", "ISO-8859-1").option("lineSep", separator.decode("latin-1")).text(path)
    lists = spark.read.format("binaryFile").load(f"{path}/kind=order").select("piece", F.expr(f"substring(content, 1, length(content) - {width})").cast("string").alias("names"))
    return lists.select("piece", F.posexplode(F.from_json("names", f"array<{kind}>")).alias("nth", "doc")).select("doc", "piece", F.col("nth").cast("long").alias("nth"))


def _marker(end: bytes) -> bytes:
    """A byte to split on that the end-of-document id doesn't hold, a rare one if possible."""
    return next(bytes([b]) for b in range(127, 0, -1) if b not in end)


def _scan(end: bytes, marker: bytes):
    """For mapInArrow over (file, block, value): a row for each chunk of a block, with the places of the id's bytes."""

    def search(parts: list[bytes]) -> tuple[int, np.ndarray]:
        data = np.frombuffer(marker.join([*parts, b""]), np.uint8)
        last = len(data) - len(end) + 1
        hit = data[:last] == end[0]
        for i in range(1, len(end)):
            hit &= data[i : last + i] == end[i]
        return len(data), np.flatnonzero(hit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chunk, parts, size = None, 0, [], 0

        def row() -> pa.RecordBatch:
            length, found = search(parts)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, chunk, length, found), kinds)], names=["file", "block", "chunk", "size", "places"])

        for batch in batches:
            files, blocks, values = (c.to_pylist() for c in batch.columns)
            for file, block, value in zip(files, blocks, values):
                if parts and ((file, block) != key or size >= CHUNK_BYTES):
                    yield row()
                    chunk, parts, size = (chunk + 1 if (file, block) == key else 0), [], 0
                elif (file, block) != key:
                    chunk = 0
                key = (file, block)
                parts.append(value)
                size += len(value) + 1
        if parts:
            yield row()

    return run


def count_tokens(spark: SparkSession, path: str, end: int, *, width: int = 2) -> DataFrame:
    """(file, nth, start, n_tokens) for each document of the files under path; start counts ids, file is a folder and a name."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, nth long, start long, n_tokens long")
    mark = end.to_bytes(width, "little")
    marker = _marker(mark)
    name = lambda c: F.substring_index(c, "/", -2)
    lines = spark.read.option("lineSep", marker.decode("latin-1")).text(path)
    raw = lines.select(F.xxhash64(name(F.col("_metadata.file_path"))).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    chunks = raw.mapInArrow(_scan(mark, marker), "file long, block long, chunk long, size long, places array<long>")
    ordered = W.partitionBy("file").orderBy("block", "chunk")
    earlier = ordered.rowsBetween(W.unboundedPreceding, -1)
    based = chunks.withColumn("base", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    ends = based.withColumn("ends", F.transform(F.filter("places", lambda p: (p + F.col("base")) % width == 0), lambda p: p + F.col("base"))).drop("places")
    opened = ends.withColumns(
        {
            "first": F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0)),
            "open": F.coalesce(F.last(F.array_max("ends"), True).over(earlier) + width, F.lit(0)),
            "final": F.row_number().over(W.partitionBy("file").orderBy(F.desc("block"), F.desc("chunk"))) == 1,
        }
    )
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64(name(F.col("path"))).alias("file"), name(F.col("path")).alias("name"), "length")
    known = opened.join(files, "file")
    # the last chunk of a file also ends its last document, unless a separator did
    tail = F.when(F.col("final") & (F.coalesce(F.array_max("ends") + width, F.col("open")) < F.col("length") - F.col("length") % width), F.array(F.col("length") - F.col("length") % width))
    closed = known.withColumn("ends", F.concat("ends", F.coalesce(tail, F.array().cast("array<bigint>"))))
    starts = F.concat(F.array("open"), F.transform("ends", lambda e: e + width))
    docs = closed.withColumn("starts", starts).select("name", "first", F.posexplode(F.arrays_zip("ends", F.slice("starts", 1, F.size("ends")).alias("starts"))).alias("i", "d"))
    return docs.select(
        F.col("name").alias("file"),
        (F.col("first") + F.col("i")).cast("long").alias("nth"),
        (F.col("d.starts") / width).cast("long").alias("start"),
        ((F.col("d.ends") - F.col("d.starts")) / width).cast("long").alias("n_tokens"),
    )


def op9_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens: documents are written as flat token files, and counted in those."""
    import public_tokenizers

    path, ranks = shared_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    order = write_tokens(table(spark, sf_dir, "documents"), path, ranks, public_tokenizers.PATTERN)
    found = count_tokens(spark, f"{path}/kind=tokens", len(load_ranks(ranks)))
    parts = found.select(F.regexp_extract("file", "^piece=([^/]+)/", 1).alias("piece"), "nth", "n_tokens")
    return order.join(parts, ["piece", "nth"], "left").select(F.col("doc").alias("doc_id"), F.coalesce("n_tokens", F.raise_error(F.lit("a document has no place in the token files")).cast("long")).alias("n_tokens"))
