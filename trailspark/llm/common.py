"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only a local session may do without, in a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts its lineage durably."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one computation in the shared folder, which can be deleted when nothing reads them any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, shared_path(spark, label)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, written under the name and read back."""
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables. What was computed from them must be written by now."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that path in the store that it names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def release() -> None:
    """Give memory that isn't in use any more back to the system: a Python worker serves other tasks after this one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def released(run):
    """run, for mapInArrow, with release() after each batch and at the end."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in run(batches):
                yield batch
                if batch.num_rows > 100:
                    release()
        finally:
            release()

    return inner


def texts_of(column: pa.Array, rows: int = 512) -> Iterator[str | None]:
    """The values of a column, not all of them as Python objects at once."""
    for start in range(0, len(column), rows):
        yield from column.slice(start, rows).to_pylist()


def small(held: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A stored table, with a hint to broadcast it if it has no more than the given number of rows."""
    return F.broadcast(held) if held.count() <= rows else held


def sized(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df, stored, with a hint to broadcast it if it has no more than the given number of rows."""
    return small(stored(df, "sized"), rows)
