"""Tables of a fixed size that stand for a set or a count of hashes of any number; each may be broadcast."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import Scratch, released

#: Parts that a table is put together from, each by a task of its own.
_PARTS = 64


def bit_filter(hashes: DataFrame, column: str, bits: int = 27) -> np.ndarray:
    """2**bits packed bits; bit h & (2**bits - 1) is set for each hash h. False positives only."""
    each = (1 << bits) // _PARTS
    place = F.col(column).bitwiseAND((1 << bits) - 1)
    cells = hashes.select(F.shiftright(place, (each - 1).bit_length()).cast("int").alias("part"), place.bitwiseAND(each - 1).cast("int").alias("at")).distinct()

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(each, np.uint8)
        flags[group["at"].to_numpy()] = 1
        return pd.DataFrame({"part": [group["part"].iloc[0]], "data": [zlib.compress(np.packbits(flags).tobytes(), 1)]})

    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in cells.groupBy("part").applyInPandas(pack, "part int, data binary").collect():  # 2**bits / 8 bytes at most
        out[row["part"] * (each // 8) : (row["part"] + 1) * (each // 8)] = np.frombuffer(zlib.decompress(row["data"]), np.uint8)
    return out


def holds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes may be in the set."""
    at = hashes & np.uint64(len(table) * 8 - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


#: Parts of a table of counts, and hashes that a task counts before it sends them.
_COUNT_PARTS, _COUNTED = 256, 1 << 20


def count_levels(docs: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = 26) -> np.ndarray:
    """2**bits levels of four bits, two in a byte: the number of bits of the count of each cell, 15 at most.

    Counts all hashes h by h & (2**bits - 1). Tasks send sorted cells as differences, a byte or two for each hash; a
    part of the table is summed by one task, row by row. A task holds one part at a time, however many are dealt to it.
    """
    each = (1 << bits) // _COUNT_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            cells, counts = np.unique(np.concatenate(held) & np.uint64((1 << bits) - 1), return_counts=True)
            cuts = np.searchsorted(cells, np.arange(_COUNT_PARTS + 1, dtype=np.uint64) * np.uint64(each))
            parts = [i for i in range(_COUNT_PARTS) if cuts[i] < cuts[i + 1]]
            steps = np.diff(cells.astype(np.int64), prepend=np.int64(0))
            steps[cuts[parts]] = cells[cuts[parts]].astype(np.int64) % each
            steps, counts = steps.astype(np.uint32), counts.astype(np.uint32)
            data = [zlib.compress(steps[cuts[i] : cuts[i + 1]].tobytes() + counts[cuts[i] : cuts[i + 1]].tobytes(), 1) for i in parts]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

        for batch in batches:
            for found in hashes(batch):
                held.append(found)
                size += len(found)
                if size > _COUNTED:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(each, np.uint64)

        def flush() -> Iterator[pa.RecordBatch]:
            if now is not None:
                levels = np.minimum(15, np.ceil(np.log2(total.astype(np.float64) + 1))).astype(np.uint8)
                packed = zlib.compress((levels[::2] | (levels[1::2] << 4)).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([packed], pa.binary())], names=["part", "data"])

        for batch in batches:
            for part, data in zip(*batch.columns):
                if part.as_py() != now:
                    yield from flush()
                    now = part.as_py()
                    total[:] = 0
                both = np.frombuffer(zlib.decompress(data.as_buffer()), np.uint32)
                total[np.cumsum(both[: len(both) // 2], dtype=np.int64)] += both[len(both) // 2 :]
        yield from flush()

    schema = "part int, data binary"
    out = np.zeros((1 << bits) // 2, np.uint8)
    for row in docs.mapInArrow(released(count), schema).repartition("part").sortWithinPartitions("part").mapInArrow(released(add), schema).collect():  # 2**bits / 2 bytes at most
        out[row["part"] * (each // 2) : (row["part"] + 1) * (each // 2)] = np.frombuffer(zlib.decompress(bytes(row["data"])), np.uint8)
    return out


def level_of(levels: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The levels of the hashes' cells."""
    at = (hashes & np.uint64(2 * len(levels) - 1)).astype(np.int64)
    return (levels[at >> 1] >> ((at & 1) << 2).astype(np.uint8)) & 15


#: Bits of the codes that repeats are found by, and of the table that the repeated ones are sent out as.
CODE_BITS, TABLE_BITS = 40, 29


def codes(hashes: np.ndarray) -> np.ndarray:
    """The leading bits of unsigned hashes."""
    return hashes >> np.uint64(64 - CODE_BITS)


def _packed_codes(found: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted codes as differences, with their counts up to 255 in a byte and those above in full."""
    small = np.minimum(counts, 255).astype(np.uint8)
    head = np.array([len(found)], np.int64).tobytes()
    return zlib.compress(head + np.diff(found.astype(np.int64), prepend=np.int64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() + small.tobytes() + counts[small == 255].astype(np.int64).tobytes(), 1)


def _unpacked_codes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, 8).reshape(8, n).T).view("<u8").ravel()
    counts = np.frombuffer(data, np.uint8, n, 8 + 8 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.int64, -1, 8 + 9 * n)
    return np.cumsum(steps.astype(np.int64)), counts


def repeated_codes(docs: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], least: int = 1000, share: int = 10_000) -> tuple[np.ndarray, np.ndarray, int]:
    """A table for repeats(), the frequent codes, and the number of hashes whose code occurs again.

    Tasks send the sorted codes of their blocks as differences; each part of the codes' range is put together by a
    task of its own, in two rounds, so that no group holds a row of every block. Only codes that occur again go into
    the table, which has a fixed size. Frequent are those that occur more than `least` times and make up a `share`-th
    of all, `share` at most.
    """
    shift = CODE_BITS - (_PARTS - 1).bit_length()
    each = (1 << TABLE_BITS) // _PARTS
    schema = "part int, data binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            found, counts = np.unique(codes(np.concatenate(held)), return_counts=True)
            cuts = np.searchsorted(found, np.arange(_PARTS + 1, dtype=np.uint64) << np.uint64(shift))
            parts = [i for i in range(_PARTS) if cuts[i] < cuts[i + 1]]
            data = [_packed_codes(found[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]]) for i in parts]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

        for batch in batches:
            for found in hashes(batch):
                held.append(found)
                size += len(found)
                if size > 1 << 21:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def together(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        found, counts = (np.concatenate(x) for x in zip(*(_unpacked_codes(d) for d in group["data"])))
        order = np.argsort(found, kind="stable")
        found, counts = found[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        return found[first], np.add.reduceat(counts, first)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [group["part"].iloc[0]], "data": [_packed_codes(*together(group))]})

    def end(group: pd.DataFrame) -> pd.DataFrame:
        found, counts = together(group)
        found, counts = found[counts > 1], counts[counts > 1]
        flags = np.zeros(each, np.uint8)
        flags[(found >> (CODE_BITS - TABLE_BITS)) % each] = 1
        often = np.flatnonzero(counts > least)
        often = often[np.argsort(-counts[often], kind="stable")[:share]]
        head = np.array([counts.sum(), len(often), *found[often], *counts[often]], np.int64)
        return pd.DataFrame({"part": [group["part"].iloc[0]], "data": [zlib.compress(head.tobytes() + np.packbits(flags).tobytes(), 1)]})

    counted = docs.mapInArrow(released(count), schema).withColumn("turn", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(_PARTS)))
    sums = counted.groupBy("part", "turn").applyInPandas(add, schema).groupBy("part").applyInPandas(end, schema)
    bitmap, total, most = np.zeros((1 << TABLE_BITS) // 8, np.uint8), 0, []
    for row in sums.collect():  # 2**TABLE_BITS / 8 bytes at most
        data = zlib.decompress(bytes(row["data"]))
        size, n = np.frombuffer(data, np.int64, 2).tolist()
        found = np.frombuffer(data, np.int64, 2 * n, 16)
        total += size
        most.append((found[:n], found[n:]))
        bitmap[row["part"] * (each // 8) : (row["part"] + 1) * (each // 8)] = np.frombuffer(data, np.uint8, offset=16 * (n + 1))
    hot = [found[counts > total // share] for found, counts in most]
    return bitmap, np.sort(np.concatenate(hot)).astype(np.uint64) if hot else np.zeros(0, np.uint64), total


def repeats(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may have a code that occurs again, by the table of repeated_codes()."""
    at = codes(hashes) >> np.uint64(CODE_BITS - TABLE_BITS)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node of the edges (a, b): the least node that it is connected to.

    Labels pass along edges and jump to their label's label until none changes. Both sides of every join are stored
    tables, so that Spark can split the rows of a hub or of a large component's label over tasks.
    """
    held = Scratch(edges.sparkSession, label)
    both = held.table(edges.union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct(), "edges")
    start = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component"))
    turn, now = 0, held.table(start, "labels-0")
    while True:
        turn += 1
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        near = held.table(near, f"near-{turn}")
        met = now.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        met = held.table(met, f"met-{turn}")
        jumped = met.join(met.select(F.col("node").alias("component"), F.col("component").alias("far")), "component", "left")
        new = held.table(jumped.select("node", "old", F.least("component", F.coalesce("far", "component")).alias("component")), f"labels-{turn}")
        changed = new.where(F.col("old") != F.col("component")).limit(1).count()
        held.drop(f"near-{turn}", f"met-{turn}", f"labels-{turn - 1}")
        now = new.drop("old")
        if not changed:
            held.drop("edges")
            return now


def unsigned(column) -> np.ndarray:
    """A column of longs as unsigned numbers."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def row_key(*columns: str) -> Column:
    return F.xxhash64(*columns)
