"""Places of records in files that many tasks read: line numbers, previous lines, running sums and facts carried forward.

Each works in two passes. The first gives a row for each block or chunk of a file, the second adds what came before it
to what is known within it, so that no task has to hold or stream a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lines of a chunk, and rows of the table of blocks that are sent to every task at most.
CHUNK, BLOCKS_SENT = 1 << 20, 200_000


def number_rows(rows: DataFrame, by: str, block: str, at: str, name: str) -> DataFrame:
    """Numbers the rows of each file from 1. block: where the split begins that a row comes from; at: a number that grows by one a row within it.

    A row for each split is counted first. Beyond BLOCKS_SENT splits the second pass joins by a shuffle.
    """
    seen = rows.groupBy(by, block).agg(F.min(at).alias("_first"), F.count("*").alias("_n"))
    earlier = W.partitionBy(by).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    base = seen.select(by, block, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_base"))
    few = base.limit(BLOCKS_SENT + 1).collect()
    if len(few) <= BLOCKS_SENT:
        base = F.broadcast(rows.sparkSession.createDataFrame(few, base.schema))
    return rows.join(base, [by, block]).withColumn(name, F.col(at) + F.col("_base")).drop("_base", block, at)


def _chunked(rows: DataFrame, order: str, size: int | None) -> DataFrame:
    return rows.withColumn("_chunk", F.floor(F.col(order) / (size or CHUNK)))


def _from_before(rows: DataFrame, by: str, edges: dict[str, Column], over: dict) -> DataFrame:
    """Adds to each row what the chunks before its own say; edges: of a chunk, over: of the chunks before."""
    told = rows.groupBy(by, "_chunk").agg(*[v.alias(k) for k, v in edges.items()])
    before = W.partitionBy(by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    return rows.join(told.select(by, "_chunk", *[f(F.col(k)).over(before).alias(k) for k, f in over.items()]), [by, "_chunk"])


def previous(rows: DataFrame, value: Column, name: str, by: str = "path", order: str = "line_no", size: int | None = None) -> DataFrame:
    """Adds the value of the row before, null in a file's first one."""
    chunks = _chunked(rows.withColumn("_value", F.struct(value.alias("v"))), order, size)
    known = _from_before(chunks, by, {"_edge": F.max_by("_value", order)}, {"_edge": F.last})
    here = F.lag("_value").over(W.partitionBy(by, "_chunk").orderBy(order))
    return known.withColumn(name, F.coalesce(here, F.col("_edge"))["v"]).drop("_value", "_edge", "_chunk")


def running_sum(rows: DataFrame, value: Column, name: str, by: str = "path", order: str = "line_no", size: int | None = None) -> DataFrame:
    """Adds the sum of the values up to a row, its own included."""
    chunks = _chunked(rows.withColumn("_value", value.cast("long")), order, size)
    known = _from_before(chunks, by, {"_edge": F.sum("_value")}, {"_edge": F.sum})
    here = F.sum("_value").over(W.partitionBy(by, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return known.withColumn(name, here + F.coalesce("_edge", F.lit(0))).drop("_value", "_edge", "_chunk")


def carry_forward(rows: DataFrame, facts: dict[str, Column], by: str = "path", order: str = "line_no", size: int | None = None) -> DataFrame:
    """Adds the last value of each fact up to a row that isn't null."""
    chunks = _chunked(rows.withColumns({f"_f{i}": v for i, v in enumerate(facts.values())}), order, size)
    names = [f"_f{i}" for i in range(len(facts))]
    last = {f"_e{i}": F.max_by(n, F.when(F.col(n).isNotNull(), F.col(order))) for i, n in enumerate(names)}
    known = _from_before(chunks, by, last, {k: lambda c: F.last(c, ignorenulls=True) for k in last})
    here = W.partitionBy(by, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = {k: F.coalesce(F.last(n, ignorenulls=True).over(here), F.col(e)) for k, n, e in zip(facts, names, last)}
    return known.withColumns(found).drop(*names, *last, "_chunk")


def runs(rows: DataFrame, same: Column | None = None, opens: Column | None = None, name: str = "run", by: str = "path", order: str = "line_no", size: int | None = None) -> DataFrame:
    """Numbers runs of rows. same: a value, and a run is as long as it stays the same; or opens: whether a row begins one."""
    if same is not None:
        rows = previous(rows.withColumn("_same", same), F.col("_same"), "_before", by, order, size)
        rows, opens = rows.withColumn("_opens", ~F.coalesce(F.col("_same") == F.col("_before"), F.lit(False))).drop("_same", "_before"), F.col("_opens")
    return running_sum(rows, opens.cast("int"), name, by, order, size).drop("_opens")


def texts_of_runs(rows: DataFrame, keys: list[str], between: str = "\n", order: str = "line_no", **more: Column) -> DataFrame:
    """A row for each run: its first line as `first_line`, its lines as `text`, and more."""
    lines = F.array_sort(F.collect_list(F.struct(order, "text")))
    joined = F.array_join(F.transform(lines, lambda x: x["text"]), between)
    return rows.groupBy(*keys).agg(F.min(order).alias("first_line"), joined.alias("text"), *[v.alias(k) for k, v in more.items()])
