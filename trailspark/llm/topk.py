"""Exact top-k inner-product search with ball trees.

Candidates are dealt into shards of bounded size; a task builds a ball tree over each, once, and stores it. Queries
are packed into blocks of bounded size. A unit is a block of queries and every so many-th shard; its trees are
streamed past its queries. A query takes the leaves of a tree in order of its own upper bound of the inner product
(that with the centre plus radius times norm); leaves and branches that can't reach its k-th best so far are left
out, and again as that rises. The k-th best is shared: every query starts from its k best among a small common set of
candidates, and carries what it has from tree to tree. The best of all units are merged by partial top-k.

Trees and blocks are tables in the shared folder; no vector passes through the driver, and nothing is broadcast.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a null
id; vectors of different lengths are never compared; ties go to the smaller id, and of rows of one id each takes
part, as a candidate and as a query of its own; a query is never its own candidate, by id; fewer candidates give
fewer results; scores are exact if they fit a long; columns other than those asked for are not read; empty tables
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailspark.llm.common import Scratch, sized, table

#: Candidates in a shard, points in a leaf, and queries in a block.
SHARD_ROWS, LEAF, BLOCK = 8192, 64, 2048
#: Candidates that every query is first compared with.
COMMON = 512
_EXACT = float(1 << 52)
_NOTHING = np.iinfo(np.int64).min


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of whole numbers, exact if they fit a long."""
    if a.shape[1] == 0 or np.abs(a).max(initial=0) * float(np.abs(b).max(initial=0)) * a.shape[1] < _EXACT:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T  # of longs, so without a detour through doubles


def _below(scores: np.ndarray) -> np.ndarray:
    """Doubles a little below the scores, so that rounding loses nothing."""
    scores = scores.astype(np.float64)
    return scores - 1e-12 * np.abs(scores)


class BallTree:
    """Nodes as arrays; a node's points are a run of `points`. Leaves have left -1."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        places = points.astype(np.float64)
        order = np.argsort(ids, kind="stable")
        nodes: list[tuple[int, int, int, int]] = []
        todo = [(0, len(ids), -1, False)]
        while todo:
            lo, hi, parent, right = todo.pop()
            at = len(nodes)
            if parent >= 0:
                a, b, c, d = nodes[parent]
                nodes[parent] = (a, b, c, at) if right else (a, b, at, d)
            nodes.append((lo, hi, -1, -1))
            if hi - lo > LEAF:
                some = places[order[lo:hi]]
                far = some[((some - some.mean(0)) ** 2).sum(1).argmax()]
                other = some[((some - far) ** 2).sum(1).argmax()]
                along = some @ (other - far)
                if along.min() < along.max():  # equal points stay together
                    cut = (hi - lo) // 2
                    order[lo:hi] = order[lo:hi][np.argsort(along, kind="stable")]
                    todo += [(lo + cut, hi, at, True), (lo, lo + cut, at, False)]
        self.nodes = np.array(nodes, np.int64)
        self.ids, self.points = ids[order], points[order]
        places = places[order]
        self.centres = np.array([places[lo:hi].mean(0) for lo, hi, *_ in nodes])
        self.radii = np.array([np.sqrt(((places[lo:hi] - c) ** 2).sum(1).max()) for (lo, hi, *_), c in zip(nodes, self.centres)])

    def packed(self) -> dict[str, bytes]:
        return {k: np.ascontiguousarray(v).tobytes() for k, v in vars(self).items()}

    @classmethod
    def unpacked(cls, length: int, data: dict[str, bytes]) -> BallTree:
        self = object.__new__(cls)
        self.nodes = np.frombuffer(data["nodes"], np.int64).reshape(-1, 4)
        self.ids, self.radii = np.frombuffer(data["ids"], np.int64), np.frombuffer(data["radii"], np.float64)
        self.points = np.frombuffer(data["points"], np.int64).reshape(len(self.ids), length)
        self.centres = np.frombuffer(data["centres"], np.float64).reshape(len(self.nodes), length)
        return self

    def search(self, block: Queries) -> None:
        """Improve the block's best. Each query goes through the leaves in the order of its own bounds, a round each."""
        bounds = block.places @ self.centres.T + block.norms[:, None] * self.radii[None, :]
        bounds += 1e-9 * np.abs(bounds) + 1e-6  # rounding
        live = np.zeros(bounds.shape, bool)
        live[:, 0] = bounds[:, 0] >= block.kth
        for i, (_, _, left, right) in enumerate(self.nodes.tolist()):
            if left >= 0:  # branches that a query can't gain from fall away with all below them
                for child in (left, right):
                    live[:, child] = live[:, i] & (bounds[:, child] >= block.kth)
        leaves = np.flatnonzero(self.nodes[:, 2] < 0)
        bounds = np.where(live[:, leaves], bounds[:, leaves], -np.inf)
        order = np.argsort(-bounds, axis=1, kind="stable")
        asking = np.flatnonzero(np.isfinite(bounds).any(1))
        for turn in range(len(leaves)):
            mine = order[asking, turn]
            asking = asking[bounds[asking, mine] >= np.maximum(block.kth[asking], -np.finfo(float).max)]
            if not len(asking):
                return
            mine = order[asking, turn]
            by_leaf = np.argsort(mine, kind="stable")
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(mine[by_leaf])) + 1, [len(by_leaf)]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                rows = asking[by_leaf[lo:hi]]
                first, last = self.nodes[leaves[mine[by_leaf[lo]]], :2].tolist()
                for at in range(first, last, 4096):  # equal points may fill a leaf beyond its size
                    part = slice(at, min(at + 4096, last))
                    block.add(rows, self.ids[part], products(block.vectors[rows], self.points[part]))


class Queries:
    """A block of queries with their best scores so far; `kth` is what a candidate has to reach."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, common_ids: np.ndarray, common: np.ndarray, k: int):
        self.ids, self.vectors, self.places = ids, vectors, vectors.astype(np.float64)
        self.norms = np.sqrt((self.places**2).sum(1))
        self.scores = np.full((len(ids), k), _NOTHING)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.filled = np.zeros(len(ids), np.int64)
        self.floor = np.full(len(ids), -np.inf)
        if len(common_ids) > k:
            # the k-th best of the common set, which are candidates too, so that a tie with it must get in
            start = products(vectors, common)
            start[ids[:, None] == common_ids[None, :]] = _NOTHING
            kth = np.sort(start, 1)[:, -k]
            self.floor = np.where(kth == _NOTHING, -np.inf, _below(kth))
        self.kth = self.floor.copy()

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        k = self.scores.shape[1]
        good = (scores >= self.kth[rows][:, None]) & (self.ids[rows][:, None] != ids[None, :])
        gain = good.any(1)
        rows, good, scores = rows[gain], good[gain], scores[gain]
        if not len(rows):
            return
        every = np.concatenate([self.scores[rows], np.where(good, scores, _NOTHING)], 1)
        names = np.concatenate([self.found[rows], np.where(good, ids[None, :], np.iinfo(np.int64).max)], 1)
        empty = np.concatenate([np.arange(k)[None, :] >= self.filled[rows][:, None], ~good], 1)
        order = np.lexsort((names, ~every, empty), axis=1)[:, :k]  # ~x orders longs downwards without an overflow
        self.scores[rows], self.found[rows] = np.take_along_axis(every, order, 1), np.take_along_axis(names, order, 1)
        self.filled[rows] = np.minimum(k, self.filled[rows] + good.sum(1))
        full = rows[self.filled[rows] == k]
        self.kth[full] = np.maximum(self.floor[full], _below(self.scores[full, k - 1]))


def _matrix(column) -> np.ndarray:
    """Lists of longs of one length as a matrix."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(column[0]) if len(column) else 0)


_TREE = ("ids", "points", "nodes", "centres", "radii")


def _plant(part: pa.Table) -> pa.Table:
    """For applyInArrow by length and shard: the shard's tree."""
    tree = BallTree(part.column("id").to_numpy(), _matrix(part.column("vector"))).packed()
    row = {"length": part.column("length")[0].as_py(), "shard": part.column("shard")[0].as_py(), **tree}
    return pa.table({k: pa.array([row[k]], pa.int64() if k in ("length", "shard") else pa.binary()) for k in ("length", "shard", *_TREE)})


def _packed(names: tuple[str, str, str, str]):
    """For applyInArrow: a group's rows (id, number, vector) as one row of bytes."""

    def pack(part: pa.Table) -> pa.Table:
        length, key = (part.column(c)[0].as_py() for c in names[:2])
        ids, vectors = part.column("id").to_numpy(), _matrix(part.column("vector"))
        numbers = part.column("number").to_numpy()
        return pa.table({names[0]: [length], names[1]: [key], names[2]: pa.array([ids.tobytes() + numbers.tobytes()], pa.binary()), names[3]: pa.array([vectors.tobytes()], pa.binary())})

    return pack


def top_k(candidates: DataFrame, queries: DataFrame, k: int, *, shard_rows: int = SHARD_ROWS, block: int = BLOCK, common: int = COMMON) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query. Both tables: (id long, vector array<long>)."""
    spark = candidates.sparkSession
    held = Scratch(spark, "topk")
    # the numbers that deal rows are written with them, so that they stay as they are; equal rows get different ones
    numbered = lambda df: df.select("id", "vector", F.size("vector").cast("long").alias("length"), F.monotonically_increasing_id().alias("number"))
    points, asked = held.table(numbered(candidates), "points"), held.table(numbered(queries), "queries")

    def dealt(df: DataFrame, rows: int, name: str) -> tuple[DataFrame, DataFrame]:
        parts = sized(df.groupBy("length").agg(F.ceil(F.count("*") / rows).alias(f"{name}s")))
        return df.join(parts, "length").withColumn(name, F.pmod(F.xxhash64(F.lit(name), "number"), F.col(f"{name}s"))), parts

    sharded, shards = dealt(points, shard_rows, "shard")
    blocked, blocks = dealt(asked, block, "block")
    kinds = ", ".join(f"{c} binary" for c in _TREE)
    trees = held.table(sharded.select("length", "shard", "id", "vector").groupBy("length", "shard").applyInArrow(_plant, f"length long, shard long, {kinds}"), "trees")
    packed = blocked.select("length", "block", "id", "number", "vector").groupBy("length", "block").applyInArrow(_packed(("length", "block", "ids", "points")), "length long, block long, ids binary, points binary")
    first = F.row_number().over(W.partitionBy("length").orderBy(F.xxhash64(F.lit("common"), "number"), "number"))
    some = points.withColumn("first", first).where(F.col("first") <= common).withColumn("one", F.lit(0).cast("long"))
    some = some.select("length", "one", "id", "number", "vector").groupBy("length", "one").applyInArrow(_packed(("length", "one", "nodes", "centres")), "length long, one long, nodes binary, centres binary")
    # a block meets every shard of its length: in as many units as keep all cores busy, each with every so many-th shard
    wanted = 2 * spark.sparkContext.defaultParallelism
    meeting = sized(shards.join(blocks, "length").withColumn("lanes", F.least("shards", F.greatest(F.lit(1), F.ceil(F.lit(wanted) / F.col("blocks"))))))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    none = F.lit(None).cast("binary")
    asking = packed.join(some.drop("one"), "length").join(meeting, "length").select("length", "block", each("lanes").alias("lane"), F.lit(-1).cast("long").alias("shard"), "ids", "points", "nodes", "centres", none.alias("radii"))
    growing = trees.join(meeting, "length").select("length", each("blocks").alias("block"), F.pmod("shard", "lanes").alias("lane"), "shard", *_TREE)
    units = asking.union(growing).repartition("length", "block", "lane").sortWithinPartitions("length", "block", "lane", "shard")
    found = held.table(units.mapInArrow(_search(k), "number long, query_id long, vec_id long, score long"), "found")
    place = F.row_number().over(W.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(k: int):
    """For mapInArrow over units: a block of queries, then trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, numbers = None, None

        def close() -> pa.RecordBatch:
            rows, at = np.nonzero(np.arange(k)[None, :] < block.filled[:, None])
            columns = numbers[rows], block.ids[rows], block.found[rows, at], block.scores[rows, at]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["number", "query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                length = value("length")
                if value("shard") < 0:
                    if block:
                        yield close()
                    ids, numbers = np.frombuffer(value("ids"), np.int64).reshape(2, -1)
                    common = np.frombuffer(value("nodes"), np.int64).reshape(2, -1)[0]
                    vectors, near = np.frombuffer(value("points"), np.int64), np.frombuffer(value("centres"), np.int64)
                    block = Queries(ids, vectors.reshape(len(ids), length), common, near.reshape(len(common), length), k)
                else:
                    BallTree.unpacked(length, {c: value(c) for c in _TREE}).search(block)
        if block:
            yield close()

    return run


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite))
    whole = rows.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(F.lit(64) * x.cast("double"))).alias("vector"))
    return top_k(whole, whole.where(F.col("id") % 20 == 0), 20)


OP7_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
