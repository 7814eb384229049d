"""Ranked lexical search: exact inner products of sparse vectors by ball trees.

Documents are taken apart into terms once. Of each the number of its terms and the counts of those terms that some query
has are kept, so that the corpus isn't read again and vectors have only the coordinates that can score. Sums over all
documents give N, L and every term's df, and with them a term's integer impact in a document times the term's weight.

A task takes shards of bounded size of these vectors. Over each it grows a ball tree for a block of queries, in the
block's own coordinates; every node has the centre of its vectors and the radius of the ball around it. What a query can
score in a node is at most its product with the centre plus the radius times its own length, rounded up so that no
rounding loses a result. A query takes leaves in the order of this bound, the best first; leaves and branches below its
k-th best score so far fall away, and again as that score rises. Vectors in a leaf are scored in whole numbers. What a
query has found goes on from shard to shard, and all queries start from their k-th best score in a bounded sample of the
documents, which are candidates too. The best of all tasks are merged by partial top-k.

Queries whose terms exceed `PAIRS` are taken in several rounds, each with its own pass over the documents, so that what is
broadcast has a bound. No vector passes the driver, and none is shuffled.

Defined cases: null and empty texts have no terms, and score nothing as documents or queries; a document without an id
counts in N, L and df but can't be a result; each of several documents of one id is a result of its own, and so is each
of several queries of one id, or of none, a query; equal scores go to the smaller id, those of one id in any order (they
don't differ); texts of any length are taken whole; scores are exact if they fit a long; columns other than those asked
for are not read; empty tables give no rows.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailspark.llm.common import Scratch, released, stored, table

#: Different (query, term) pairs of one round; queries of a block, and the cells of a shard's matrix.
PAIRS, BLOCK_QUERIES, BLOCK_TERMS, CELLS = 1 << 19, 256, 8192, 4 << 20
#: Vectors in a shard and in a leaf, and documents of the sample that all queries start from.
SHARD_ROWS, LEAF, COMMON = 1024, 32, 1024
#: The ranking function's constants, in hundredths and whole numbers.
B_PART, SATURATION, UNIT = 75, 8, 1_000_000_000
_EXACT = float(1 << 53)
#: Bytes of a term once A-Z are lowered; all bytes of characters beyond ASCII are such.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM).split()


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (number, term, times) for each query and term."""
    for batch in batches:
        rows = [(n, t, c) for n, body in zip(batch.column("number").to_pylist(), batch.column("body").to_pylist()) for t, c in sorted(Counter(terms_of(body)).items())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64()))], names=["number", "term", "times"])


def _vectors(places):
    """For mapInArrow: each document's number of terms, and the places and counts of those that a query has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = places.value
        for batch in batches:
            sizes, at, times = [], [], []
            for body in batch.column("body"):
                found = Counter(terms_of(body.as_py()))
                sizes.append(sum(found.values()))
                mine = sorted((known[t], found[t]) for t in found.keys() & known.keys())
                at.append([p for p, _ in mine])
                times.append([c for _, c in mine])
            columns = [batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "places", "times"])

    return run


class Block:
    """Queries with their coordinates, vectors (how often each has a term) and best results; `kth` is what a document has to reach."""

    def __init__(self, numbers: np.ndarray, columns: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int):
        self.numbers, self.columns, self.vectors, self.k = numbers, columns, vectors, k
        self.lengths = np.sqrt((vectors**2).sum(1))
        self.scores, self.found = np.zeros((len(numbers), k), np.int64), np.zeros((len(numbers), k), np.int64)  # a score of 0 is none
        self.kth = np.maximum(1, floor)

    def narrowed(self, columns: np.ndarray) -> Block:
        """The block with some of its coordinates, for vectors that have no others; its results are the block's own."""
        view = copy.copy(self)
        view.vectors = self.vectors[:, columns]
        view.lengths = np.sqrt((view.vectors**2).sum(1))
        return view

    def add(self, rows: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        """Take the scores of documents by those queries."""
        good = scores >= self.kth[rows][:, None]
        gain = good.any(1)
        rows, scores = rows[gain], np.where(good, scores, 0)[gain]
        if not len(rows):
            return
        every = np.concatenate([self.scores[rows], scores], 1)
        names = np.concatenate([self.found[rows], np.broadcast_to(docs, scores.shape)], 1)
        order = np.lexsort((names, -every), axis=1)[:, : self.k]
        self.scores[rows], self.found[rows] = np.take_along_axis(every, order, 1), np.take_along_axis(names, order, 1)
        self.kth[rows] = np.maximum(self.kth[rows], self.scores[rows, self.k - 1])


class BallTree:
    """A tree over the rows of a matrix of whole numbers. Nodes are (first, last, left, right) of the ordered rows; leaves have left -1."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order, nodes, centres, radii = np.arange(len(points)), [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][side] = at
            some = points[order[lo:hi]]
            centre = some.mean(0)
            away = ((some - centre) ** 2).sum(1)
            nodes.append([lo, hi, -1, -1])
            centres.append(centre)
            radii.append(np.sqrt(away.max()))
            if hi - lo > leaf and radii[-1] > 0:
                far = some[away.argmax()]
                other = some[((some - far) ** 2).sum(1).argmax()]
                cut = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argsort(some @ (other - far), kind="stable")]
                todo += [(lo + cut, hi, at, 3), (lo, lo + cut, at, 2)]
        self.order, self.nodes, self.centres, self.radii = order, np.array(nodes), np.array(centres), np.array(radii)

    def bounds(self, block: Block) -> np.ndarray:
        """The most that each query can score in each node. All numbers are non-negative, so products err by a small share only."""
        found = block.vectors @ self.centres.T + block.lengths[:, None] * self.radii
        return found * (1 + 1e-9) + 1

    def search(self, points: np.ndarray, docs: np.ndarray, block: Block, exact: bool) -> int:
        """Improve the block's best by the tree's rows; the number of (query, leaf) pairs that were scored."""
        bounds = self.bounds(block)
        live = np.zeros(bounds.shape, bool)
        live[:, 0] = bounds[:, 0] >= block.kth
        for i, (_, _, left, right) in enumerate(self.nodes.tolist()):
            if left >= 0:  # what a query can't gain from falls away with all below it
                for child in (left, right):
                    live[:, child] = live[:, i] & (bounds[:, child] >= block.kth)
        leaves = np.flatnonzero(self.nodes[:, 2] < 0)
        bounds = np.where(live[:, leaves], bounds[:, leaves], -1.0)
        order, asking, opened = np.argsort(-bounds, axis=1, kind="stable"), np.flatnonzero((bounds >= 0).any(1)), 0
        for turn in range(len(leaves)):
            asking = asking[bounds[asking, order[asking, turn]] >= block.kth[asking]]
            if not len(asking):
                break
            opened += len(asking)
            mine = order[asking, turn]
            for leaf in np.unique(mine):
                rows = asking[mine == leaf]
                first, last = self.nodes[leaves[leaf], :2]
                own = self.order[first:last]
                block.add(rows, docs[own], _scores(block.vectors[rows], points[own], exact))
        return opened


def _scores(queries: np.ndarray, points: np.ndarray, exact: bool) -> np.ndarray:
    """Products of whole numbers; doubles hold them if they are exact."""
    return np.rint(queries @ points.T).astype(np.int64) if exact else queries.astype(np.int64) @ points.astype(np.int64).T


def impacts(times: np.ndarray, n: np.ndarray, total: int, length: int) -> np.ndarray:
    """What a term's occurrences count in documents of n terms, of `total` documents with `length` terms."""
    return (UNIT * times) // (1000 * times + SATURATION * (100 - B_PART + (B_PART * n * total) // length))


def blocks_of(pairs: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Queries (number, places, times) in blocks of bounded numbers and terms: (numbers, columns, rows, columns and times of the entries)."""
    found, at = [], 0
    while at < len(pairs):
        seen, end = set(pairs[at][1].tolist()), at + 1
        while end < len(pairs) and end - at < BLOCK_QUERIES and len(seen | set(pairs[end][1].tolist())) <= BLOCK_TERMS:
            seen |= set(pairs[end][1].tolist())
            end += 1
        columns = np.array(sorted(seen), np.int64)
        entries = np.concatenate([np.stack([np.full(len(p), i), np.searchsorted(columns, p), c]) for i, (_, p, c) in enumerate(pairs[at:end])], 1)
        found.append((np.array([n for n, _, _ in pairs[at:end]]), columns, entries))
        at = end
    return found


def _searched(sent, k: int, shard_rows: int):
    """For mapInArrow over vectors: each task's k best documents of each query, (number, doc, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, weights, floors, total, length = sent.value
        blocks = []
        for numbers, columns, entries in groups:
            vectors = np.zeros((len(numbers), len(columns)))
            vectors[entries[0], entries[1]] = entries[2]
            blocks.append(Block(numbers, columns, vectors, floors[numbers], k))

        def shard(docs: np.ndarray, n: np.ndarray, starts: np.ndarray, places: np.ndarray, times: np.ndarray) -> None:
            rows = np.repeat(np.arange(len(docs)), np.diff(starts))
            values = impacts(times, n[rows], total, length) * weights[places]
            for block in blocks:
                at = np.searchsorted(block.columns, places)
                mine = np.flatnonzero(block.columns[np.minimum(at, len(block.columns) - 1)] == places)
                mine = mine[values[mine] > 0]
                if not len(mine):
                    continue
                # only rows and columns with entries; a shard of many terms is taken a few rows at a time
                columns, own = np.unique(at[mine], return_inverse=True)
                some, place = np.unique(rows[mine], return_inverse=True)
                step, view = max(1, CELLS // len(columns)), block.narrowed(columns)
                for lo in range(0, len(some), step):
                    here = (place >= lo) & (place < lo + step)
                    points = np.zeros((min(step, len(some) - lo), len(columns)))
                    points[place[here] - lo, own[here]] = values[mine[here]]
                    exact = float(points.max()) * float(view.vectors.sum(1).max()) < _EXACT
                    BallTree(points).search(points, docs[some[lo : lo + step]], view, exact)

        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("doc")))
            for start in range(0, batch.num_rows, shard_rows):
                part = batch.slice(start, shard_rows)
                places, times = part.column("places"), part.column("times")
                starts = np.concatenate(([0], np.cumsum(pc.list_value_length(places).to_numpy(zero_copy_only=False)))).astype(np.int64)
                flat = lambda c: c.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                shard(part.column("doc").to_numpy(zero_copy_only=False), part.column("n").to_numpy(zero_copy_only=False), starts, flat(places), flat(times))
        for block in blocks:
            rows, at = np.nonzero(block.scores > 0)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (block.numbers[rows], block.found[rows, at], block.scores[rows, at])], names=["number", "doc", "score"])

    return run


def _round(docs: DataFrame, asked: DataFrame, k: int, held: Scratch, name: str, shard_rows: int, common: int) -> DataFrame:
    """(number, doc, score) of the k best documents of each query (number, term, times), unranked."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    rows = asked.toArrow().sort_by([("number", "ascending"), ("term", "ascending")])  # PAIRS at most, but for a query with more terms
    encoded = pc.dictionary_encode(rows.column("term").combine_chunks())
    known = {t: i for i, t in enumerate(encoded.dictionary.to_pylist())}
    places, times = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows.column("times").to_numpy()
    numbers, starts = np.unique(rows.column("number").to_numpy(), return_index=True)
    pairs = [(i, *(x[:, np.argsort(x[0])])) for i, x in enumerate(np.split(np.stack([places, times]), starts[1:], axis=1))] if len(numbers) else []
    vectors = held.table(docs.mapInArrow(released(_vectors(send(known))), "doc long, n long, places array<int>, times array<long>"), f"vectors-{name}")
    totals = vectors.where("n > 0").agg(F.count("*").alias("total"), F.sum("n").alias("length")).first()
    if not totals.total:
        return spark.createDataFrame([], "number long, doc long, score long")
    holding = vectors.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("df"))
    # the weight in doubles; a row for each term of the queries
    weight = F.floor(1000 * F.log((2.0 * totals.total + 2) / (2.0 * F.col("df") + 1))).alias("weight")
    weights = np.zeros(len(known), np.int64)
    for r in holding.select("place", weight).collect():
        weights[r.place] = r.weight
    floors = np.zeros(len(numbers), np.int64)
    groups, best = blocks_of(pairs), "number long, doc long, score long"

    def search(some: DataFrame) -> DataFrame:
        sent = send((groups, weights, floors, totals.total, totals.length))
        found = some.select("doc", "n", "places", "times").mapInArrow(released(_searched(sent, k, shard_rows)), best)
        place = F.row_number().over(W.partitionBy("number").orderBy(F.desc("score"), "doc"))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    # a sample by a hash, of about `common` rows whatever the table has; it only gives where queries start, so that it may end
    # where many equal rows come into it
    share = min(1.0, common / totals.total)
    some = vectors.where("doc is not null and n > 0").where(F.shiftrightunsigned(F.xxhash64(F.lit("common"), "doc", "n"), 11) < share * float(1 << 53))
    for r in search(some.limit(2 * common).coalesce(1)).where(F.col("rank") == k).collect():  # a row for each query
        floors[r.number] = r.score
    found = held.table(search(vectors.where("n > 0")).drop("rank"), f"found-{name}")
    held.drop(f"vectors-{name}")
    names = spark.createDataFrame(list(enumerate(numbers.tolist())), "number long, own long")  # a row for each query of the round
    return found.join(F.broadcast(names), "number").select(F.col("own").alias("number"), "doc", "score")


def ranked(docs: DataFrame, queries: DataFrame, k: int, *, doc: str = "doc_id", text: str = "text", query: str = "item_id", query_text: str = "text", shard_rows: int = SHARD_ROWS, common: int = COMMON, most_pairs: int = PAIRS) -> DataFrame:
    """(query, rank, doc, score): the k documents with the highest scores above 0 of each query."""
    spark = docs.sparkSession
    held = Scratch(spark, "lexical")
    numbered = held.table(queries.select(F.col(query).alias("query"), F.col(query_text).alias("body"), F.monotonically_increasing_id().alias("number")), "queries")
    asked = held.table(numbered.select("number", "body").mapInArrow(_query_terms, "number long, term binary, times long"), "asked")
    rounds = max(1, -(-asked.count() // most_pairs))
    bodies = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("body"))
    found = None
    for i in range(rounds):
        own = asked.where(F.pmod(F.xxhash64(F.lit("round"), "number"), F.lit(rounds)) == i)
        part = _round(bodies, own, k, held, str(i), shard_rows, common)
        found = part if found is None else found.union(part)
    place = F.row_number().over(W.partitionBy("number").orderBy(F.desc("score"), "doc"))
    return found.join(numbered.select("number", "query"), "number").withColumn("rank", place).select("query", F.col("rank").cast("int").alias("rank"), "doc", "score")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return found.select(F.col("query").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL),
g AS (SELECT count(*) AS total, sum(len(t))::BIGINT AS length FROM d WHERE len(t) > 0),
f AS (SELECT doc_id, row, len(t) AS n, unnest(t) AS term FROM d),
tf AS (SELECT doc_id, row, n, term, count(*) AS tf FROM f GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, g GROUP BY term, total),
q AS (
  SELECT item_id, item, term, count(*) AS times FROM (
    SELECT item_id, row_number() OVER () AS item,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL)
  GROUP BY ALL),
s AS (
  SELECT item_id, item, doc_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * total) // length))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), g WHERE doc_id IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
