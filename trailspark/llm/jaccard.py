"""N-gram Jaccard join with a token-group matrix.

Texts become sets of hashed word shingles. Equal sets form a class, of which one set is compared. Two classes
link when the Jaccard similarity of their sets reaches a threshold.

1. A table of fixed size counts all shingles of all documents; it orders those of a set, rare ones first. Of two
   similar sets the first few in this order must share some, and how many follows from the sizes (`needed`).
2. Classes are partitioned into groups of similar sets, by their least shingle and their size, of bounded size.
3. The token-group matrix is stored once: a row for each shingle that several classes have among their first ones
   and each group, the union of its members' first shingles, with the range of their sizes. Every class is a query:
   its first shingles look up the matrix, and the hits in a group bound its overlap with any member. Only groups
   whose bound suffices are opened for that query; pairs of sets are never listed for the bound.
4. The sets of opened groups and their queries are brought together, in units of bounded size. A task holds the sets
   of one group and their union, streams the queries past the union, and takes exact overlaps of those that may
   still reach the threshold from one matrix product. It gives the numbers of links and a spanning forest of them,
   so that a large group of near copies gives rows in proportion to its sets, not to its pairs.
5. Components of the forests' edges are found by label propagation over stored tables.

Tables that later steps no longer read are deleted from the shared folder as soon as those are written.

Defined cases: a null text, or one without words, has an empty set and no link; a text with fewer words than a
shingle is one shingle; each of several equal rows is a document; rows of one id with different texts are
documents of their own; null ids don't count as the smallest id of a component unless it has no other; texts of any
length are taken whole; columns other than those asked for are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm.common import Scratch, released, sized, small, table, texts_of
from trailspark.llm.filters import bit_filter, components, count_levels, holds, level_of, unsigned

#: Shingles of all sets in a group, unless one set has more, and sets in it.
GROUP_SHINGLES, GROUP_SETS = 1 << 18, 4096
#: Queries that are brought to a group in one unit, and shingles of those that are looked at together.
UNIT_QUERIES, BLOCK_SHINGLES = 2048, 1 << 18
#: Cells of the table that tells how often a group's key occurs.
_CELLS = 1 << 20
_COLUMNS = 4096
#: Natural logarithm of the range of sizes in a group.
_BAND = 0.05
#: Words whose hashes a task remembers.
_KNOWN_WORDS = 200_000
_MIX, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingles:
    """Sets of hashed shingles of n words; words are runs of other than ASCII white space, A-Z lower-cased."""

    def __init__(self, n: int):
        self.n, self.known = n, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        """The distinct hashes in order."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > _KNOWN_WORDS:
            self.known.clear()
        hashes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        width = min(self.n, len(words))
        mixed = np.full(len(words) - width + 1, width, np.uint64)
        for i in range(width):
            mixed = ((mixed ^ (mixed >> np.uint64(31))) + hashes[i : i + len(mixed)]) * _MIX
        mixed = (mixed ^ (mixed >> np.uint64(30))) * _LAST
        mixed.sort()
        return mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


def _sets(batch: pa.RecordBatch, make: Shingles) -> Iterator[np.ndarray]:
    for text in texts_of(batch.column("body")):
        yield make(text)


def _profile(sent, n: int, num: int, den: int):
    """For mapInArrow: each row's set size, class, least shingle and first shingles (once a task for each class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, levels, seen = Shingles(n), sent.value, set()
        for batch in batches:
            sizes, names, least, firsts = [], [], [], []
            for found in _sets(batch, make):
                size = len(found)
                name = xxhash.xxh3_128_digest(found.tobytes()) if size else None
                sizes.append(size)
                names.append(name)
                least.append(int(found[:1].view(np.int64)[0]) if size else None)
                if size and name not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(name)
                    order = np.argsort(level_of(levels, found), kind="stable")
                    firsts.append(found[order[: size - (num * size + den - 1) // den + 1]].view(np.int64))
                else:
                    firsts.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"), batch.column("row_key"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                    pa.array(least, pa.int64()), pa.array(firsts, pa.list_(pa.int64())),
                ],
                names=["doc", "row_key", "size", "class", "least", "firsts"],
            )

    return run


def _kept_firsts(sent):
    """For mapInArrow: the rows that have any of the first shingles that several classes may have, with those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            lists = batch.column("firsts")
            flat = unsigned(lists.flatten())
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            keep = holds(bits, flat)
            left = np.bincount(np.repeat(np.arange(len(lists)), lengths)[keep], minlength=len(lists))
            some = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(left))), pa.int32()), pa.array(flat[keep].view(np.int64)))
            columns = [*(batch.column(c) for c in ("class", "least", "size", "row_key")), some]
            yield pa.RecordBatch.from_arrays(columns, names=["class", "least", "size", "row_key", "firsts"]).filter(pa.array(left > 0))

    return run


def needed(x: Column, low: Column, high: Column, t: float) -> Column:
    """How many first shingles a set of size x at least shares with a set of a size from low to high that links to it.

    Of two sets x and y, let x be the one whose first shingles end earlier in the order. Shared shingles are among
    the first of both, s in number, or among those of x after its first, of which there are ceil(t * |x|) - 1. So
    s >= t * (|x| + |y|) / (1 + t) - t * max(|x|, |y|), which is least at an end of the range of |y|.
    """
    low, high = F.greatest(low.cast("double"), t * x), F.least(high.cast("double"), x / t)
    at = lambda y: t * (x + y) / (1 + t) - t * F.greatest(x.cast("double"), y)
    return F.least(at(low), at(high)) - 1e-6


def _chosen_sets(sent, n: int):
    """For mapInArrow: (class, least, size, members) for the rows whose key may be asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, bits, seen = Shingles(n), sent.value, set()
        for batch in batches:
            keys = unsigned(batch.column("row_key"))
            keep = holds(bits, keys)
            for i in np.flatnonzero(keep).tolist():
                keep[i] = keys[i] not in seen  # equal rows have one set
                seen.add(keys[i])
            if len(seen) > 1_000_000:
                seen.clear()
            some = batch.filter(pa.array(keep))
            found = [x for x in _sets(some, make) if len(x)]
            for start in range(0, len(found), 256):
                part = found[start : start + 256]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in part], pa.binary()), pa.array([int(x[:1].view(np.int64)[0]) for x in part], pa.int64()),
                        pa.array([len(x) for x in part], pa.int64()), pa.array([x.tobytes() for x in part], pa.binary()),
                    ],
                    names=["class", "least", "size", "members"],
                )

    return run


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The exact numbers of shared shingles of every set of a with every set of b."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    rows_a, rows_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    shared = np.intersect1d(flat_a, flat_b)
    total = np.zeros((len(a), len(b)), np.float64)
    for start in range(0, len(shared), _COLUMNS):
        columns = shared[start : start + _COLUMNS]
        dense = []
        for flat, rows, count in ((flat_a, rows_a, len(a)), (flat_b, rows_b, len(b))):
            at = np.minimum(np.searchsorted(columns, flat), len(columns) - 1)
            hit = columns[at] == flat
            matrix = np.zeros((count, len(columns)), np.float32)
            matrix[rows[hit], at[hit]] = 1
            dense.append(matrix)
        total += dense[0] @ dense[1].T
    return total.astype(np.int64)


def _may_link(sets: list[np.ndarray], union: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets overlap the union of a group's sets enough to link to any of them."""
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(union, flat), len(union) - 1)
    sizes = np.array([len(x) for x in sets])
    hits = np.add.reduceat((union[at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
    return np.flatnonzero(den * hits >= num * sizes)


def _roots(links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns, given as ranks of the classes, the least rank that each is connected to by links."""
    none = np.iinfo(np.int64).max
    while True:
        new_rows = np.minimum(rows, np.where(links, columns[None, :], none).min(1, initial=none))
        new_columns = np.minimum(columns, np.where(links, new_rows[:, None], none).min(0, initial=none))
        if (new_rows == rows).all() and (new_columns == columns).all():
            return rows, columns
        rows, columns = new_rows, new_columns


def meet(names: list[bytes], sets: list[np.ndarray], union: np.ndarray, ask: list[bytes], asked: list[np.ndarray], own: bool, num: int, den: int) -> list[tuple[bytes, bytes, int]]:
    """(class, root, links) for each class with links between a group and queries; root is the least class it is connected to.

    own: the queries are members of the group themselves. Then only the queries' links are counted, as each member asks.
    """
    at_q = _may_link(asked, union, num, den)
    if not len(at_q):
        return []
    open_q = [asked[i] for i in at_q]
    at_m = _may_link(sets, np.unique(np.concatenate(open_q)), num, den)
    if not len(at_m):
        return []
    open_m = [sets[i] for i in at_m]
    both = _overlaps(open_q, open_m)
    either = np.array([len(x) for x in open_q])[:, None] + np.array([len(x) for x in open_m])[None, :] - both
    links = den * both >= num * either
    rows, columns = [ask[i] for i in at_q], [names[i] for i in at_m]
    order = sorted({*rows, *columns})
    rank = {c: i for i, c in enumerate(order)}
    row_ranks, column_ranks = np.array([rank[c] for c in rows]), np.array([rank[c] for c in columns])
    if own:
        links &= row_ranks[:, None] != column_ranks[None, :]
    root_rows, root_columns = _roots(links, row_ranks, column_ranks)
    counts = links.sum(1)
    out = [(rows[i], order[root_rows[i]], int(counts[i])) for i in np.flatnonzero(counts)]
    counts = links.sum(0)
    return out + [(columns[i], order[root_columns[i]], 0 if own else int(counts[i])) for i in np.flatnonzero(counts)]


def _opened(num: int, den: int):
    """For mapInArrow over rows (group, part, ask, class, own, members) in this order: the links of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, names, sets, union = None, [], [], None
        ask, asked, mine, size, last = [], [], False, 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal union, size
            if ask and sets:
                if union is None:
                    union = np.unique(np.concatenate(sets))
                found = meet(names, sets, union, ask, asked, mine, num, den)
                if found:
                    kinds = (pa.binary(), pa.binary(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], names=["class", "root", "links"])
            ask.clear()
            asked.clear()
            size = 0

        for batch in batches:
            for group, part, kind, name, own, members in zip(*(batch.column(c) for c in ("group", "part", "ask", "class", "own", "members"))):
                key = group.as_py(), part.as_py()
                if key != unit:
                    yield from flush()
                    unit, union, last = key, None, None
                    names.clear()
                    sets.clear()
                found, title = np.frombuffer(members.as_py(), np.uint64), name.as_py()
                # several tasks may have given the set of one class; those stand together
                if not kind.as_py():
                    if not names or names[-1] != title:
                        names.append(title)
                        sets.append(found)
                    continue
                if title == last:
                    continue
                last = title
                if own.as_py() != mine or size > BLOCK_SHINGLES:
                    yield from flush()
                mine = own.as_py()
                ask.append(title)
                asked.append(found)
                size += len(found)
        yield from flush()

    return run


def join(docs: DataFrame, **options) -> DataFrame:
    """(doc, row_key, n_shingles, component, class_id, n_copies, n_links) for each row of docs.

    Sets link when den * intersection >= num * union. component: the least id reachable by links; class_id: the
    least id with an equal set, of which there are n_copies documents; n_links: the number of other classes that
    link to the row's. row_key is a hash of id and text.
    """
    return labelled(docs, **options).drop("label")


def labelled(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of join and label, which no two components share, as ids may be; null for rows without words."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    held = Scratch(spark, "jaccard")
    rows = docs.select(F.col(doc).alias("doc"), F.xxhash64(doc, text).alias("row_key"), F.col(text).alias("body"))
    kind = dict(rows.dtypes)["doc"]
    t = num / den

    def shingles(batch: pa.RecordBatch, make=[]) -> Iterator[np.ndarray]:  # noqa: B006  one for each task
        if not make:
            make.append(Shingles(n))
        return _sets(batch, make[0])

    levels = count_levels(rows.select("body"), shingles)
    schema = f"doc {kind}, row_key long, size long, class binary, least long, firsts array<long>"
    profile = held.table(rows.mapInArrow(released(_profile(send(levels), n, num, den)), schema), "profile")
    # first shingles that two classes have, as a filter of fixed size
    firsts = profile.where("firsts is not null").select("class", "least", "size", "row_key", "firsts")
    short = firsts.select(F.xxhash64("class").alias("short"), F.explode("firsts").alias("shingle"))
    shared = short.groupBy("shingle").agg(F.min("short").alias("a"), F.max("short").alias("b")).where("a < b").select("shingle")
    kept = firsts.mapInArrow(released(_kept_firsts(send(bit_filter(shared, "shingle")))), "class binary, least long, size long, row_key long, firsts array<long>")
    kept = held.table(kept.groupBy("class").agg(*(F.first(c).alias(c) for c in ("least", "size", "row_key", "firsts"))), "kept")
    # groups of classes with one least shingle, split where there are many; the table of splits has a fixed size
    cell = F.col("least").bitwiseAND(_CELLS - 1).alias("cell")
    fill = F.greatest(F.count("*") / GROUP_SETS, F.sum("size") / GROUP_SHINGLES)
    splits = F.broadcast(held.table(kept.groupBy(cell).agg(fill.alias("fill")).where("fill > 1").select("cell", F.ceil("fill").alias("parts")), "splits"))  # _CELLS rows at most

    def grouped(df: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64(F.lit("part"), "class"), F.coalesce("parts", F.lit(1)))
        band = F.floor(F.log(F.col("size").cast("double")) / _BAND)
        return df.withColumn("cell", cell).join(splits, "cell", "left").withColumn("group", F.xxhash64("least", band, part)).drop("cell", "parts")

    # the token-group matrix, and the groups that it opens for each class
    entries = grouped(kept).select("class", "size", "group", F.explode("firsts").alias("shingle"))
    name = F.xxhash64("class")
    several = (F.min(name) < F.max(name)).alias("several")
    matrix = held.table(entries.groupBy("shingle", F.col("group").alias("target")).agg(F.min("size").alias("low"), F.max("size").alias("high"), several), "matrix")
    x = F.col("size")
    fits = (F.col("high") >= (t - 1e-9) * x) & ((t - 1e-9) * F.col("low") <= x)
    other = (F.col("group") < F.col("target")) | ((F.col("group") == F.col("target")) & F.col("several"))
    hits = entries.join(matrix, "shingle").where(fits & other).groupBy("class", "size", "group", "target")
    bound = hits.agg(F.count("*").alias("hits"), F.min("low").alias("low"), F.max("high").alias("high")).where(F.col("hits") >= needed(x, F.col("low"), F.col("high"), t))
    opened = held.table(bound.select("class", "target", (F.col("group") == F.col("target")).alias("own")), "opened")
    held.drop("matrix")
    # the sets of those classes and groups; small tables are broadcast, so that sets move once, to their units
    targets = small(held.table(opened.groupBy(F.col("target").alias("group")).agg(F.ceil(F.count("*") / UNIT_QUERIES).cast("int").alias("parts")), "targets"))
    asking = held.table(opened.select("class").distinct(), "asking")
    inside = grouped(kept).join(targets, "group", "left_semi").select("class", "row_key")
    asked = kept.join(small(asking), "class", "left_semi").select("class", "row_key")
    needs = held.table(inside.union(asked).distinct(), "needs")
    wanted = bit_filter(needs, "row_key")
    chosen = rows.select("row_key", "body").mapInArrow(released(_chosen_sets(send(wanted), n)), "class binary, least long, size long, members binary")
    sets = held.table(grouped(chosen.join(small(needs.select("class")), "class", "left_semi")), "sets")
    units = sets.join(targets, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("ask"), "class", F.lit(False).alias("own"), "members")
    place = F.pmod(F.xxhash64(F.lit("unit"), "class"), F.col("parts")).cast("int").alias("part")
    queries = sets.drop("group").join(small(opened), "class").withColumnRenamed("target", "group").join(targets, "group").select("group", place, F.lit(True).alias("ask"), "class", "own", "members")
    dealt = units.union(queries).repartition("group", "part").sortWithinPartitions("group", "part", "ask", "own", "class")
    links = held.table(dealt.mapInArrow(released(_opened(num, den)), "class binary, root binary, links long"), "links")
    held.drop("sets", "targets", "opened", "kept", "asking", "needs")
    # classes of several documents or with links; all others are components of their own
    edges = links.where(F.col("class") != F.col("root")).select(F.col("class").alias("a"), F.col("root").alias("b"))
    found = components(edges, "jaccard-components").select(F.col("node").alias("class"), F.col("component").alias("label"))
    numbers = links.groupBy("class").agg(F.sum("links").alias("n_links"))
    full = profile.where("size > 0").groupBy("class").agg(F.min("doc").alias("class_id"), F.count("*").alias("n_copies"))
    known = full.join(found, "class", "left").join(numbers, "class", "left").where("n_copies > 1 OR label IS NOT NULL").withColumn("label", F.coalesce("label", "class"))
    known = held.table(known, "known")
    least = held.table(known.groupBy("label").agg(F.min("class_id").alias("component")), "least")
    told = small(held.table(known.join(least, "label"), "told"))
    held.drop("known", "least", "links")
    lone = F.col("n_copies").isNull()
    none = F.col("class").isNull()
    return profile.join(told, "class", "left").select(
        "doc",
        "row_key",
        F.col("size").alias("n_shingles"),
        F.when(lone, F.col("doc")).otherwise(F.col("component")).alias("component"),
        F.when(lone, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(none, F.lit(None).cast("binary")).otherwise(F.coalesce("label", "class")).alias("label"),
    )


def keep_one(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each component, one with its least id. Rows without words have no copies and all stay."""
    held = Scratch(docs.sparkSession, "jaccard-keep")
    rows = labelled(docs, doc=doc, text=text, **options).where("n_shingles > 0 AND (n_copies > 1 OR n_links > 0)")
    found = held.table(rows.select("row_key", "label", F.col("doc").eqNullSafe(F.col("component")).alias("least")), "found")
    keys = found.where("least").groupBy("label").agg(F.min("row_key").alias("row_key")).select("row_key", F.lit(True).alias("chosen"))
    equal = found.groupBy("row_key").count()
    told = equal.join(keys, "row_key", "left").select(F.col("row_key").alias("_key"), F.coalesce("chosen", F.lit(False)).alias("_chosen"), F.col("count").alias("_equal"))
    marked = docs.withColumn("_key", F.xxhash64(doc, text)).join(sized(told), "_key", "left")
    # only equal rows need to be brought together
    single = marked.where("_equal IS NULL OR (_chosen AND _equal = 1)")
    several = marked.where("_chosen AND _equal > 1").dropDuplicates(["_key"])
    return single.unionByName(several).drop("_key", "_chosen", "_equal")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = join(table(spark, sf_dir, "documents"), n=3, num=90)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "class_id", "n_copies", "n_links")
