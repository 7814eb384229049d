"""A trie of the prefixes that conversations share, as a z-fast trie.

Turns get their positions by a range partitioning and a running count over its parts, so that no task holds a conversation
whole. A prefix is known by two sums of hashes of its turns and their positions, 126 bits; as sums they can be made from
either end, and from blocks. Equal conversations are brought together first, by partial aggregation.

The different sequences are dealt into ranges of bounded size in the order of their turns, those of more than `SEGMENT`
turns as several strings, each below the prefix that it goes on from. A task grows a z-fast trie over its range: of the
compacted trie only nodes that branch or end a sequence are kept, and a node stands in a hash table under its handle, the
prefix as long as the two-fattest number between its parent's length and its own. Strings come in batches; a fat binary
search finds the node where each leaves the trie, in a number of look-ups that grows with the logarithm of its length, and
the batch is then put in from there, which splits edges where strings part. At the end edges are expanded: all prefixes on
an edge have the same members.

Ranges of that order share no prefixes but those of the strings at their borders. Each range knows how far its first string
agrees with the string before it, and its last one with the one after it, and counts a shared prefix in the first range
that has it only. All columns are then sums over ranges, and only shared prefixes are grouped.

The members that end in a node are hashed in numerical order, which has no parallel form: ranges of members write their
numbers as text in pieces, and the pieces of a node are streamed through one hash, in bounded memory.

Defined cases: rows without a conversation's id are left out; turns of one conversation are ordered by turn, null first,
then role, then a digest of the text; null roles and texts count as empty; repeated rows are turns of their own; a
conversation that a rebuilding leaves without turns is a member of the root only; texts of any length are read once and
moved as digests; columns other than those asked for are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailspark.llm.common import Scratch, released, small, table

#: Turns of a string of the trie, turns of a range, and bytes of a piece of members' numbers.
SEGMENT, RANGE_TURNS, PIECE_BYTES = 512, 1 << 17, 1 << 20
_MASK = (1 << 63) - 1
_LONGS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def _batch(schema: str, columns) -> pa.RecordBatch:
    """A batch by a schema in Spark's words."""
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _LONGS[k]) for c, k in zip(columns, kinds)], names=list(names))


def _wrap() -> Column:
    return F.lit(str(1 << 63)).cast("decimal(20,0)")


def _wrapped_sum(value: Column) -> Column:
    """The sum of non-negative longs modulo 2**63."""
    return F.sum(value.cast("decimal(20,0)")) % _wrap()


# positions

_PLACED = "conv long, part long, local long, digest binary, size long"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the turns of each conversation within the task, which has them in order."""
    part, conv, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv").to_numpy()
        starts = np.concatenate(([0], np.flatnonzero(ids[1:] != ids[:-1]) + 1))
        local = np.arange(1, len(ids) + 1) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
        if ids[0] == conv:
            local[: starts[1] if len(starts) > 1 else None] += count
        conv, count = ids[-1], int(local[-1])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(np.full(len(ids), part)), pa.array(local), batch.column("digest"), batch.column("size")], names=["conv", "part", "local", "digest", "size"])


def positions(conversations: DataFrame, held: Scratch, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, pos, digest, size) of every turn, and (conv, n) of every conversation."""
    who, body = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, body)))
    slim = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), who.alias("who"), digest.alias("digest"), F.octet_length(body).cast("long").alias("size"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("who"), F.col("digest")]
    turns = held.table(slim, "turns")
    placed = held.table(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, _PLACED), "placed")
    counts = placed.groupBy("conv", "part").agg(F.max("local").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    # only the first conversation of a part may have begun before it
    later = small(held.table(counts.withColumn("before", before).where("before > 0").select("conv", "part", "before"), "later"))
    pos = (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos")
    held.drop("turns")
    return placed.join(later, ["conv", "part"], "left").select("conv", pos, "digest", "size"), counts.groupBy("conv").agg(F.sum("n").alias("n"))


def marked(turns: DataFrame) -> DataFrame:
    """(conv, pos, one, two, size): each turn as two numbers that depend on its place."""
    mark = lambda salt: F.xxhash64(F.lit(salt), "digest", "pos").bitwiseAND(F.lit(_MASK))
    return turns.select("conv", "pos", mark("first").alias("one"), mark("second").alias("two"), "size")


# members that end in a node

_ENDED = "one long, two long, length long, nr long, sha string, piece binary"


def _ends(piece_bytes: int):
    """For mapInArrow over members in order: the hash of a sequence that lies within the task, and pieces of the first and the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, pieces, size, nr, first = TaskContext.get().partitionId() << 32, None, [], 0, 0, True

        def close(whole: bool) -> pa.RecordBatch:
            sha = hashlib.sha256(b",".join(pieces)).hexdigest() if whole else None
            return _batch(_ENDED, ([key[0]], [key[1]], [key[2]], [part + nr], [sha], [None if whole else b",".join(pieces)]))

        for batch in batches:
            for one, two, length, conv in zip(*(batch.column(c).to_pylist() for c in ("one", "two", "length", "conv"))):
                if (one, two, length) != key:
                    if key is not None:
                        yield close(not first and not nr)
                        first = False
                    key, pieces, size, nr = (one, two, length), [], 0, 0
                elif size > piece_bytes:
                    yield close(False)
                    pieces, size, nr = [], 0, nr + 1
                pieces.append(str(conv).encode())
                size += len(pieces[-1]) + 1
        if key is not None:
            yield close(False)

    return run


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each sequence's pieces, which come in order."""
    key, state = None, None
    schema = "one long, two long, length long, sha string"
    for batch in batches:
        for one, two, length, piece in zip(*(batch.column(c) for c in ("one", "two", "length", "piece"))):
            now = one.as_py(), two.as_py(), length.as_py()
            if now != key:
                if key is not None:
                    yield _batch(schema, ([key[0]], [key[1]], [key[2]], [state.hexdigest()]))
                key, state = now, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.as_py())
    if key is not None:
        yield _batch(schema, ([key[0]], [key[1]], [key[2]], [state.hexdigest()]))


def ends(members: DataFrame, held: Scratch, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(one, two, length, sha): the hash of the ids, in order, of the conversations with each sequence."""
    key = ["one", "two", "length"]
    ordered = members.select(*key, "conv").repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv")
    found = held.table(ordered.mapInArrow(_ends(piece_bytes), _ENDED), "ended")
    pieces = found.where("piece is not null").repartition(*key).sortWithinPartitions(*key, "nr")
    return found.where("sha is not null").select(*key, "sha").union(pieces.mapInArrow(_joined_ends, "one long, two long, length long, sha string"))


# the trie of a range


def fattest(a: int, b: int) -> int:
    """The number in (a, b] that the highest power of two divides."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


class Text:
    """A string of the trie: hashes `one` and `two` and bytes `size` of its prefixes of 0, 1, ... turns, and what it adds to its nodes."""

    __slots__ = ("one", "two", "size", "conv", "n", "whole", "sha", "final", "later", "leaf")

    def __init__(self, one, two, size, conv, n, whole, sha, final, later, leaf):
        self.one, self.two, self.size, self.conv, self.n, self.whole, self.sha, self.final, self.later, self.leaf = one, two, size, conv, n, whole, sha, final, later, leaf

    def __len__(self) -> int:
        return len(self.one) - 1

    def turn(self, at: int) -> tuple[int, int]:
        """The turn after a prefix, as numbers that tell it from others there."""
        return self.one[at + 1] - self.one[at] & _MASK, self.two[at + 1] - self.two[at] & _MASK

    def same(self, other: Text, length: int) -> bool:
        return self.one[length] == other.one[length] and self.two[length] == other.two[length]


class ZFastTrie:
    """Nodes by number; 0 is the root, the empty prefix. `extent` is a node's length, `text` a string that goes through it."""

    def __init__(self):
        self.extent, self.parent, self.text, self.ends = [0], [-1], [None], [[]]
        self.handles: dict[tuple[int, int, int], int] = {}
        self.children: dict[tuple[int, tuple[int, int]], int] = {}
        self.new: list[tuple[Text, int]] = []  # strings with the prefix from which they made nodes

    def _handle(self, node: int) -> tuple[int, int, int]:
        length, text = fattest(self.extent[self.parent[node]], self.extent[node]), self.text[node]
        return length, text.one[length], text.two[length]

    def locate(self, text: Text, base: int = 0) -> tuple[int, int | None]:
        """The deepest node whose prefix the string has, at base or below it, and the node on whose edge the string leaves, if any."""
        low, high = self.extent[base], len(text)
        while low < high:
            length = fattest(low, high)
            node = self.handles.get((length, text.one[length], text.two[length]))
            if node is None:
                high = length - 1
            elif self.extent[node] <= len(text) and text.same(self.text[node], self.extent[node]):
                base, low = node, self.extent[node]
            else:
                return self.parent[node], node
        at = self.extent[base]
        return base, self.children.get((base, text.turn(at))) if at < len(text) else None

    def _common(self, text: Text, edge: int, base: int) -> int:
        """How much of an edge a string has: at least a turn, and not all."""
        low, high, other = self.extent[base] + 1, min(len(text), self.extent[edge] - 1), self.text[edge]
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if text.same(other, middle) else (low, middle - 1)
        return low

    def _node(self, text: Text, extent: int, parent: int) -> int:
        self.extent.append(extent)
        self.parent.append(parent)
        self.text.append(text)
        self.ends.append([])
        node = len(self.extent) - 1
        self.handles[self._handle(node)] = node
        self.children[parent, text.turn(self.extent[parent])] = node
        return node

    def put(self, text: Text, base: int, edge: int | None) -> None:
        at = self.extent[base]
        if edge is not None:  # the upper part of the edge becomes a node
            at = self._common(text, edge, base)
            del self.handles[self._handle(edge)]
            upper = self._node(self.text[edge], at, base)
            self.parent[edge] = upper
            self.handles[self._handle(edge)] = edge
            self.children[upper, self.text[edge].turn(at)] = edge
            base = upper
        self.new.append((text, at))
        if at < len(text):
            base = self._node(text, len(text), base)
        self.ends[base].append(text)

    def insert(self, batch: list[Text]) -> None:
        """Put a batch in: all are located in the trie as it is, and then again from there, past what the batch has added."""
        for text, (base, _) in zip(batch, [self.locate(text) for text in batch]):
            self.put(text, *self.locate(text, base))


_NODE = (
    "depth long, one long, two long, up_one long, up_two long, low long, n long, children long, leaves long, saved long, sha string, "
    "shared boolean, up_shared boolean, up_low long"
)
_STRING = "conv long, segment long, owned long, leaf boolean"


def _path(trie: ZFastTrie, text: Text | None) -> set[int]:
    """The nodes that a string goes through."""
    found: set[int] = set()
    if text is not None:
        node = trie.locate(text)[0]
        while node >= 0:
            found.add(node)
            node = trie.parent[node]
    return found


def expanded(trie: ZFastTrie, texts: tuple[Text, Text], before: int, after: int, offset: int) -> Iterator[tuple]:
    """A row for each prefix: edges expanded, shared prefixes marked, and counted where they are the range's own.

    texts: the first and the last string; before, after: how far they agree with the strings next to the range, -1 if they
    are of another trie; offset: the depth of the root.
    """
    count = len(trie.extent)
    low, n, leaves, whole, owned, kids = [None] * count, [0] * count, [0] * count, [0] * count, [0] * count, [0] * count
    first, last = _path(trie, texts[0]), _path(trie, texts[1])
    goes_on = [False] * count
    foreign = lambda node, depth: depth <= before and node in first  # noqa: E731  another range counts it
    shared = lambda node, depth: foreign(node, depth) or depth <= after and node in last
    for node in sorted(range(count), key=lambda i: -trie.extent[i]):  # children before their parents
        for text in trie.ends[node]:
            low[node] = text.conv if low[node] is None else min(low[node], text.conv)
            n[node] += text.n
            whole[node] += text.n * text.whole
            owned[node] += text.later
            leaves[node] += text.leaf
            goes_on[node] |= not text.final
        up = trie.parent[node]
        if up < 0:
            continue
        text, top, end = trie.text[node], trie.extent[up], trie.extent[node]
        own = max(top, min(end, before)) if node in first else top  # prefixes up to there are another range's
        total = owned[node] + text.size[end] - text.size[own]
        low[up] = low[node] if low[up] is None else min(low[up], low[node])
        n[up], leaves[up], whole[up], owned[up] = n[up] + n[node], leaves[up] + leaves[node], whole[up] + whole[node], owned[up] + total
        kids[up] += own == top
    for node in range(count):
        text, end, up = trie.text[node], trie.extent[node], trie.parent[node]
        sha = next((t.sha for t in trie.ends[node] if t.final), None)
        # the next segment's root adds what goes on from the end of a segment
        border = goes_on[node]
        if up < 0:
            start = texts[0]
            root = offset > 0
            gives = (None, 0, kids[node], 0, 0) if root else (low[node], n[node], kids[node], leaves[node], whole[node] - owned[node])
            yield (offset, start.one[0], start.two[0], None, None, *gives, None if root else sha, root or before >= 0 or after >= 0 or border, False, None)
            continue
        top = trie.extent[up]
        for depth in range(top + 1, end + 1):
            own = max(depth - 1, min(end, before)) if node in first else depth - 1
            saved = whole[node] - n[node] * text.size[depth - 1] - (owned[node] + text.size[end] - text.size[own])
            children = kids[node] if depth == end else int(not foreign(node, depth + 1))
            above = up if depth == top + 1 else node
            up_shared = shared(above, depth - 1) or depth == 1 and (offset > 0 or before >= 0 or after >= 0 or goes_on[0])
            yield (
                offset + depth, text.one[depth], text.two[depth], text.one[depth - 1], text.two[depth - 1], low[node], n[node], children, leaves[node], saved,
                sha if depth == end else None, shared(node, depth) or border and depth == end, up_shared, low[above],
            )


def _grow(strings: bool, segment_turns: int):
    """For mapInArrow over ordered strings: the nodes of their tries, or what each string owns of them and whether its end is a leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, trie, first, last, border = None, None, None, None, None

        def close() -> Iterator[pa.RecordBatch]:
            before, after = border
            if strings or any(t.leaf is None for group in trie.ends for t in group):
                inner = set(trie.parent)
                for node, group in enumerate(trie.ends):
                    for text in group:
                        goes_on = node in inner or any(not t.final for t in group) or node == trie.locate(last)[0] and after == len(last)
                        text.leaf = text.final and not goes_on
            if strings:
                rows = [(t.conv, key[1], t.size[-1] - t.size[max(at, min(before, len(t))) if t is first else at], t.leaf) for t, at in trie.new]
                yield _batch(_STRING, zip(*rows))
                return
            rows = list(expanded(trie, (first, last), before, after, key[1] * segment_turns))
            for start in range(0, len(rows), 1 << 14):
                yield _batch(_NODE, zip(*rows[start : start + (1 << 14)]))

        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            values = {c: column[c].to_pylist() for c in column if c != "turns"}
            cuts = np.concatenate(([0], np.cumsum(pc.list_value_length(column["turns"]).to_numpy(zero_copy_only=False)))).astype(np.int64).tolist()
            flat = column["turns"].flatten()
            ones, twos, sizes = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("one", "two", "size"))
            waiting: list[Text] = []
            for i in range(batch.num_rows):
                now = tuple(values[c][i] for c in ("part", "segment", "root_one", "root_two"))
                if now != key:
                    if trie:
                        trie.insert(waiting)
                        waiting = []
                        yield from close()
                    key, trie, first = now, ZFastTrie(), None
                    border = (values["before"][i], -1)
                at = slice(cuts[i], cuts[i + 1])
                sums = [[start, *((np.cumsum(x[at].astype(np.uint64)) + np.uint64(start)) & np.uint64(_MASK)).tolist()] for x, start in ((ones, now[2]), (twos, now[3]))]
                size = [values["root_size"][i], *(np.cumsum(sizes[at]) + values["root_size"][i]).tolist()]
                last = Text(*sums, size, *(values[c][i] for c in ("conv", "n", "whole", "sha", "final", "later", "leaf")))
                border = border[0], values["after"][i]
                first = first or last
                waiting.append(last)
            if trie:
                trie.insert(waiting)
        if trie:
            yield from close()

    return run


def _agreement(a: Column, b: Column) -> Column:
    """How many of two arrays' first elements are equal."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.coalesce(F.nullif(differs, F.lit(0)) - 1, F.least(F.size(a), F.size(b)))


def trie(turns: DataFrame, lengths: DataFrame, held: Scratch, *, segment_turns: int = SEGMENT, range_turns: int = RANGE_TURNS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """A row for each prefix of the conversations; turns: (conv, pos, one, two, size) of marked(), lengths: (conv, length) of all conversations.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the least member and that of
    the parent, the numbers of members, children and leaves below, the bytes of turns that are repeats in the subtree, and the
    hash of the ids of the members that end here.
    """
    spark = turns.sparkSession
    zero = F.lit(0).cast("long")
    sums = turns.groupBy("conv").agg(_wrapped_sum(F.col("one")).cast("long").alias("one"), _wrapped_sum(F.col("two")).cast("long").alias("two"), F.sum("size").alias("whole"))
    members = held.table(lengths.join(sums, "conv", "left").select("conv", "length", *[F.coalesce(c, zero).alias(c) for c in ("one", "two", "whole")]), "members")
    found = members.groupBy("one", "two", "length").agg(F.count("*").alias("n"), F.min("conv").alias("conv"), F.max("whole").alias("whole"))
    several = found.where("n > 1").count() > 0
    alone = F.sha2(F.col("conv").cast("string").cast("binary"), 256)
    if several:
        own = found.join(ends(members, held, piece_bytes), ["one", "two", "length"])
    else:
        own = found.withColumn("sha", alone)
    known = held.table(own.select("conv", "length", "n", "whole", "sha"), "known")
    size = known.agg(F.max("length").alias("longest"), F.sum("length").alias("turns"), F.count("*").alias("rows")).first()
    if not size.rows:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    # one string for each segment_turns turns of each different sequence
    segment = F.floor((F.col("pos") - 1) / segment_turns).cast("long").alias("segment")
    mine = turns.join(small(known.select("conv")), "conv", "left_semi")
    strings = mine.groupBy("conv", segment).agg(F.array_sort(F.collect_list(F.struct("pos", "one", "two", "size"))).alias("turns"))
    roots = ["root_one", "root_two", "root_size"]
    if size.longest > segment_turns:
        strings = held.table(strings, "strings")
        total = lambda c: F.aggregate("turns", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x[c].cast("decimal(38,0)")).cast("decimal(38,0)"))
        before = W.partitionBy("conv").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
        run = [F.coalesce(F.sum(total(c)).over(before) % _wrap(), F.lit(0)).cast("long").alias(r) for c, r in zip(("one", "two", "size"), roots)]
        strings = strings.join(small(held.table(strings.select("conv", "segment", *run), "roots")), ["conv", "segment"])
    else:
        strings = strings.select("conv", "segment", *[zero.alias(r) for r in roots], "turns")
    empty = known.where("length = 0").select("conv", zero.alias("segment"), *[zero.alias(r) for r in roots], F.expr("cast(array() as array<struct<pos: bigint, one: bigint, two: bigint, size: bigint>>)").alias("turns"))
    final = (F.col("segment") == F.greatest(zero, F.floor((F.col("length") - 1) / segment_turns))).alias("final")
    texts = held.table(strings.unionByName(empty).join(small(known), "conv").select("segment", *roots, "turns", "conv", "n", "whole", "sha", final), "texts")
    order = ["segment", "root_one", "root_two", "turns"]
    parts = max(min(spark.sparkContext.defaultParallelism, -(-size.rows // 1000)), -(-size.turns // range_turns), 1)
    ranged = texts.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id().cast("long"), "number": F.monotonically_increasing_id()})
    ordered = held.table(ranged, "ordered")
    # how far the strings at the borders of ranges agree; a row for each range
    root = F.struct(*order[:3])
    edge = F.struct(root.alias("root"), "turns")
    edges = ordered.groupBy("part").agg(F.min_by(edge, "number").alias("first"), F.max_by(edge, "number").alias("last"))
    by_part = W.orderBy("part")
    near = edges.withColumns({"left": F.lag("last").over(by_part), "right": F.lead("first").over(by_part)})
    agree = lambda a, b: F.when(F.col(f"{a}.root") == F.col(f"{b}.root"), _agreement(F.col(f"{a}.turns"), F.col(f"{b}.turns"))).otherwise(-1).cast("long")
    told = held.table(near.select("part", agree("left", "first").alias("before"), agree("last", "right").alias("after"), F.col("first.root").alias("top"), F.col("last.root").alias("bottom")), "borders")
    # a row for each range; borders count for the first and the last trie of a range only
    placed = ordered.join(F.broadcast(told), "part")
    placed = placed.withColumns({c: F.when(root == F.col(e), F.col(c)).otherwise(-1) for c, e in (("before", "top"), ("after", "bottom"))}).drop("top", "bottom")
    dealt = lambda df: df.repartition(parts, "part").sortWithinPartitions("part", "number")
    if size.longest > segment_turns:
        plain = placed.withColumns({"later": zero, "leaf": F.lit(None).cast("boolean")})
        each = held.table(dealt(plain).mapInArrow(released(_grow(True, segment_turns)), _STRING), "owned")
        after = W.partitionBy("conv").orderBy(F.desc("segment"))
        each = each.select("conv", "segment", F.coalesce(F.sum("owned").over(after.rowsBetween(W.unboundedPreceding, -1)), zero).alias("later"), F.first("leaf").over(after.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("leaf"))
        placed = placed.join(small(held.table(each, "later-strings")), ["conv", "segment"])
    else:
        placed = placed.withColumns({"later": zero, "leaf": F.lit(None).cast("boolean")})
    nodes = held.table(dealt(placed).mapInArrow(released(_grow(False, segment_turns)), _NODE), "nodes")
    key = ["depth", "one", "two"]
    adds = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    # what goes on from the end of a segment is shared, though its parent may not be
    up = [F.max("up_one").alias("up_one"), F.max("up_two").alias("up_two"), F.min("up_low").alias("up_low"), F.max("up_shared").alias("up_shared")]
    merged = held.table(nodes.where("shared").groupBy(*key).agg(*up, F.min("low").alias("low"), *adds, F.max("sha").alias("sha")), "merged")
    above = small(merged).select((F.col("depth") + 1).alias("depth"), F.col("one").alias("up_one"), F.col("two").alias("up_two"), F.col("low").alias("up_low"))
    columns = ["low", "depth", "up_low", "n", "children", "leaves", "saved", "sha"]
    every = nodes.where("not shared").select(*merged.columns).union(merged)
    asks = every.where("up_shared").drop("up_low").join(above, ["depth", "up_one", "up_two"])
    rows = every.where("not up_shared").select(*columns).union(asks.select(*columns))
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select(
        F.col("low").alias("conv_id"), "depth", F.col("up_low").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", nobody).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, *, sizes: dict[str, int] | None = None, **columns: str) -> DataFrame:
    """The trie of conversations as they are; sizes: of trie()."""
    held = Scratch(conversations.sparkSession, "trie")
    turns, counts = positions(conversations, held, **columns)
    return trie(held.table(marked(turns), "marked"), counts.select("conv", F.col("n").alias("length")), held, **(sizes or {}))


#: How op12 rebuilds conversations: `FAMILY` ids begin with up to `HEADS` - 1 turns of the first of them.
FAMILY, HEADS = 5, 9


def rebuilt(turns: DataFrame, counts: DataFrame, held: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations that begin with the first turns of conversation c - c % FAMILY, as many as c's hash says."""
    head = lambda c: F.crc32(c.cast("string").cast("binary")) % HEADS
    base = lambda c: c - c % FAMILY
    conv, pos = F.col("conv"), F.col("pos")
    counts = held.table(counts, "counts")
    heads = counts.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    known = counts.select("conv", "n", head(conv).alias("head"), base(conv).alias("base")).join(small(heads), "base", "left")
    taken = F.least("head", F.coalesce("base_n", F.lit(0)))
    known = held.table(known.select("conv", "head", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length")), "known-lengths")
    shifts = small(held.table(known.where("taken < head").select("conv", (F.col("taken") - F.col("head")).alias("shift")), "shifts"))
    own = turns.where(pos > head(conv)).join(shifts, "conv", "left").select("conv", (pos + F.coalesce("shift", F.lit(0))).alias("pos"), "digest", "size")
    # a base has turns for FAMILY conversations, those around 0 for both signs
    heirs = F.filter(F.transform(F.sequence(F.lit(1 - FAMILY), F.lit(FAMILY - 1)), lambda i: conv + i), lambda c: (base(c) == conv) & (head(c) >= pos))
    given = turns.where((conv % FAMILY == 0) & (pos < HEADS)).select(F.explode(heirs).alias("conv"), "pos", "digest", "size")
    given = given.join(small(counts.select("conv")), "conv", "left_semi")
    return own.union(given), known.select("conv", "length")


def op12_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = Scratch(spark, "trie")
    turns, counts = positions(table(spark, sf_dir, "conversations"), held)
    turns, lengths = rebuilt(turns, counts, held)
    return trie(held.table(marked(turns), "marked"), lengths, held)


OP12_SQL = """
WITH RECURSIVE
bits AS (SELECT generate_series(1, 8) AS eight),
o AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p,
    struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS v, strlen(coalesce(text, '')) AS b
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT c, c - c % 5 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda s, x: list_reduce(list_prepend(xor(s, x), eight), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT c FROM o), bits),
u AS (
  SELECT k.c, 0 AS own, o.p, o.v, o.b FROM k JOIN o ON o.c = k.base AND o.p <= k.h
  UNION ALL SELECT k.c, 1, o.p, o.v, o.b FROM k JOIN o ON o.c = k.c AND o.p > k.h),
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, v, b FROM u),
x AS (
  SELECT c, d, b, md5(string_agg(len(v.r) || ':' || len(v.t) || ':' || v.r || v.t, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM t
  UNION ALL SELECT c, 0, 0, '' FROM k),
l AS (SELECT c, max(d) AS d FROM x GROUP BY c),
n AS (SELECT d, key, min(c) AS conv_id, count(*) AS n, any_value(b) AS b FROM x GROUP BY d, key),
up AS (SELECT DISTINCT a.d, a.key, b.key AS up FROM x a JOIN x b ON a.c = b.c AND b.d = a.d - 1),
kids AS (SELECT d - 1 AS d, up AS key, count(*) AS kids FROM up GROUP BY ALL),
below AS (SELECT DISTINCT a.d, a.key, b.d AS bd, b.key AS bkey FROM x a JOIN x b ON a.c = b.c AND b.d >= a.d),
s AS (
  SELECT below.d, below.key, count(*) FILTER (kids.kids IS NULL) AS leaves, sum((n.n - 1) * n.b)::BIGINT AS saved
  FROM below JOIN n ON n.d = bd AND n.key = bkey LEFT JOIN kids ON kids.d = bd AND kids.key = bkey GROUP BY ALL),
e AS (SELECT x.d, x.key, sha256(string_agg(x.c::VARCHAR, ',' ORDER BY x.c)) AS sha FROM x JOIN l USING (c, d) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(kids.kids, 0) AS n_children, s.leaves AS n_leaves,
  s.saved AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM n JOIN s USING (d, key) LEFT JOIN kids USING (d, key) LEFT JOIN e USING (d, key) LEFT JOIN up USING (d, key)
LEFT JOIN n m ON m.d = n.d - 1 AND m.key = up.up
"""
