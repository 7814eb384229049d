"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes when a string of `length` bytes that covers it also starts earlier, in a document of smaller id or
before in the same one. Suffixes are sorted at content-defined places only, which is enough:

1. A string of `length` bytes has one anchor: of the hashes of its `K`-byte substrings the least, the last of
   equal ones. Neighbouring starts with one anchor form a chunk. Equal strings have equal anchors at the same
   distance from their starts, so chunks whose anchor occurs once, as a table of fixed size tells, need no sorting.
2. Of every other chunk a task takes the suffix at its anchor, as far as its last string ends, followed by the bytes
   from the anchor back to its first start. It sorts its suffixes and front-codes the run: of each suffix only the
   length of the prefix it shares with the one before it, and the rest. Of equal chunks a run keeps the first; the
   others repeat it and skip the exchange of bytes. Runs are exchanged by ranges of the anchor.
3. A task merges the runs of its range with a loser tree that carries, for each head, the length of the prefix
   that it shares with the last winner. Of two heads, the one that shares more comes first, without a look at the
   bytes; only if both share as much, bytes are compared, from there on.
4. The merged order decides what repeats. At a distance r from the anchor, two strings are equal if their suffixes
   share length - r bytes and the bytes before their anchors share r. Both are runs of neighbours: the first in the
   merged order, by the prefixes that the tree already knows, the second in an order of the bytes before. All but
   the first in document order of those that stand in the same two runs repeat it.

An anchor that makes up more than a ten-thousandth of all is dealt over the ranges by its suffixes instead, so that
no range holds it whole. There its equal chunks meet; the strings of those that are left go one by one through a
second sort of the same kind. There are at most ten thousand such anchors.

Defined cases: a null text is empty; of equal ids the row with the smaller text hash, and of equal rows any, is
the earlier one; documents shorter than `length` and empty tables are left as they are; null ids come last; texts of
any length are taken whole, in pieces that overlap; columns other than those asked for are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailspark.llm.common import Scratch, stored, table
from trailspark.llm.filters import codes, repeated_codes, repeats

LENGTH, K = 100, 24
#: An anchor is hot above both of these: a number, and this part of all anchors that repeat.
HOT_LEAST, HOT_PARTS = 1000, 10_000
#: Suffixes in a range, about, and in a run.
RANGE_SUFFIXES, RUN_SUFFIXES = 60_000, 120_000
#: Bytes of texts that are looked at together; consecutive pieces of a longer text overlap.
PIECE = 1 << 17
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POSITION_BITS = 20
_POSITIONS = np.uint64((1 << _POSITION_BITS) - 1)


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all K-byte substrings."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).copy()
    n = len(data) - K + 1
    mixed = words[:n] * _A
    for at in range(8, K, 8):
        mixed ^= mixed >> np.uint64(29)
        mixed += words[at : at + n]
        mixed *= _B if at == 8 else _A
    mixed ^= mixed >> np.uint64(32)
    mixed *= _B
    return mixed


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values."""
    step, now = 1, values
    while step * 2 <= width:
        now = np.minimum(now[:-step], now[step:])
        step *= 2
    return now if step == width else np.minimum(now[: len(now) - (width - step)], now[width - step :])


class Chunks:
    """The chunks of some texts: which text, its bytes' place in `data`, first start, number of starts, place and hash of the anchor."""

    def __init__(self, pieces: list[tuple[int, int, bytes]], length: int):
        self.data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        sizes = np.array([len(p[2]) for p in pieces])
        offsets = np.cumsum(sizes) - sizes
        hashes = _hashes(self.data)
        keyed = (hashes & ~_POSITIONS) | (_POSITIONS - np.arange(len(hashes), dtype=np.uint64))
        least = _least(keyed, length - K + 1)
        edges = np.zeros(len(self.data) + 1, np.int8)
        edges[offsets] = 1
        edges[offsets + sizes - length + 1] -= 1
        starts = np.flatnonzero(np.cumsum(edges, dtype=np.int8))
        anchor = least[starts]
        cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))))
        self.first, self.width = starts[cut], np.diff(np.append(cut, len(starts)))
        self.anchor = (_POSITIONS - (anchor[cut] & _POSITIONS)).astype(np.int64)
        self.hash = hashes[self.anchor]
        piece = np.searchsorted(offsets, self.first, "right") - 1
        self.text = np.array([p[0] for p in pieces])[piece]
        self.ahead = np.array([p[1] for p in pieces])[piece] - offsets[piece]  # from places in data to places in the text


def chunks(texts: list[str | None], length: int = LENGTH) -> Iterator[Chunks]:
    """The chunks of the texts, a limited number of bytes at a time."""
    pieces, size = [], 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if text else b""
        for at in range(0, len(data) - length + 1, PIECE):
            pieces.append((i, at, data[at : at + PIECE + length - 1]))
            size += len(pieces[-1][2])
            if size > PIECE:
                yield Chunks(pieces, length)
                pieces, size = [], 0
    if pieces:
        yield Chunks(pieces, length)


def front_code(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of each sorted suffix the length of the prefix shared with the one before it, and the rest."""
    shared, rest, last = [], [], b""
    for s in suffixes:
        n = _common(last, s, 0)
        shared.append(n)
        rest.append(s[n:])
        last = s
    return shared, rest


def _common(a: bytes, b: bytes, start: int) -> int:
    """The length of the common prefix of a and b, which is at least start."""
    most = min(len(a), len(b))
    differ = int.from_bytes(a[start:most]) ^ int.from_bytes(b[start:most])
    return most - (differ.bit_length() + 7) // 8


class _Run:
    """A front-coded run: the current suffix and the prefix that it shares with the last one taken from anywhere."""

    __slots__ = ("entries", "suffix", "shared", "tag", "number")

    def __init__(self, entries: Iterator[tuple], number: int):
        self.entries, self.suffix, self.shared, self.tag, self.number = iter(entries), b"", 0, None, number
        self.advance()

    def advance(self) -> None:
        """To the next suffix; the last one taken from this run was the last one taken at all."""
        found = next(self.entries, None)
        if found is None:
            self.suffix = self.tag = None
        else:
            self.shared, rest, self.tag = found
            self.suffix = self.suffix[: self.shared] + rest


def _before(a: _Run, b: _Run) -> bool:
    """Whether a's suffix is the lesser; the loser learns the prefix that it shares with the winner."""
    if a.suffix is None:
        return False
    if b.suffix is None:
        return True
    if a.shared != b.shared:
        return a.shared > b.shared  # the loser shares as much with the winner as with the last one
    n = _common(a.suffix, b.suffix, a.shared)
    first = a.suffix[n:] <= b.suffix[n:]
    (b if first else a).shared = n
    return first


def merge(runs: list) -> Iterator[tuple[int, bytes, object]]:
    """(shared, suffix, tag) of all front-coded runs in order; entries are (shared, rest, tag)."""
    heads = [_Run(r, i) for i, r in enumerate(runs)]
    n = len(heads)
    if not n:
        return
    losers: list[_Run | None] = [None] * n

    def build(node: int) -> _Run:
        if node >= n:
            return heads[node - n]
        a, b = build(2 * node), build(2 * node + 1)
        won, lost = (a, b) if _before(a, b) else (b, a)
        losers[node] = lost
        return won

    winner = build(1) if n > 1 else heads[0]
    while winner.suffix is not None:
        yield winner.shared, winner.suffix, winner.tag
        node = (winner.number + n) // 2
        winner.advance()
        while node:
            other = losers[node]
            if winner.suffix is None or other.shared >= winner.shared and other.suffix is not None:
                # what shares less loses at once; only equal ones are compared
                if not _before(winner, other):
                    winner, losers[node] = other, winner
            node //= 2


#: A run of a range in one row: front-coded suffixes, and of each the document, the anchor's place there, and the least and greatest distance of a start.
_RUN = "range int, shared binary, sizes binary, rest binary, doc_key binary, place binary, near binary, far binary"
_RUN_KINDS = (pa.int32(), *[pa.binary()] * 7)
_RUN_NAMES = ["range", "shared", "sizes", "rest", "doc_key", "place", "near", "far"]


class _Runs:
    """Collects suffixes as rows of a matrix and gives them away as sorted, front-coded runs, one for each range."""

    def __init__(self, ranges: int):
        self.ranges, self.held, self.size = ranges, [], 0

    def add(self, suffixes: np.ndarray, sizes: np.ndarray, which: np.ndarray, doc: np.ndarray, place: np.ndarray, near: np.ndarray, far: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((suffixes, sizes, which, doc, place, near, far))
        self.size += len(sizes)
        if self.size > RUN_SUFFIXES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        wide = max(h[0].shape[1] for h in self.held)
        rows = np.zeros((self.size, wide), np.uint8)
        at = 0
        for h in self.held:
            rows[at : at + len(h[0]), : h[0].shape[1]] = h[0]
            at += len(h[0])
        sizes, which, doc, place, near, far = (np.concatenate(x) for x in list(zip(*self.held))[1:])
        self.held, self.size = [], 0
        order = np.lexsort((place, doc, near, sizes, rows.view(f"S{wide}").ravel(), which))
        rows, sizes, which, doc, place, near, far = (x[order] for x in (rows, sizes, which, doc, place, near, far))
        same_range = which[1:] == which[:-1]
        equal = np.concatenate(([False], same_range & (near[1:] == near[:-1]) & (sizes[1:] == sizes[:-1]) & (rows[1:] == rows[:-1]).all(1)))
        again = np.flatnonzero(equal)
        for lo in range(0, len(again), 1 << 16):
            some = again[lo : lo + (1 << 16)]
            yield self._row(int(which[some[0]]), None, None, None, doc[some], place[some], near[some], far[some])
        keep = ~equal
        rows, sizes, which, doc, place, near, far = (x[keep] for x in (rows, sizes, which, doc, place, near, far))
        shared = np.concatenate(([0], common_prefixes(rows, sizes)))
        cuts = np.concatenate(([0], np.flatnonzero(which[1:] != which[:-1]) + 1, [len(which)]))
        shared[cuts[:-1]] = 0
        columns = np.arange(rows.shape[1])
        rest = (columns >= shared[:, None]) & (columns < sizes[:, None])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield self._row(int(which[lo]), shared[lo:hi].astype(np.uint8), sizes[lo:hi].astype(np.uint8), rows[lo:hi][rest[lo:hi]], doc[lo:hi], place[lo:hi], near[lo:hi], far[lo:hi])

    @staticmethod
    def _row(which: int, shared, sizes, rest, doc, place, near, far) -> pa.RecordBatch:
        data = [None if x is None else x.tobytes() for x in (shared, sizes, rest)]
        data += [doc.astype(np.int64).tobytes(), place.astype(np.int64).tobytes(), near.astype(np.uint8).tobytes(), far.astype(np.uint8).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((which, *data), _RUN_KINDS)], names=_RUN_NAMES)


def common_prefixes(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The length of the common prefix of each row (padded, of the given size) but the first and the one before it."""
    if len(rows) < 2:
        return np.zeros(0, np.int64)
    out = np.empty(len(rows) - 1, np.int64)
    for lo in range(0, len(out), 1 << 14):
        hi = min(lo + (1 << 14), len(out))
        differ = rows[lo + 1 : hi + 1] != rows[lo:hi]
        out[lo:hi] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.minimum(out, np.minimum(sizes[1:], sizes[:-1]))


def _dealt(rows: np.ndarray, ranges: int) -> np.ndarray:
    """A range for each row by all its bytes."""
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    mixed = np.zeros(len(rows), np.uint64)
    for column in words.view("<u8").T:
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _A + column
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _B
    return ((mixed >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32)


def _suffixes(found: Chunks, some: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, sizes, near, far): from the anchor to the end of the last string, then back from the anchor to the first start."""
    far = found.anchor[some] - found.first[some]
    near = far - found.width[some] + 1
    right = length - near
    sizes = right + far
    columns = np.arange(2 * length - K)
    rows = np.zeros((len(some), len(columns)), np.uint8)
    for lo in range(0, len(some), 4096):
        part = slice(lo, lo + 4096)
        ahead = columns[None, :] - right[part, None]
        at = found.anchor[some][part, None] + np.where(ahead < 0, columns[None, :], -1 - ahead)
        rows[part] = np.where(columns[None, :] < sizes[part, None], found.data[np.clip(at, 0, len(found.data) - 1)], 0)
    return rows, sizes, near, far


def _sorted_runs(sent, hot, ranges: int, length: int):
    """For mapInArrow over (key, body): front-coded runs of each task's suffixes; rows without `rest` hold repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, often, runs = sent.value, hot.value, _Runs(ranges)
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for found in chunks(batch.column("body").to_pylist(), length):
                some = np.flatnonzero(repeats(bits, found.hash))
                rows, sizes, near, far = _suffixes(found, some, length)
                which = ((found.hash[some] >> np.uint64(20)) % np.uint64(ranges)).astype(np.int32)
                crowd = np.isin(codes(found.hash[some]), often)
                which[crowd] = _dealt(rows[crowd], ranges)
                yield from runs.add(rows, sizes, which, keys[found.text[some]], found.anchor[some] + found.ahead[some], near, far)
        yield from runs.flush()

    return run


def _string_runs(ranges: int, length: int):
    """For mapInArrow over chunks (doc_key, start, width, data): front-coded runs of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(ranges)
        for batch in batches:
            docs, starts, widths = (batch.column(c).to_numpy() for c in ("doc_key", "start", "width"))
            data = batch.column("data")
            for lo in range(0, len(docs), 512):
                some = slice(lo, lo + 512)
                flat = np.frombuffer(b"".join(data[i].as_py() for i in range(lo, min(lo + 512, len(docs)))), np.uint8)
                w = widths[some].astype(np.int64)
                offsets = np.cumsum(w + length - 1) - (w + length - 1)
                number = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                rows = np.lib.stride_tricks.sliding_window_view(flat, length)[np.repeat(offsets, w) + number]
                nil = np.zeros(len(rows), np.int64)
                yield from runs.add(rows, nil + length, _dealt(rows, ranges), np.repeat(docs[some], w), np.repeat(starts[some], w) + number, nil, nil)
        yield from runs.flush()

    return run


def _entries(row: dict, base: int) -> Iterator[tuple]:
    """The entries of a front-coded run, tagged by number."""
    rest, at = row["rest"], 0
    for i, (shared, size) in enumerate(zip(row["shared"], row["sizes"])):
        end = at + size - shared
        yield shared, rest[at:end], base + i
        at = end


def _again(shared: np.ndarray, suffixes: list[bytes], doc: np.ndarray, place: np.ndarray, near: np.ndarray, far: np.ndarray, length: int) -> np.ndarray:
    """For suffixes in merged order, which strings (by row, and distance from the anchor) repeat one earlier in document order."""
    n = len(suffixes)
    out = np.zeros((n, length - K + 1), bool)
    before = [s[length - int(k) :] for s, k in zip(suffixes, near)]  # the bytes before the anchor, backwards
    wide = max(1, max(map(len, before)))
    left = np.zeros((n, wide), np.uint8)
    for i, b in enumerate(before):
        left[i, : len(b)] = np.frombuffer(b, np.uint8)
    by_left = np.argsort(left.view(f"S{wide}").ravel(), kind="stable")
    left_shared = common_prefixes(left[by_left], np.full(n, wide))
    earlier = np.lexsort((place, doc))  # rows in document order, of one distance too
    for r in range(length - K + 1):
        rows = earlier[(near[earlier] <= r) & (r <= far[earlier])]
        if len(rows) < 2:
            continue
        right_run = np.concatenate(([0], np.cumsum(shared[1:] < length - r)))
        left_run = np.empty(n, np.int64)
        left_run[by_left] = np.concatenate(([0], np.cumsum(left_shared < r)))
        key = right_run[rows] * n + left_run[rows]
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]]) + 1
        out[rows[order[same]], r] = True
    return out


def _merged(hot, length: int):
    """For applyInArrow by range: (doc_key, start, width, data): starts of repeated strings; with data, a chunk of a hot anchor that is left."""

    def group(part: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # doc_key, start, width
        numbers = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
        everything = part.to_pylist()
        rows = [r for r in everything if r["rest"] is None]
        if rows:
            near, far = numbers("near", np.uint8).astype(np.int64), numbers("far", np.uint8).astype(np.int64)
            out.append((numbers("doc_key", np.int64), numbers("place", np.int64) - far, far - near + 1))
        rows = [r for r in everything if r["rest"] is not None]
        crowd = None
        if rows:
            doc, place = numbers("doc_key", np.int64), numbers("place", np.int64)
            near, far = numbers("near", np.uint8).astype(np.int64), numbers("far", np.uint8).astype(np.int64)
            bases = np.cumsum([0] + [len(r["sizes"]) for r in rows]).tolist()
            shared, suffixes, tags = (list(x) for x in zip(*merge([_entries(r, b) for r, b in zip(rows, bases)])))
            shared, tags = np.array(shared), np.array(tags)
            doc, place, near, far = doc[tags], place[tags], near[tags], far[tags]
            # equal chunks: the same suffix with the same distances
            sizes = np.array([len(s) for s in suffixes])
            new = np.concatenate(([True], (shared[1:] < sizes[1:]) | (shared[1:] < sizes[:-1])))
            number = np.cumsum(new) - 1
            order = np.lexsort((place, doc, near, number))
            twin = np.concatenate(([False], (number[order[1:]] == number[order[:-1]]) & (near[order[1:]] == near[order[:-1]])))
            gone = np.zeros(len(order), bool)
            gone[order[twin]] = True
            out.append((doc[gone], place[gone] - far[gone], (far - near + 1)[gone]))
            kept = np.flatnonzero(~gone)
            if hot is not None:
                # suffixes left that share an anchor with others; what a skipped one shared less, the next one shares less
                shared = np.minimum.reduceat(shared[: kept[-1] + 1], np.concatenate(([0], kept[:-1] + 1)))
                doc, place, near, far, suffixes = doc[kept], place[kept], near[kept], far[kept], [suffixes[i] for i in kept]
                anchor = np.cumsum(np.concatenate(([True], shared[1:] < K))) - 1
                heads = np.frombuffer(b"".join(s[:K] for s in suffixes), np.uint8).reshape(-1, K)
                often = np.isin(codes(_anchor_hashes(heads)), hot.value)
                crowd = [(d, p - f, f - n + 1, (s[length - n :][::-1] + s[: length - n])) for d, p, n, f, s in ((int(doc[i]), int(place[i]), int(near[i]), int(far[i]), suffixes[i]) for i in np.flatnonzero(often))]
                some = np.flatnonzero((np.bincount(anchor)[anchor] > 1) & ~often)
                if len(some):
                    fewer = np.minimum.reduceat(shared[: some[-1] + 1], np.concatenate(([0], some[:-1] + 1)))
                    strings = _again(fewer, [suffixes[i] for i in some], doc[some], place[some], near[some], far[some], length)[:, ::-1]
                    flags = np.zeros((len(some), strings.shape[1] + 2), np.int8)
                    flags[:, 1:-1] = strings
                    row, begin = np.nonzero(np.diff(flags, axis=1) == 1)
                    end = np.nonzero(np.diff(flags, axis=1) == -1)[1]
                    out.append((doc[some][row], place[some][row] - (strings.shape[1] - 1 - begin), end - begin))
        doc, start, width = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        found = [pa.array(doc), pa.array(start), pa.array(width.astype(np.int32)), pa.nulls(len(doc), pa.binary())]
        names = ["doc_key", "start", "width", "data"]
        plain = pa.Table.from_arrays(found, names=names)
        if not crowd:
            return plain
        return pa.concat_tables([plain, pa.Table.from_arrays([pa.array(v, k) for v, k in zip(zip(*crowd), kinds)], names=names)])

    return group


def _anchor_hashes(heads: np.ndarray) -> np.ndarray:
    """The hashes of K bytes a row."""
    words = np.ascontiguousarray(heads).view("<u8")
    mixed = words[:, 0] * _A
    for i in range(1, K // 8):
        mixed ^= mixed >> np.uint64(29)
        mixed += words[:, i]
        mixed *= _B if i == 1 else _A
    mixed ^= mixed >> np.uint64(32)
    mixed *= _B
    return mixed


def repeated(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """(key, starts, widths): runs of starts of repeated strings in the documents (key long, body string); keys order the documents."""
    spark = docs.sparkSession
    held, send = Scratch(spark, "suffix"), spark.sparkContext.broadcast

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for found in chunks(batch.column("body").to_pylist(), length):
            yield found.hash

    bits, hot, total = repeated_codes(docs.select("body"), anchors, least=HOT_LEAST, share=HOT_PARTS)
    often = send(hot)
    ranges = max(64, -(-total // RANGE_SUFFIXES))
    schema = "doc_key long, start long, width int, data binary"
    runs = docs.select("key", "body").mapInArrow(_sorted_runs(send(bits), often, ranges, length), _RUN)
    found = held.table(runs.groupBy("range").applyInArrow(_merged(often, length), schema), "chunks")
    parts = found.where("data IS NULL").drop("data")
    if len(hot):
        left = found.where("data IS NOT NULL")
        strings = left.agg(F.coalesce(F.sum("width"), F.lit(0))).first()[0]
        ranges = max(64, -(-strings // RANGE_SUFFIXES))
        runs = left.mapInArrow(_string_runs(ranges, length), _RUN)
        more = held.table(runs.groupBy("range").applyInArrow(_merged(None, length), schema), "strings")
        parts = parts.unionByName(more.drop("data"))
    return parts.groupBy(F.col("doc_key").alias("key")).agg(F.collect_list("start").alias("starts"), F.collect_list("width").alias("widths"))


def _cut(length: int):
    """For mapInArrow: the sizes and the digest of what is left of each text, and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, widths in zip(*(batch.column(c).to_pylist() for c in ("body", "starts", "widths"))):
                data = (text or "").encode("utf-8", "surrogatepass")
                kept, removed, spans, at = [], 0, 0, 0
                for s, e in _joined(starts, widths, length):
                    kept.append(data[at:s])
                    removed, spans, at = removed + e - s, spans + 1, e
                kept.append(data[at:])
                left = b"".join(kept)
                rows.append((len(data), removed, spans, hashlib.sha256(left).hexdigest(), left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *[pa.array(v, k) for v, k in zip(zip(*rows) if rows else [[]] * 5, kinds)]], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _joined(starts: list[int] | None, widths: list[int] | None, length: int) -> Iterator[tuple[int, int]]:
    """The maximal covered runs of bytes."""
    now = None
    for s, w in sorted(zip(starts or [], widths or [])):
        e = s + w + length - 1
        if now and s <= now[1]:
            now = (now[0], max(e, now[1]))
        else:
            if now:
                yield now
            now = (s, e)
    if now:
        yield now


def dedup(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row of docs."""
    named = docs.select(F.col(doc).alias("doc"), F.col(text).alias("body"))
    kind = dict(named.dtypes)["doc"]
    # keys that order the documents: the ids themselves where those are distinct whole numbers
    ids = named.agg(F.count("*").alias("n"), F.count("doc").alias("filled")).first()
    plain = kind in ("bigint", "int") and ids["n"] == ids["filled"] and not named.groupBy("doc").count().where("count > 1").limit(1).count()
    keyed = named.withColumn("key", F.col("doc").cast("long")) if plain else _numbered(named)
    found = repeated(keyed.select("key", "body"), length=length)
    return keyed.join(found, "key", "left").select("doc", "body", "starts", "widths").mapInArrow(_cut(length), f"doc {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _numbered(named: DataFrame) -> DataFrame:
    """Rows in order of id and text hash, numbered from 0: by ranges, with a prefix sum over their sizes."""
    ordered = stored(named.withColumn("hash", F.xxhash64("body")).repartitionByRange(F.col("doc").asc_nulls_last(), "hash").sortWithinPartitions(F.col("doc").asc_nulls_last(), "hash").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "suffix-docs")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    base = sizes.select("part", "least", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each range
    return ordered.join(F.broadcast(base), "part").select("doc", "body", (F.col("base") + F.col("at") - F.col("least")).alias("key"))


def op3_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
