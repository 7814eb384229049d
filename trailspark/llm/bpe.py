"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task takes a block of documents, splits the texts into words, keeps the distinct words as one array of
token ids with links to both neighbours, and an inverted index from the rank of a token pair to the positions
where the pair stands. The merges are then replayed over the whole block in rank order: each takes its
positions from the index, joins the pairs, and looks up only the pairs with the neighbours that it touched.
Documents are put together from the results of their words. Blocks are independent, so nothing is shuffled.

That one merge may be applied everywhere at once rests on a property of trained vocabularies: the bytes of a
token encode to that token. tests/llm checks it for the given ranks, and the results against tiktoken.

Defined cases: a null text counts as empty, which has no tokens; equal rows get equal results; columns other
than those asked for are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from trailspark.llm.common import release, table

#: Bytes of text whose words are merged together.
BLOCK_BYTES = 3 << 20
#: A space that doesn't start a word of the split below.
_LOOSE_SPACE = re.compile(r" (?:\s|\Z)")


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [found[i] for i in range(len(found))]


class Vocabulary:
    """Tokens by id, and the pairs of ids whose bytes joined are a token, sorted by a code of both ids."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        ids = {t: i for i, t in enumerate(tokens)}
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {ids[t[:k]] * len(tokens) + ids[t[k:]]: i for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}
        self.codes = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[c] for c in self.codes.tolist()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to; -1 where none."""
        if not len(self.codes):
            return np.full(len(left), -1, np.int64)
        code = left * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.merged[at], -1)


def _distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, once each."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one after another, and where each word's ids begin (one more entry at the end)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths)))
    n = int(starts[-1])
    ids = vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    full = lengths > 0
    after[starts[1:][full] - 1] = -1
    before[starts[:-1][full]] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    due: list[int] = []

    def enter(places: np.ndarray) -> None:
        """Put the pairs that begin at these places into the index."""
        ranks = vocabulary.rank(ids[places], ids[after[places]])
        places, ranks = places[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
        for rank, a, b in zip(ranks[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(ranks)]):
            if rank not in index:
                index[rank] = []
                heapq.heappush(due, rank)
            index[rank].append(places[a:b])

    enter(np.flatnonzero(after >= 0))
    while due:
        rank = heapq.heappop(due)
        found = index.pop(rank)
        places = _distinct(np.concatenate(found)) if len(found) > 1 else found[0]
        places = places[alive[places]]
        places = places[after[places] >= 0]
        places = places[vocabulary.rank(ids[places], ids[after[places]]) == rank]
        if not len(places):
            continue
        # of pairs that overlap in a row, every second one stays
        tied = np.zeros(len(places), bool)
        tied[1:] = after[places[:-1]] == places[1:]
        if tied.any():
            at = np.arange(len(places))
            head = np.maximum.accumulate(np.where(tied, 0, at))
            places = places[(at - head) % 2 == 0]
        gone = after[places]
        alive[gone] = False
        ids[places] = rank
        after[places] = after[gone]
        nexts = after[places]
        before[nexts[nexts >= 0]] = places[nexts >= 0]
        lefts = before[places]
        touched = np.concatenate((lefts[lefts >= 0], places[nexts >= 0]))
        if len(touched):
            enter(_distinct(touched))
    counts = np.concatenate(([0], np.cumsum(alive)))
    return ids[alive], counts[starts]


class _Numbers(dict):
    """Numbers pieces of text, each standing after the given prefix, and appends the words of new ones to `pieces`."""

    def __init__(self, split, prefix: str, pieces: list[list[str]]):
        super().__init__()
        self.split, self.prefix, self.pieces = split, prefix, pieces

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self.pieces)
        self.pieces.append(self.split(self.prefix + piece))
        return number


def encode_block(texts: list[str], vocabulary: Vocabulary, pattern) -> list[np.ndarray]:
    """The ids of each text.

    Words never hold a space but as their first character, so a text may be cut before each space that another
    character follows; only the distinct pieces go through the pattern.
    """
    pieces: list[list[str]] = []
    first, spaced = _Numbers(pattern.findall, "", pieces), _Numbers(pattern.findall, " ", pieces)
    plan = []
    for text in texts:
        if _LOOSE_SPACE.search(text):
            plan.append([first[word] for word in pattern.findall(text)])
        else:
            head, *rest = text.split(" ")
            plan.append([*([first[head]] if head else []), *map(spaced.__getitem__, rest)])
    numbers: dict[str, int] = {}
    flat = [numbers.setdefault(word, len(numbers)) for piece in pieces for word in piece]
    ids, starts = replay([word.encode() for word in numbers], vocabulary)
    # ids of the pieces: those of their words in a row
    word_of, per_piece = np.array(flat, np.int64), np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat_ids, flat_starts = _gather(ids, starts, word_of)
    piece_starts = flat_starts[np.concatenate(([0], np.cumsum(per_piece)))]
    return [_gather(flat_ids, piece_starts, np.array(chosen, np.int64))[0] for chosen in plan]


def _gather(values: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[starts[i]:starts[i + 1]] for each i in chosen, in a row, and where each begins."""
    lengths = starts[chosen + 1] - starts[chosen]
    ends = np.cumsum(lengths)
    begin = np.concatenate(([0], ends)).astype(np.int64)
    at = np.arange(begin[-1]) + np.repeat(starts[chosen] - begin[:-1], lengths)
    return values[at], begin


def _blocks(batches: Iterator[pa.RecordBatch], text: str, block_bytes: int) -> Iterator[tuple[pa.Table, list[str]]]:
    """The rows in pieces of about block_bytes of text, a row at least, across batches."""
    held: list[pa.RecordBatch] = []
    size = 0

    def block() -> tuple[pa.Table, list[str]]:
        part = pa.Table.from_batches(held).combine_chunks()
        return part, [t or "" for t in part.column(text).to_pylist()]

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > block_bytes:
                held.append(batch.slice(start, i - start))
                yield block()
                held, size, start = [], 0, i
            size += n
        held.append(batch.slice(start))
    if sum(b.num_rows for b in held):
        yield block()


def encode(docs: DataFrame, ranks: str, pattern: str, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", block_bytes: int = BLOCK_BYTES, finish=None, schema: str = "ids array<int>") -> DataFrame:
    """The columns `keep` and the ids of each row's whole text.

    ranks: a rank file on the driver; pattern: the split before the merges. finish turns the ids of a block and
    the tokens into arrays for the columns of `schema`; without it they come out as they are.
    """
    tokens = load_ranks(ranks)
    sent = docs.sparkSession.sparkContext.broadcast(tokens)  # about a megabyte: the vocabulary has a fixed size
    finish = finish or (lambda ids, tokens: [pa.array(ids, pa.list_(pa.int32()))])
    held = [f"k{i}" for i in range(len(keep))]
    chosen = docs.selectExpr(*[f"`{c}` as {h}" for c, h in zip(keep, held)], f"`{text}` as body")
    kinds = ", ".join(f"{c} {t}" for c, t in chosen.dtypes if c != "body")

    def run(batches):
        vocabulary, split = Vocabulary(sent.value), regex.compile(pattern)
        for part, texts in _blocks(batches, "body", block_bytes):
            collecting = gc.isenabled()
            gc.disable()  # millions of small strings and no cycles; the worker may serve other queries after this one
            try:
                ids = encode_block(texts, vocabulary, split)
                found = finish(ids, sent.value)
            finally:
                if collecting:
                    gc.enable()
            columns = [*[part.column(h).combine_chunks() for h in held], *found]
            yield pa.RecordBatch.from_arrays(columns, names=[*held, *[f"r{i}" for i in range(len(found))]])
        release()

    results = [x.strip().split(" ", 1) for x in schema.split(", ")]
    out = chosen.mapInArrow(run, ", ".join([kinds, *[f"r{i} {kind}" for i, (_, kind) in enumerate(results)]]))
    return out.toDF(*keep, *[name for name, _ in results])


def decode(ids, tokens: list[bytes]) -> bytes:
    return b"".join([tokens[i] for i in ids])


def digests(ids: list[np.ndarray], tokens: list[bytes]) -> list[pa.Array]:
    """The number of ids, the SHA-256 of them as little-endian 32-bit integers, and that of the decoded bytes."""
    return [
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
        pa.array([hashlib.sha256(decode(x.tolist(), tokens)).hexdigest() for x in ids], pa.string()),
    ]


DIGEST_SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, finish=digests, schema=DIGEST_SCHEMA)
