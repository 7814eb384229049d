"""WARC archives: a writer that stores repeated payloads once, and a reader that verifies record boundaries.

Writing: one payload of a group of equal ones is a response record, the others are revisit records that refer to
it. Spark's text writer ends each record with the two line ends that the format asks for.

Reading: the magic line may also stand inside a payload, so each place where it stands is only a candidate. Tasks
read lines, which end in one byte and so come out right wherever a block is cut, and put those from one magic line to
the next together as a piece. What a block holds before its first magic line and its last piece meet again by file.
Each candidate gives its offset and its successor's: the end of the record by its Content-Length. Offsets come from a
prefix sum over the blocks of a file. Candidates whose successor is the next candidate need no jump; from the others,
the breaks, the chain jumps, and pointer jumping (doubling) over the breaks finds those that are reachable from the
start of the file. Everything else is payload. Archives may be read in blocks of any size, and in any store that Spark
reads; a record has to fit into a task's memory.

Defined cases: a null payload counts as empty; rows of equal id and payload that is the group's first are all
responses; a record with a null id has no record id and reads back as null; columns other than those asked for
are not read; an empty table writes no records and reads back as no rows; a chain that ends before the file does
leaves out what follows, and `broken_files` lists those files.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailspark.llm.common import released, shared_path, sized, stored, table

#: Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of bytes in base 32: five bytes, ten hexadecimal digits, are eight characters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), *_BASE32)


def _records(pages: DataFrame, page: str, url: str, payload: str, min_bytes: int) -> DataFrame:
    """(page, url, payload, digest, size, refers_to) with refers_to null for responses."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page).cast("long").alias("page"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    keyed = rows.withColumns({"digest": base32_sha1(F.col("payload")), "size": F.octet_length("payload").cast("long")})
    # one row for each group of several, made by partial aggregation; a large group then meets one row
    groups = (
        keyed.groupBy("digest", "size").agg(F.min("page").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("size") >= min_bytes)).drop("n")
    )
    joined = keyed.join(groups, ["digest", "size"], "left")
    return joined.withColumn("refers_to", F.when(F.col("page").isNull() | (F.col("page") > F.col("first")), F.col("first"))).drop("first")


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")))


def write_warc(pages: DataFrame, path: str, *, page: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, compression: str = "gzip") -> None:
    """Write a record for each row under path. Payloads of at least min_bytes that repeat become revisit records."""
    rows = _records(pages, page, url, payload, min_bytes)
    revisit = F.col("refers_to").isNotNull()
    record_id = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.concat(http.cast("binary"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    # a header is one line
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")
    head = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", record_id(F.col("page"))),
        _header("WARC-Target-URI", target),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Refers-To", record_id(F.col("refers_to"))),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
    )
    records = rows.withColumn("block", block).select(F.concat(head.cast("binary"), F.col("block")).cast("string").alias("value"))
    records.write.option("lineSep", END).option("compression", compression).text(path)


_FIELD = re.compile(rb"(?im)^(warc-type|warc-record-id|warc-refers-to|warc-payload-digest|content-length):[ \t]*([^\r\n]*)")
_PAGE = re.compile(rb"<urn:page:(-?\d+)>")
_NUMBER = re.compile(rb"\d{1,18}")
_PIECE = "file string, block long, nth long, start long, head boolean, last boolean, value binary"
_CANDIDATE = (
    "file string, block long, nth long, start long, size long, successor long, broken int, parts array<struct<block: bigint, end: bigint>>, "
    "page long, type string, refers long, length long, head_bytes long, http_bytes long, payload_bytes long, payload_digest string, stated_digest string"
)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order to pieces. start counts from the block's first byte; head: before the first magic line; last: may go on in the next block."""
    magic = MAGIC.encode().removesuffix(b"\n")
    names = [c.split(" ")[0] for c in _PIECE.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
    key, nth, start, lines, size = None, -1, 0, [], 0

    def piece(last: bool) -> tuple:
        return (*key, nth, start, nth < 0, last, b"\n".join(lines))

    for batch in batches:
        rows, held = [], 0
        for file, block, line in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value")):
            line = line.as_py()
            if (file, block) != key:
                if lines:
                    rows.append(piece(True))
                key, nth, start, lines, size = (file, block), -1, 0, [], 0
            if line == magic:
                if lines:
                    rows.append(piece(False))
                    held += size
                nth, start, lines, size = nth + 1, start + size, [], 0
            lines.append(line)
            size += len(line) + 1
            if held > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)
    if lines:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(piece(True), kinds)], names=names)


def _fields(head: bytes) -> dict[bytes, bytes]:
    """The first line of each header that is read, by its name in lower case."""
    found: dict[bytes, bytes] = {}
    for name, value in _FIELD.findall(head):
        found.setdefault(name.lower(), value)
    return found


def _number(value: bytes | None) -> int | None:
    return int(value) if value and _NUMBER.fullmatch(value) else None


def _page(value: bytes | None) -> int | None:
    found = _PAGE.search(value or b"")
    return int(found[1]) if found else None


def _payload(block: bytes) -> tuple[int, int | None]:
    """Where the payload begins after the HTTP header, and the length that the header states."""
    end = block.find(END.encode())
    http = block[: end if end >= 0 else len(block)]
    return (end + 4 if end >= 0 else len(block)), _number(_fields(http).get(b"content-length"))


def _record(type_: str | None, block: bytes, stated: bytes | None) -> tuple[int, int | None, str | None]:
    """http_bytes, payload_bytes and payload_digest of a whole block; of a revisit, what it states."""
    at, length = _payload(block)
    if type_ == "revisit":
        return at, length, (stated or b"").removeprefix(b"sha1:").decode("latin-1") or None
    return at, len(block) - at, base64.b32encode(hashlib.sha1(block[at:]).digest()).decode()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece, with what its record says of itself; successor counts from the piece's first byte."""
    magic, end = MAGIC.encode(), END.encode()
    for batch in batches:
        rows = []
        for file, block, nth, start, parts, value in zip(*(batch.column(c) for c in ("file", "block", "nth", "start", "parts", "value"))):
            value, true = value.as_py(), nth.as_py() >= 0
            cut = value.find(end, len(magic)) if true else -1
            fields = _fields(value[len(magic) : cut] if cut >= 0 else b"")
            length = _number(fields.get(b"content-length"))
            type_ = fields.get(b"warc-type", b"").decode("latin-1").lower() or None
            successor = http = size = digest = None
            if length is not None:
                successor = cut + len(end) + length + len(end)
                whole = value[cut + 4 : cut + 4 + length]
                if len(whole) == length:
                    http, size, digest = _record(type_, whole, fields.get(b"warc-payload-digest"))
            rows.append((
                file.as_py(), block.as_py(), nth.as_py(), start.as_py(), len(value), successor, int(true and successor != len(value) + 1), parts.as_py(),
                _page(fields.get(b"warc-record-id")), type_, _page(fields.get(b"warc-refers-to")), length, cut + 4, http, size, digest,
                fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("latin-1"),
            ))
        if rows:
            names = [c.split(" ")[0] for c in _CANDIDATE.replace("block: bigint, end: bigint", "").split(", ")]
            kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<struct<>>": pa.list_(pa.struct([("block", pa.int64()), ("end", pa.int64())]))}
            types = [kinds[c.split(" ")[1]] for c in _CANDIDATE.replace("block: bigint, end: bigint", "").split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), types)], names=names)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, nth, start, parts, value): the pieces of the archives, those across blocks put together; nth is -1 for what no magic line precedes.

    parts: the blocks that a piece lies in, each with where its part ends.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    cut = lines.mapInArrow(released(_cut), _PIECE)
    end = (F.col("start") + F.octet_length("value") + 1).cast("long")
    whole = cut.where("not head and not last").withColumn("parts", F.array(F.struct(F.col("block").alias("block"), end.alias("end"))))
    # two pieces of a block at most; those of a file meet in its blocks' order
    order = W.partitionBy("file").orderBy("block", "nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    edges = cut.where("head or last").withColumn("owner", F.sum((~F.col("head")).cast("long")).over(order))
    part = F.struct("block", "nth", "start", end.alias("end"), "value")
    met = edges.groupBy("file", "owner").agg(F.array_sort(F.collect_list(part)).alias("all"))
    value = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.col("all")[0]["value"], lambda s, x: F.concat(s, F.lit(b"\n"), x["value"]))
    parts = F.transform("all", lambda x: F.struct(x["block"].alias("block"), x["end"].alias("end")))
    first = [F.col("all")[0][c].alias(c) for c in ("block", "nth", "start")]
    columns = ["file", "block", "nth", "start", "parts", "value"]
    return whole.select(*columns).union(met.select("file", *first, parts.alias("parts"), value.alias("value")))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each magic line of the archives: its offset, its successor's, its island and what its text holds up to the next one.

    An island is a run of candidates that ends in a break, a candidate whose successor isn't the next one.
    """
    found = stored(_pieces(spark, path).mapInArrow(released(_parse), _CANDIDATE), "warc-candidates")
    ends = found.select("file", F.explode("parts").alias("part"), F.lit(0).alias("broken"))
    sizes = ends.groupBy("file", F.col("part.block").alias("block")).agg(F.max("part.end").alias("total"))
    breaks = found.where("nth >= 0").groupBy("file", "block").agg(F.sum("broken").alias("all_breaks"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    base = sizes.join(breaks, ["file", "block"], "left").select("file", "block", so_far("total").alias("base"), so_far("all_breaks").alias("islands"))
    placed = found.where("nth >= 0").drop("parts").join(sized(base), ["file", "block"])
    here = W.partitionBy("file", "block").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    island = (F.col("islands") + F.coalesce(F.sum("broken").over(here), F.lit(0))).alias("island")
    offset = F.col("base") + F.col("start")
    return placed.withColumns({"offset": offset, "successor": offset + F.col("successor"), "island": island}).drop("base", "islands", "start")


def reachable(nodes: DataFrame) -> DataFrame:
    """The candidates that a chain of successors reaches from the start of their file. Who enters an island reaches all of it from there on."""
    jumps = sized(nodes.where("broken = 1 and successor is not null").select("file", F.col("island").alias("at"), F.col("successor").alias("target")))
    # a break's successor lies in some island, which ends in the next break of the chain
    targets = nodes.select("file", F.col("offset").alias("target"), F.col("island").alias("to"))
    goes = stored(targets.join(jumps, ["file", "target"]).select("file", "at", "to", F.col("target").alias("entry")), "warc-jumps")
    starts = nodes.where(F.col("offset") == 0).select("file", "island", F.col("offset").alias("entry")).distinct()
    entries = starts
    if goes.limit(1).count():
        reached, jump, size, left = starts.select("file", "island"), goes.select("file", F.col("at").alias("island"), "to"), -1, True
        while left:
            ahead = reached.join(jump, ["file", "island"]).select("file", F.col("to").alias("island"))
            reached = stored(reached.union(ahead).distinct(), "warc-reached")
            now = reached.count()
            left, size = now != size, now
            twice = jump.join(jump.select("file", F.col("island").alias("to"), F.col("to").alias("then")), ["file", "to"])
            jump = stored(twice.select("file", "island", F.col("then").alias("to")), "warc-jumps")
        entered = goes.join(reached.withColumnRenamed("island", "at"), ["file", "at"], "left_semi").select("file", F.col("to").alias("island"), "entry")
        entries = starts.union(entered)
    # the chain moves forward, so an island is entered once; a broken file may say otherwise
    entries = sized(entries.groupBy("file", "island").agg(F.min("entry").alias("entry")))
    return nodes.join(entries, ["file", "island"]).where(F.col("offset") >= F.col("entry")).drop("entry")


def broken_files(nodes: DataFrame) -> DataFrame:
    """(file) of archives whose chain names a successor that isn't there, or states no length, before the file's last candidate."""
    true = reachable(nodes)
    last = nodes.groupBy("file").agg(F.max("offset").alias("last"))
    ends = true.where("broken = 1").join(last, "file").where(F.col("offset") < F.col("last"))
    found = nodes.select("file", F.col("offset").alias("successor"))
    return ends.join(found, ["file", "successor"], "left_anti").select("file").distinct()


_RECORD = ["page", "type", "refers as refers_to", "payload_bytes", "payload_digest", "stated_digest"]


def read_warc(spark: SparkSession, path: str, *, payload: bool = False) -> DataFrame:
    """(page, type, refers_to, payload_bytes, payload_digest, stated_digest) of each true record, and the payload on request.

    Digest and size of a response are those of the bytes read; of a revisit, those that it states; its payload is null.
    """
    true = stored(reachable(candidates(spark, path)), "warc-records")
    rows = true.where("http_bytes is not null").selectExpr(*_RECORD, "file", "offset", "block", "nth", "http_bytes", "head_bytes", "length")
    spread = true.where("http_bytes is null and length is not null")
    whole = rows.select(*[c.split(" ")[-1] for c in _RECORD])
    if payload:
        bytes_of = F.expr("substring(value, cast(head_bytes + http_bytes + 1 as int), cast(length - http_bytes as int))")
        whole = rows.join(_pieces(spark, path).select("file", "block", "nth", "value"), ["file", "block", "nth"])
        whole = whole.select(*[c.split(" ")[-1] for c in _RECORD], F.when(F.col("type") != "revisit", bytes_of).alias("payload"))
    if not spread.limit(1).count():
        return whole
    joined = _joined(spark, path, spread)
    return whole.unionByName(joined if payload else joined.drop("payload"))


def _joined(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """Records whose payload holds magic lines, put together from the pieces up to their successor."""
    marks = candidates(spark, path).select("file", "block", "nth", "offset")
    owners = records.select("file", "offset", F.col("offset").alias("owner"), F.col("successor").alias("stop"))
    run = W.partitionBy("file").orderBy("offset").rowsBetween(W.unboundedPreceding, W.currentRow)
    owned = marks.join(records.select("file").distinct(), "file", "left_semi").join(owners, ["file", "offset"], "left")
    owned = owned.select("file", "block", "nth", "offset", F.last("owner", True).over(run).alias("owner"), F.last("stop", True).over(run).alias("stop")).where(F.col("offset") < F.col("stop"))
    texts = _pieces(spark, path).select("file", "block", "nth", "value").join(sized(owned), ["file", "block", "nth"])
    pieces = texts.groupBy("file", F.col("owner").alias("offset")).agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("pieces"))
    rows = records.selectExpr(*_RECORD, "file", "offset", "head_bytes", "length").join(pieces, ["file", "offset"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text = b"\n".join(p["value"] for p in r["pieces"])
                block = text[r["head_bytes"] : r["head_bytes"] + r["length"]]
                if len(block) < r["length"]:
                    continue  # the file ends within the record
                http, size, digest = _record(r["type"], block, r["stated_digest"].encode())
                out.append((r["page"], r["type"], r["refers_to"], size, digest, r["stated_digest"], None if r["type"] == "revisit" else block[http:]))
            if out:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=["page", "type", "refers_to", "payload_bytes", "payload_digest", "stated_digest", "payload"])

    return rows.mapInArrow(put, "page long, type string, refers_to long, payload_bytes long, payload_digest string, stated_digest string, payload binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    found = read_warc(spark, path)
    return found.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, n AS payload_bytes,
  translate(to_base(('0x' || s[1:10])::UBIGINT::BIGINT, 32, 8) || to_base(('0x' || s[11:20])::UBIGINT::BIGINT, 32, 8)
    || to_base(('0x' || s[21:30])::UBIGINT::BIGINT, 32, 8) || to_base(('0x' || s[31:40])::UBIGINT::BIGINT, 32, 8),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id > f OR page_id IS NULL AND f IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > f OR page_id IS NULL THEN f END AS refers_to
FROM d
"""
