"""WARC archives: a writer with revisit records and a sequential reader.

Each record is a gzip member of its own. The reader goes through an archive once, from front to back, and holds a piece of it at
a time: it inflates a member in small pieces, takes the header lines, then as many block bytes as Content-Length says, and checks
the digests it was told. So neither archives nor records need to fit into memory, unless payloads are asked for.

A record whose payload equals an earlier chosen one is a revisit: it keeps the HTTP headers (Content-Length among them), the
payload's digest and the other record's identifier, but not the payload.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, dealt_join, hot_keys, read_pieces, ready, sift, slices, write_binary

#: Payloads below this many bytes are always stored.
LEAST_SHARED = 1000
#: Records are gathered to rows of so many bytes, and so many rows make an archive: 64 MB, and a last record.
ROW_BYTES, ARCHIVE_ROWS = 1 << 20, 64
PIECE = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    number = (record or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def make_member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member.

    Its last byte is the top one of the record's length, NUL below 16 MB. write_binary() ends rows with a NUL; where a row's last
    member has none that is padding, which readers skip.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(url.split()))
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32_sha1(digest)}", f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(block).hexdigest())}"]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _members(batches: Iterable[pa.RecordBatch], row_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of about row_bytes of members. A NUL that ends a row is left to write_binary()."""
    held, size = [], 0
    for batch in slices(batches, 16):
        for r in batch.select(["page_id", "url", "payload", "digest", "refers_to", "revisit"]).to_pylist():
            held.append(make_member(*r.values()))
            size += len(held[-1])
            if size >= row_bytes:
                yield _row(held)
                held, size = [], 0
    if held:
        yield _row(held)


def _row(members: list[bytes]) -> pa.RecordBatch:
    body = b"".join(members)
    return pa.RecordBatch.from_arrays([pa.array([body[:-1] if body[-1] == 0 else body], pa.binary())], names=["bytes"])


def write_archives(pages: DataFrame, scratch: Scratch, name: str = "archives", least: int = LEAST_SHARED, row_bytes: int = ROW_BYTES, rows_a_file: int = ARCHIVE_ROWS) -> str:
    """Writes every row of pages (page_id, url, html) as a record and returns the folder of archives.

    Of records with equal payloads of at least `least` bytes, that with the largest page_id is the response. A null html is
    an empty payload; a null page_id ranks below all others and has an empty identifier; of repeated rows one is the
    response. No rows make no records. Digests find the equal payloads; which records those are is a row of numbers for each
    digest that occurs twice, and only payloads that a sift takes for such are shuffled to them. Archives are cut by bytes.
    """
    ready(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("big", F.octet_length("payload") >= least)
    keys = scratch.table(rows.where("big").select("page_id", "digest"), "digests")
    shared = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("first")).where("copies > 1")
    shared = scratch.table(shared, "shared")
    ties = keys.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    marked = sift(rows, "digest", shared.select("digest"), shared.count()).withColumn("_maybe", F.col("_maybe") & F.col("big"))
    none = [F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit")]
    alone = marked.where("not _maybe").select("page_id", "url", "payload", "digest", *none)
    joined = dealt_join(marked.where("_maybe"), shared, ["digest"], hot_keys(shared.select("digest", "copies"), "copies"), ["page_id", "url"], "left")
    revisit = F.col("copies").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = joined.withColumn("refers_to", F.col("first")).withColumn("revisit", revisit)
    if ties:
        joined = _one_response(joined, scratch)
    out = alone.unionByName(joined.select(*alone.columns)).mapInArrow(lambda batches: _members(batches, row_bytes), "bytes binary")
    write_binary(out, scratch.path(name), rows_a_file)
    return scratch.path(name)


def _one_response(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Where rows repeat with one page_id and payload, all but one become revisits."""
    kept = rows.where(F.col("copies").isNull() | F.col("revisit"))
    firsts = rows.where(F.col("copies").isNotNull() & ~F.col("revisit"))
    firsts = scratch.table(firsts.withColumn("_mark", F.monotonically_increasing_id()), "firsts")
    least = firsts.groupBy("digest").agg(F.min("_mark").alias("_least"))
    firsts = firsts.join(least, "digest").withColumn("revisit", F.col("_mark") != F.col("_least"))
    return kept.unionByName(firsts.select(*rows.columns))


class DigestError(ValueError):
    pass


class FormatError(ValueError):
    pass


class Inflated:
    """The bytes of the gzip members of an archive, one member at a time, inflated in small pieces as the archive's come in."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.raw = iter(pieces), b""
        self.engine: zlib._Decompress | None = None
        self.ready = b""

    def _fetch(self) -> bool:
        """Whether there are bytes at hand that were not inflated."""
        while not self.raw:
            if (piece := next(self.pieces, None)) is None:
                return False
            self.raw = piece
        return True

    def next_member(self) -> bool:
        while self._fetch():
            self.raw = self.raw.lstrip(b"\0")  # padding
            if self.raw:
                self.engine, self.ready = zlib.decompressobj(31), b""
                return True
        return False

    def _more(self) -> bytes:
        """The next inflated piece, at most PIECE bytes; empty at the member's end."""
        while not self.engine.eof:
            held = self.engine.unconsumed_tail
            if not held:
                if not self._fetch():
                    raise FormatError("the archive ends within a record")
                held, self.raw = self.raw, b""
            piece = self.engine.decompress(held, PIECE)
            if self.engine.eof:
                self.raw = self.engine.unused_data + self.raw
            if piece:
                return piece
        return b""

    def until(self, mark: bytes) -> bytes:
        while (k := self.ready.find(mark)) < 0:
            if not (piece := self._more()):
                raise FormatError("a header does not end")
            self.ready += piece
        head, self.ready = self.ready[:k], self.ready[k + len(mark) :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """Exactly n bytes, in pieces."""
        while n:
            if not self.ready and not (piece := self._more()):
                raise FormatError("a block is shorter than its Content-Length")
            elif not self.ready:
                self.ready = piece
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            yield piece

    def rest(self) -> bytes:
        out = self.ready
        while piece := self._more():
            out += piece
        self.ready = b""
        return out


def headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    return first, {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}


def read_archive(pieces: Iterable[bytes], keep_payload: bool = False) -> Iterator[dict]:
    """The records of one archive, whose bytes come in pieces, in order. Raises if framing or a digest is wrong."""
    source = Inflated(pieces)
    while source.next_member():
        version, head = headers(source.until(b"\r\n\r\n"))
        if not version.startswith("WARC/"):
            raise FormatError(f"not a WARC record: {version[:40]!r}")
        length, block, payload = int(head["content-length"]), hashlib.sha1(), hashlib.sha1()
        http, kept, size = b"", [], 0
        http_done = False
        for piece in source.take(length):
            block.update(piece)
            if not http_done:
                http += piece
                before, mark, piece = http.partition(b"\r\n\r\n")
                if not mark:
                    continue
                http, http_done = before, True
            payload.update(piece)
            size += len(piece)
            if keep_payload:
                kept.append(piece)
        if source.rest() != b"\r\n\r\n":
            raise FormatError("a record does not end after its block")
        if "sha1:" + base32_sha1(block.hexdigest()) != head["warc-block-digest"]:
            raise DigestError(head["warc-record-id"])
        told = head["warc-payload-digest"].removeprefix("sha1:")
        revisit = head["warc-type"] == "revisit"
        declared = int(headers(http)[1]["content-length"])
        if not revisit and (told != base32_sha1(payload.hexdigest()) or declared != size):
            raise DigestError(head["warc-record-id"])
        yield {
            "page_id": page_of(head["warc-record-id"]), "url": head.get("warc-target-uri"), "payload_bytes": declared, "payload_digest": base64.b32decode(told).hex(),
            "record_type": head["warc-type"], "refers_to": page_of(head["warc-refers-to"]) if revisit else None, "payload": b"".join(kept) if keep_payload and not revisit else None,
        }


SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _by_file(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """File and bytes of runs of pieces, with the NULs that stood between them."""
    for batch in batches:
        files = batch["file"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)] if len(files) else [0]
        pieces = batch["piece"]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(files[a]), b"\0".join(pieces.slice(a, b - a).to_pylist()) + b"\0"


def read_archives(spark: SparkSession, path: str, keep_payload: bool = False, glob: str = "part-*") -> DataFrame:
    """The records of all archives of a folder, of any size. payload is null unless asked for, and for revisits."""
    ready(spark)

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for _, runs in groupby(_by_file(batches), itemgetter(0)):
            for row in read_archive((piece for _, piece in runs), keep_payload):
                rows.append(row)
                held += len(row["payload"] or b"")
                if len(rows) >= 2000 or held > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, ARROW)

    return read_pieces(spark, path, glob).mapInArrow(parse, SCHEMA)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back. Null html is an empty payload, repeated rows have a record each."""
    scratch = Scratch(spark, "warc")
    path = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
d AS (SELECT *, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM d
"""
