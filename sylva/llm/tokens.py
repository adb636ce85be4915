"""Token ids in sorted-string-table shards.

A shard is a file of documents in ascending order of identifier, of bounded size but for its last document. It consists of
sections, each ended by a NUL byte:

    block ...   entries: varints (bytes shared with the key before, further key bytes, value bytes), key bytes, value; crc32
    index       for each block: first key, offset, length, documents and ids before it
    filter      a Bloom filter over the keys
    footer      where index and filter are, documents, ids, shard number, bytes an id; magic

The value is the document's ids as little-endian integers. The first key of a block shares nothing, so a lookup goes through
the filter, a binary search of the index and one block.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, read_binary, ready, slices, write_binary

BLOCK_BYTES = 64 << 10
SHARD_TEXT_BYTES = 24 << 20
END_ID = 2
MAGIC = b"SYLSST1\0"
FOOTER = struct.Struct("<QQQQQQQB8s")
BITS_A_KEY, PROBES = 10, 7
#: Shards that a task numbers at most; the number of the task goes above these bits.
SHARD_BITS = 32


# --- encoding ---------------------------------------------------------------------------------------------------------


class WordEncoder:
    """Encodes whole texts with a word-level tokenizer of the tokenizers library, each distinct word once.

    The tokenizer drops white space and splits at it, so a text's ids are those of its white-space-delimited chunks, one
    after the other. Chunks are cut at ASCII white space. Their ids are kept while there is room and worked out for a batch
    at a time otherwise. Chunks of plain Latin letters, digits and signs are split by the tokenizer's own pattern and go to
    its model in one call; any other chunk goes to the tokenizer as it is.
    """

    PLAIN = re.compile(r"[\x21-\x7e\xa1-\xac\xae-ɏ]+")
    SPECIAL = "<|"

    def __init__(self, path: str, room: int = 250_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.split = regex.compile(r"\n|'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        size = self.whole.get_vocab_size()
        self.ends = np.zeros(size, dtype=bool)
        for token, k in self.whole.get_vocab(with_added_tokens=False).items():
            self.ends[k] = token.endswith("</w>")
        self.width = 2 if size <= 1 << 16 else 4
        self.room, self.chunks, self.parts = room, {}, {"\n": b""}  # a line end stands for no ids
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.shown = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}  # bytes as the model's characters

    def _pack(self, ids) -> bytes:
        return np.asarray(ids, dtype=f"<u{self.width}").tobytes()

    def _parts(self, wanted: list[str]) -> dict[str, bytes]:
        """Ids of pieces that the tokenizer's pattern has cut."""
        found: dict[str, bytes] = {}
        for k in range(0, len(wanted), 2000):
            some = wanted[k : k + 2000]
            joined = " ".join(p if p.isascii() else p.encode().decode("latin-1").translate(self.shown) for p in some)
            ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("the tokenizer does not mark the ends of words")
            packed, at = self._pack(ids), 0
            for p, stop in zip(some, stops.tolist(), strict=True):
                found[p] = packed[at * self.width : stop * self.width]
                at = stop
        return found

    def _new(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        plain, out = [], {}
        for c, s in zip(chunks, b"\n".join(chunks).decode().split("\n"), strict=True) if chunks else []:
            if self.SPECIAL not in s and self.PLAIN.fullmatch(s):
                plain.append((c, s))
            else:
                out[c] = self._pack(self.whole.encode(s, add_special_tokens=False).ids)
        pieces = self.split.findall("\n".join(s for _, s in plain).lower())
        own = self._parts([p for p in dict.fromkeys(pieces) if p not in self.parts])
        if len(self.parts) + len(own) <= self.room:
            self.parts |= own
            parts = self.parts
        else:
            parts = self.parts | own
        ids = [*map(parts.__getitem__, pieces)]
        # lengths of 0 tell where chunks end
        ends = np.cumsum(lengths := np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
        stops = [*ends[lengths == 0].tolist(), *ends[-1:].tolist()]
        joined = b"".join(ids)
        out |= {c: joined[low:high] for (c, _), low, high in zip(plain, [0, *stops], stops, strict=False)}
        return out

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as packed integers (null: as of an empty text)."""
        cut = [(t or b"").split() for t in texts]
        known = self.chunks
        new = self._new([c for c in dict.fromkeys(chain.from_iterable(cut)) if c not in known])
        if len(known) + len(new) <= self.room:
            known |= new
        else:
            known = known | new  # for these texts alone
        return [b"".join(map(known.__getitem__, words)) for words in cut]


@cache
def encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path)


# --- the file format --------------------------------------------------------------------------------------------------


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the identifiers do; null comes first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + k * b & (2**64 - 1)) % bits for k in range(PROBES)]


class TableWriter:
    """Turns entries in ascending key order into the sections of one shard, without holding more than a block."""

    def __init__(self, shard: int, width: int, block_bytes: int = BLOCK_BYTES):
        self.shard, self.width, self.block_bytes = shard, width, block_bytes
        self.block, self.last, self.first = bytearray(), b"", None
        self.offset = self.docs = self.ids = self.block_docs = self.block_ids = 0
        self.index, self.keys = bytearray(), []

    def add(self, key: bytes, value: bytes) -> Iterator[bytes]:
        if self.docs and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.first is None:
            self.first, self.block_docs, self.block_ids = key, self.docs, self.ids
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        for n in (shared, len(key) - shared, len(value)):
            put_varint(self.block, n)
        self.block += key[shared:]
        self.block += value
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(value) // self.width
        if len(self.block) >= self.block_bytes:
            yield self._close()

    def _section(self, body: bytes) -> bytes:
        body += struct.pack("<I", zlib.crc32(body))
        self.offset += len(body) + 1
        return body

    def _close(self) -> bytes:
        at = self.offset
        body = self._section(bytes(self.block))
        put_varint(self.index, len(self.first))
        self.index += self.first
        for n in (at, len(body), self.block_docs, self.block_ids):
            put_varint(self.index, n)
        self.block, self.first = bytearray(), None
        return body

    def finish(self) -> Iterator[bytes]:
        if self.first is not None:
            yield self._close()
        index_at = self.offset
        index = self._section(bytes(self.index))
        yield index
        filter_at, bits = self.offset, max(64, BITS_A_KEY * len(self.keys))
        flags = np.zeros(bits, dtype=np.uint8)
        for key in self.keys:
            flags[probes(key, bits)] = 1
        bloom = self._section(struct.pack("<Q", bits) + np.packbits(flags).tobytes())
        yield bloom
        yield FOOTER.pack(index_at, len(index), filter_at, len(bloom), self.docs, self.ids, self.shard, self.width, MAGIC)[:-1]


class Table:
    """Reads one shard. `read(offset, length)` fetches bytes, so a lookup touches footer, index, filter and one block."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        index_at, index_len, filter_at, filter_len, self.docs, self.ids, self.shard, self.width, magic = FOOTER.unpack(read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        index = self._checked(index_at, index_len)
        bloom = self._checked(filter_at, filter_len)
        self.bits, self.flags = struct.unpack_from("<Q", bloom)[0], bloom[8:]
        self.blocks, self.firsts, at = [], [], 0
        while at < len(index):
            n, at = get_varint(index, at)
            self.firsts.append(bytes(index[at : at + n]))
            at += n
            row = []
            for _ in range(4):
                n, at = get_varint(index, at)
                row.append(n)
            self.blocks.append(row)

    @classmethod
    def of(cls, data: bytes) -> Table:
        return cls(lambda at, n: data[at : at + n], len(data))

    def _checked(self, at: int, n: int) -> bytes:
        body = self.read(at, n)
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("a section's checksum is wrong")
        return body[:-4]

    def block(self, k: int) -> Iterator[tuple[bytes, int, bytes]]:
        """Key, ids before it in the shard, value."""
        at, n, _, ids = self.blocks[k]
        body, key, here = self._checked(at, n), b"", 0
        while here < len(body):
            shared, here = get_varint(body, here)
            fresh, here = get_varint(body, here)
            size, here = get_varint(body, here)
            key = key[:shared] + body[here : here + fresh]
            value = body[here + fresh : here + fresh + size]
            here += fresh + size
            yield key, ids, value
            ids += size // self.width

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with that identifier."""
        key = key_of(doc_id)
        if not all(self.flags[p >> 3] >> (7 - (p & 7)) & 1 for p in probes(key, self.bits)):
            return []
        out = []
        for k in range(max(0, bisect_left(self.firsts, key) - 1), len(self.blocks)):
            if self.firsts[k] > key:
                break
            out += [np.frombuffer(v, dtype=f"<u{self.width}") for found, _, v in self.block(k) if found == key]
        return out


# --- on Spark ---------------------------------------------------------------------------------------------------------


def write_shards(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int = END_ID, name: str = "shards", shard_bytes: int = SHARD_TEXT_BYTES) -> str:
    """Writes the ids of every row's whole text (doc_id, text) and returns the folder of shards.

    Shards are ranges of doc_id, null first; their file names and numbers ascend with it. Rows that share an identifier may
    lie in neighbouring shards, so an identifier with very many rows is no single task's work. Tasks get ranges of about
    shard_bytes of text by samples of rows; one that gets more, where long texts stand close together, starts a further shard
    whenever the stored ids reach shard_bytes. Null texts are stored as empty ones; no rows in, no documents out.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16)).first()[0] or 0
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(max(1, -(-total // shard_bytes)), F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)

    def whole(sections: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"\0".join(sections)], pa.binary())], names=["bytes"])

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        end = np.array([end_id], dtype=f"<u{words.width}").tobytes()
        number = TaskContext.get().partitionId() << SHARD_BITS
        table, sections = TableWriter(number, words.width), []
        for batch in slices(batches, 2000):
            for doc_id, v in zip(batch["doc_id"].to_pylist(), words.encode(as_bytes(batch, "text")), strict=True):
                if table.offset >= shard_bytes:
                    yield whole([*sections, *table.finish()])
                    number += 1
                    table, sections = TableWriter(number, words.width), []
                sections += table.add(key_of(doc_id), v + end)
        yield whole([*sections, *table.finish()])

    write_binary(dealt.mapInArrow(make, "bytes binary"), scratch.path(name), rows_a_file=1)
    return scratch.path(name)


ROWS = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, start (ids before it in the shard), n_tokens and ids_crc32 of every stored document."""
    ready(spark)

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            table = Table.of(batch["content"][0].as_py())
            rows = []
            for key, start, value in table:
                wide = value if table.width == 4 else np.frombuffer(value, dtype="<u2").astype("<u4").tobytes()
                rows.append((table.shard, id_of(key), start, len(wide) // 4, zlib.crc32(wide)))
                if len(rows) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ROWS, strict=True)], schema=ROWS)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ROWS, strict=True)], schema=ROWS)

    return read_binary(spark, path).select("content").mapInArrow(parse, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written to shards and read back; start counts the ids of all documents before one."""
    import public_tokenizers

    scratch = Scratch(spark, "tokens")
    path = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch, str(public_tokenizers.path("word_bpe_49k.json")))
    rows = scratch.table(read_shards(spark, path), "rows")
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row for each shard
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    starts = sums.select("shard", before.alias("before"))
    return rows.join(starts, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
