"""Near-duplicate documents by MinHash, banding, signature verification and alternating large-star and small-star.

1. Each whole text becomes its set of five-word shingles (64-bit hashes), and 128 universal hash minima of it.
2. Documents with equal sets fall together at once; one of each stands for the rest.
3. Four minima make a band; documents that share a band meet in a bucket. Buckets of more than a block's worth of members or
   shingles are dealt over blocks, and blocks meet in pairs, so no task sees a whole large bucket. Blocks meet themselves
   first. Where documents of a large bucket are still apart, those outside its largest component are dealt over blocks of
   their own, which meet each other and the blocks of the rest; the rest need not meet again.
4. Within a block signatures are compared, each pair only in the first band it shares. Documents that have a likely partner go
   on with their full sets; exact similarities are worked out and a spanning forest of the links leaves the block.
5. Links join into components; the smallest identifier names each.

A link that has the least similarity shares no band with a probability of about 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import Scratch, as_bytes, hash_words, sift, slices, windows

WORDS = 5
MINIMA, BAND = 128, 4
BANDS = MINIMA // BAND
LEAST = 75  # hundredths
#: Signatures that agree in fewer places than this share are not looked at again: five standard deviations below the least.
LIKELY = 0.56
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 20


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct shingles of a text in UTF-8: lower case for A-Z only, words are cut at ASCII white space."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    return np.unique(windows(hash_words(words), WORDS))


def hash_family(n: int = MINIMA, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of n universal hash functions modulo 2 ** 64."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)


FACTOR, OFFSET = hash_family()


def minima(found: np.ndarray) -> np.ndarray:
    """Sixteen bits of each minimum; four of them side by side are a band."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(found), 256):
        h = np.multiply.outer(found[k : k + 256], FACTOR)
        h += OFFSET
        np.minimum(least, h.min(axis=0), out=least)
    return ((least >> np.uint64(16)) & np.uint64(0xFFFF)).astype("<u2")


def digest_of(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


SIGNED = pa.schema([("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1000):
        sizes, digests, bands = [], [], []
        for text in as_bytes(batch, "text"):
            found = shingles(text)
            sizes.append(len(found))
            digests.append(digest_of(found) if len(found) else None)
            bands.append(minima(found).view("<i8") if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, SIGNED.field("bands").type)], names=["doc_id", *SIGNED.names])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 200):
        nodes, sets = [], []
        for node, digest, text in zip(batch["node"].to_pylist(), batch["digest"].to_pylist(), as_bytes(batch, "text"), strict=True):
            found = shingles(text)
            if len(found) and digest_of(found) == digest:  # another row may have the same identifier
                nodes.append(node)
                sets.append(found.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "found"])


def blocks(batches: Iterable[pa.RecordBatch], names: list[str], rows_at_once: int = 2000) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of sorted batches gathered by their block (band, key, i, j); one block at a time is held."""
    rows = (r for batch in slices(batches, rows_at_once) for r in batch.to_pylist())
    for key, group in groupby(rows, lambda r: tuple(r[n] for n in names)):
        yield key, list(group)


PLACE = ["band", "key", "i", "j"]


def wanted(rows: list[dict]) -> np.ndarray:
    """Which pairs of a block's members are to be compared, as an upper triangle.

    A block meets itself (i = j), or two blocks meet: then pairs within either were compared before. Pairs that are already
    in one component are settled.
    """
    n = len(rows)
    pairs = np.triu(np.ones((n, n), dtype=bool), 1)
    if rows[0]["i"] != rows[0]["j"]:
        own = np.array([r["block"] for r in rows])
        pairs &= own[:, None] != own
    comp = np.array([r["comp"] for r in rows])
    return pairs & (comp[:, None] != comp)


def _likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each block that have a likely partner in it."""
    live: list[tuple] = []
    for (band, key, i, j), rows in blocks(batches, PLACE):
        if len(rows) == 2 and any(map(eq, rows[0]["bands"][:band], rows[1]["bands"][:band])):
            continue
        pairs = wanted(rows)
        signed = np.array([r["bands"] for r in rows], dtype="<i8")
        for b in range(band):  # compared in an earlier band
            pairs &= signed[:, b][:, None] != signed[:, b]
        if not pairs.any():
            continue
        parts = signed.view("<u2").reshape(len(rows), MINIMA)
        at = np.zeros(len(rows), dtype=bool)
        for row in np.flatnonzero(pairs.any(axis=1)):
            others = np.flatnonzero(pairs[row])
            near = others[(parts[others] == parts[row]).sum(axis=1) >= LIKELY * MINIMA]
            if len(near):
                at[row] = True
                at[near] = True
        live += [(band, key, i, j, rows[k]["block"], rows[k]["node"], rows[k]["comp"]) for k in np.flatnonzero(at)]
        if len(live) > 5000:
            yield _live(live)
            live = []
    yield _live(live)


LIVE = pa.schema([("band", pa.int32()), ("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("node", pa.int64()), ("comp", pa.int64())])


def _live(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(LIVE)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, LIVE, strict=True)], schema=LIVE)


def similar(a: np.ndarray, b: np.ndarray, common: int | None = None) -> bool:
    n = len(np.intersect1d(a, b, assume_unique=True)) if common is None else common
    return 100 * n >= LEAST * (len(a) + len(b) - n)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each pair of sets shares, by products of 0/1 matrices over the shingles that two sets hold."""
    n = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    kept = times[at] > 1
    names, at = np.unique(at[kept], return_inverse=True)
    owner = owner[kept]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros((n, n), dtype=np.float32)
    for low in range(0, len(names), 4096):
        a, b = np.searchsorted(at, (low, low + 4096))
        ones = np.zeros((n, min(4096, len(names) - low)), dtype=np.float32)
        ones[owner[a:b], at[a:b] - low] = 1
        out += ones @ ones.T
    return out


def forest(rows: list[dict]) -> list[tuple[int, int]]:
    """A spanning forest of the links among a block's wanted pairs."""
    pairs = wanted(rows)
    sets = [np.frombuffer(r["found"], dtype=np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    pairs &= 100 * np.minimum(sizes[:, None], sizes) >= LEAST * np.maximum(sizes[:, None], sizes)
    left, right = np.nonzero(pairs)
    if not len(left):
        return []
    if len(rows) > 12:
        common = shared_counts(sets)
        keep = 100 * common[left, right] >= LEAST * (sizes[left] + sizes[right] - common[left, right])
        left, right = left[keep], right[keep]
    head = list(range(len(rows)))

    def find(x: int) -> int:
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    out = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y and (len(rows) > 12 or similar(sets[a], sets[b])):
            head[y] = x
            out.append((rows[a]["node"], rows[b]["node"]))
    return out


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[tuple[int, int]] = []
    for _, rows in blocks(batches, PLACE, 200):
        if len(rows) > 1:
            found += forest(rows)
        if len(found) > 5000:
            yield _pairs(found)
            found = []
    yield _pairs(found)


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["a", "b"])


def components(links: DataFrame, scratch: Scratch, name: str = "stars", rounds: int = 100) -> DataFrame:
    """Node and the smallest node of its component, for every node of links (a, b), by alternating large-star and small-star.

    Large-star hooks each larger neighbour of a node to the smallest in its neighbourhood, small-star the smaller ones. Only
    minima are gathered, never a neighbourhood. Each round is a written table; it ends when a round changes nothing.
    """
    edges = scratch.table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    before = None
    if not edges.limit(1).count():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    for k in range(1, rounds + 1):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = scratch.table(small, f"{name}-{k}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{k - 1}")
        if tuple(now) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = tuple(now)
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles, digest, component_id, kept and component for each row of docs (doc_id, text).

    Rows without words have no shingles and stand alone. A null doc_id stands alone too: component_id is null and the row is
    kept. Repeated rows have one component. kept is doc_id = component_id, so rows that repeat a kept identifier are all kept;
    one_of_each() tells them apart by component, a number of this run alone (null without shingles or identifier).
    """
    signed = scratch.table(docs.select("doc_id", "text").mapInArrow(_sign, docs.select("doc_id").schema.add("n_shingles", "long").add("digest", "binary").add("bands", ArrayType(LongType()))), "signed")
    of = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # equal digests are equal sets, so the first of anything but doc_id is the same whichever row it comes from
    reps = of.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    reps = scratch.table(reps.select(F.monotonically_increasing_id().alias("node"), "digest", "rep", "n", "bands"), "reps")
    comps = link_components(docs, reps, scratch)
    named = reps.select("node", "digest", "rep").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_digest = named.join(least, "comp").select("digest", F.col("comp").alias("component"), F.col("component_id").alias("_component"))
    rows = signed.select("doc_id", "n_shingles", "digest").join(by_digest, "digest", "left")
    rows = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))).drop("_component")
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def link_components(docs: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """node and comp of every node that has a link."""
    exploded = reps.select("node", "n", F.posexplode("bands").alias("band", "key"))
    buckets = exploded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).where("members > 1")
    parts = _parts(F.col("members"), F.col("shingles"))
    members = exploded.join(buckets.select("band", "key", parts.alias("parts")), ["band", "key"])
    members = scratch.table(members.select("band", "key", "node", "n", "parts", _deal("parts").alias("block")), "members")
    first = members.select("band", "key", F.col("block").alias("i"), F.col("block").alias("j"), "block", "node", F.col("node").alias("comp"))
    links = scratch.table(_compare(docs, reps, first, scratch, "own"), "links-own")
    comps = components(links, scratch, "stars-own")
    if not members.where("parts > 1").limit(1).count():
        return comps
    # large buckets that still hold documents apart: those outside the largest component meet each other and all the rest
    large = members.where("parts > 1").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = large.groupBy("band", "key", "comp").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    total = sizes.groupBy("band", "key").agg(F.max(F.struct("members", "comp", "shingles")).alias("top"), F.sum("members").alias("members"), F.sum("shingles").alias("shingles"))
    apart = total.where("members > top.members")
    few = _parts(F.col("members") - F.col("top.members"), F.col("shingles") - F.col("top.shingles"))
    apart = apart.select("band", "key", F.col("top.comp").alias("main"), few.alias("few"), _parts(F.col("top.members"), F.col("top.shingles")).alias("many"))
    large = large.join(apart, ["band", "key"])
    minor = F.col("comp") != F.col("main")
    block = F.when(minor, _deal("few")).otherwise(F.col("few") + _deal("many"))
    meets = F.sequence(F.lit(0), F.when(minor, F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)
    pairs = large.select("band", "key", block.alias("block"), "node", "comp", F.explode(meets).alias("other"))
    pairs = pairs.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp")
    more = scratch.table(_compare(docs, reps, pairs, scratch, "pairs"), "links-pairs")
    return components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more), scratch, "stars-pairs")


def _parts(members: Column, shingles: Column) -> Column:
    """Blocks that so many members with so many shingles are dealt over."""
    return F.greatest(F.ceil(members / BLOCK_ROWS), F.least(F.ceil(shingles / BLOCK_SHINGLES), F.ceil(members / 2))).cast("int")


def _deal(parts: str) -> Column:
    return F.pmod(F.xxhash64("node", F.lit("block")), F.col(parts)).cast("int")


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition(*[F.col(c) for c in PLACE]).sortWithinPartitions(*PLACE, "node")


def _compare(docs: DataFrame, reps: DataFrame, rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links (a, b) among the blocks of rows (band, key, i, j, block, node, comp)."""
    schema = rows.select(*LIVE.names).schema
    signed = _by_block(rows.join(reps.select("node", "bands"), "node").select(*LIVE.names, "bands"))
    live = scratch.table(signed.mapInArrow(_likely, schema), f"live-{name}")
    nodes = scratch.table(live.select("node").distinct().join(reps.select("node", "rep", "digest"), "node"), f"nodes-{name}")
    # few texts pass the sift, and only those are shuffled
    texts = sift(docs.select("doc_id", "text"), "doc_id", nodes.select("rep"), nodes.count()).where("_maybe")
    texts = texts.join(nodes.hint("merge"), F.col("doc_id") == F.col("rep")).select("node", "digest", "text")
    sets = texts.mapInArrow(_sets, "node long, found binary").dropDuplicates(["node"])
    full = _by_block(live.join(sets, "node").select(*LIVE.names, "found"))
    return full.mapInArrow(_links, "a long, b long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(spark, "dedup")
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs that stay: one of each component, and every row without words or identifier. All columns stay.

    Only texts that the sift takes for ones that may go are shuffled, to an exact join.
    """
    found = scratch.table(near_duplicates(docs, scratch), "found")
    of = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("any"))
    gone = scratch.table(of.where("n > 1 or not any"), "gone")
    marked = sift(docs, "doc_id", gone.select("doc_id"), gone.count())
    out = marked.where("_maybe").join(gone.select("doc_id").hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    out = marked.where("not _maybe").select(*docs.columns).unionByName(out)
    repeated = gone.where("n > 1 and any").select("doc_id")
    if not repeated.limit(1).count():
        return out
    return out.unionByName(_one_row(docs, found, repeated, scratch).select(*docs.columns))


def _one_row(docs: DataFrame, found: DataFrame, repeated: DataFrame, scratch: Scratch) -> DataFrame:
    """Of kept identifiers that stand in several rows: the first row of each component, and each row without words."""
    rows = scratch.table(docs.join(repeated, "doc_id", "left_semi").withColumn("_row", F.monotonically_increasing_id()), "repeats")
    schema = rows.select("_row").schema.add("n_shingles", "long").add("digest", "binary")

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            sets = [shingles(t) for t in as_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch["_row"], pa.array([len(s) for s in sets], pa.int64()), pa.array([digest_of(s) if len(s) else None for s in sets], pa.binary())], names=["_row", "n_shingles", "digest"])

    marks = rows.select("_row", "text").mapInArrow(look, schema).join(rows.select("_row", "doc_id"), "_row")
    # the component of a row's own set, whichever identifier names it
    own = found.where("digest is not null").select("doc_id", "digest", "component_id", "component").distinct()
    marks = marks.join(own, ["doc_id", "digest"], "left")
    stay = marks.where("digest is null").select("_row").union(marks.where("component_id = doc_id").groupBy("component").agg(F.min("_row").alias("_row")).select("_row"))
    return rows.join(stay, "_row", "left_semi").drop("_row")

