"""Mixing sources to target weights by Pfair scheduling.

Documents of a source fill blocks of equal bytes. Block k of a source with weight w may not be placed before floor((k - 1) / w)
and is due by ceil(k / w); earliest deadline first fills one block a slot. With weights that add up to one, each block meets
its window, so after any number of slots every source is less than one block away from its weight.

Windows come from the weights as given, as exact fractions, at every size. The driver works the schedule out block by block; a
corpus has no more than BLOCKS blocks (and one for each source), since blocks grow with it beyond 64 GB. Sources that have run
out take no more time there.
"""

from __future__ import annotations

import heapq
from array import array
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hot_keys, number_within

#: Bytes of a block at least, and blocks of a corpus at most: larger corpora have larger blocks. The plan is a number for each
#: block, so what is sent to all executors is 8 MB at most.
BLOCK_BYTES, BLOCKS = 64 << 10, 1 << 20
#: Sources at most; their list and weights are the driver's.
SOURCES = 100_000
#: Blocks of a source in one row of the plan.
CHUNK = 1024
#: Exponent of a source's bytes in its default weight: 1 keeps the sources' own proportions, 0 makes all alike.
TEMPERATURE = 0.5
#: Rows of a source that one task sorts, about: the first while there are no more than PIECES pieces a source, else the second.
PIECE_ROWS, PIECES, MOST_ROWS = 2_000, 4096, 200_000


def fractions_of(weights: dict[str, float]) -> dict[str, Fraction]:
    """Exact weights that add up to one."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    return {s: w / total for s, w in exact.items()}


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = fractions_of(weights)
    unit = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * unit) for s, w in exact.items()}


def schedule(weights: dict[str, int], slots: int) -> list[str]:
    """The source of each of the first slots while all sources last: earliest deadline first among released blocks; ties go by name."""
    names, total = sorted(weights), sum(weights.values())
    source, _ = turns([weights[s] for s in names], [slots * weights[s] // total + 2 for s in names])
    return [names[k] for k in source[:slots]]


def turns(weight: list[int], blocks: list[int]) -> tuple[array, array]:
    """Source and slot of every block, by slot. weight: whole numbers; blocks: how many each source has."""
    total = sum(weight)
    waiting = [(0, s, 0) for s in range(len(weight)) if blocks[s]]  # by release
    ready: list[tuple[int, int, int]] = []
    source, at, slot = array("i"), array("q"), 0
    while waiting or ready:
        if not ready and waiting[0][0] > slot:  # turns of sources that have run out
            slot = waiting[0][0]
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weight[s]), s, k))  # when block k, counted from 0, is due
        _, s, k = heapq.heappop(ready)
        source.append(s)
        at.append(slot)
        slot += 1
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * total // weight[s], s, k + 1))
    return source, at


def mix(docs: DataFrame, size: Column | None = None, weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES, temperature: float = TEMPERATURE, row: str | None = None) -> DataFrame:
    """Adds mix_block (block within the source), mix_slot (when the block's turn is) and mix_offset (bytes into the block).

    Ordered by (mix_slot, mix_offset) all rows stand in mixed order; none is dropped or repeated. After any number of slots
    every source that lasts is less than one block away from its weight; where one has run out its turns are empty and the
    others go on in proportion.

    weights: by source, by default each source's bytes to the power `temperature`; sources without one are refused. A null
    source is a source of its own. A document counts its UTF-8 bytes and one more (or `size`), so null and empty texts have a
    place. It belongs to the block that its first byte falls into. Within a source the order is that of a hash of all columns.
    `row` names a column that is different for each row and stays the same; it spreads rows that agree in all other columns over
    tasks.
    block_bytes grows where there would be more than BLOCKS blocks. The list of sources comes to the driver and more than SOURCES
    of them are refused. docs is read several times, so it should be a table. No rows in, no rows out.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1 if size is None else size
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    carry = [c for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_offset")]
    order = F.xxhash64(*[F.col(c) for c in carry if c not in ("source", row)], F.lit("mix"))
    rows = docs.select(*carry, size.alias("_mix_size"), key.alias("_mix_source"), order.alias("_mix_order"), (F.lit(0) if row is None else F.pmod(F.xxhash64(row), F.lit(1 << 30))).alias("_mix_same"))
    of = {r["_mix_source"]: (r["n"], r["b"]) for r in rows.groupBy("_mix_source").agg(F.count(F.lit(1)).alias("n"), F.sum("_mix_size").alias("b")).limit(SOURCES + 1).collect()}
    if len(of) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources; mix by a coarser column")
    if weights is None:
        target = {s: float(b) ** temperature for s, (_, b) in of.items()}
    else:
        named = {"0" if s is None else f"1{s}": w for s, w in weights.items()}
        if missing := sorted(set(of) - set(named)):
            raise ValueError(f"no weight for sources {[x[1:] or None for x in missing]}")
        target = {s: named[s] for s in of}
    block_bytes = max(block_bytes, -(-sum(b for _, b in of.values()) // BLOCKS))
    names, weight = sorted(target), whole_weights(target) if target else {}
    blocks = [-(-of[s][1] // block_bytes) for s in names]
    plan = docs.sparkSession.createDataFrame(_plan(names, *turns([weight[s] for s in names], blocks)))
    most = max((n for n, _ in of.values()), default=0)
    pieces = 1 + max(min(most // PIECE_ROWS, PIECES), most // MOST_ROWS)
    rows = rows.withColumn("_mix_piece", F.pmod("_mix_order", F.lit(pieces)))
    counts = rows.groupBy("_mix_source", "_mix_piece").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(F.broadcast(hot_keys(counts, "n")), ["_mix_source", "_mix_piece"], "left")
    rows = rows.withColumn("_mix_piece", F.col("_mix_piece") * (1 << 30) + F.pmod("_mix_same", F.coalesce("_parts", F.lit(1)))).drop("_parts")
    rows = number_within(rows, "_mix_source", "_mix_piece", [F.col("_mix_order"), *[F.col(c) for c in ("doc_id",) if c in carry], F.col("_mix_size")], "_mix_row", "_mix_size", "_mix_before")
    rows = rows.withColumn("mix_block", F.floor(F.col("_mix_before") / block_bytes).cast("long")).withColumn("mix_offset", F.pmod("_mix_before", F.lit(block_bytes)))
    rows = rows.withColumn("_mix_chunk", F.floor(F.col("mix_block") / CHUNK).cast("int")).join(F.broadcast(plan), ["_mix_source", "_mix_chunk"])
    slot = F.element_at("_mix_slots", F.pmod("mix_block", F.lit(CHUNK)).cast("int") + 1)
    return rows.withColumn("mix_slot", slot).select(*carry, "mix_block", "mix_slot", "mix_offset")


def _plan(names: list[str], source: array, slot: array) -> pa.Table:
    """The slots of each source's blocks, CHUNK blocks a row."""
    source, slot = np.asarray(source, dtype=np.int32), np.asarray(slot, dtype=np.int64)
    order = np.argsort(source, kind="stable")
    ends = np.cumsum(np.bincount(source, minlength=len(names))) if len(names) else []
    rows = [(s, k, own[k * CHUNK : (k + 1) * CHUNK]) for s, own in zip(names, np.split(slot[order], ends)[:-1] if len(names) else [], strict=True) for k in range(-(-len(own) // CHUNK))]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
    schema = pa.schema([("_mix_source", pa.string()), ("_mix_chunk", pa.int32()), ("_mix_slots", pa.list_(pa.int64()))])
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the mixed order, at the default weights and block size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    narrow = Scratch(spark, "mixing").table(docs.select("doc_id", "source", size.alias("n_bytes"), crc.alias("crc"), F.monotonically_increasing_id().alias("row")), "sizes")
    return mix(narrow, F.col("n_bytes") + 1, row="row").select("doc_id", "source", "n_bytes", "mix_block", "mix_slot", "mix_offset")
