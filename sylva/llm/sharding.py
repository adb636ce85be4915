"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

A record's identifier hashes to one of thousands of virtual slots; the slot never changes. Bytes are summed per slot, and a
small map says which shard holds a slot. Rebalancing edits the map only: it moves or swaps as few slots as close the gap
between the fullest and the emptiest shard, and stores the result as the map's next version beside the older ones.

Where many records share one identifier their slot is heavy. Slots above a share of a shard are dealt over further slots by
record, so that one of them is never more than that share; records in them are not placed by identifier alone.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, literal_rows, number_within

SLOTS = 8192
#: Rows of a slot that one task sorts; larger slots are dealt over more tasks.
SLOT_ROWS = 200_000
#: A slot that holds more than one part in HEAVY of a shard's share is dealt over further slots.
HEAVY = 16


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def slot_of(doc_id: Column, crc: Column, slots: int = SLOTS) -> Column:
    """The virtual slot: a hash of the identifier, or of the text's checksum where the identifier is null."""
    return F.pmod(F.when(doc_id.isNull(), F.xxhash64(crc)).otherwise(F.xxhash64(doc_id)), F.lit(slots)).cast("int")


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1, before anything is known of sizes: runs of neighbouring slots."""
    return [s * shards // slots for s in range(slots)]


def rebalance(shard_of: list[int], weight: list[int], shards: int, rounds: int = 20_000) -> list[int]:
    """An edited copy of the map with near equal weights.

    Each round takes the fullest shard that can still give and the emptiest one, and makes the move or swap of slots whose
    weight comes nearest to half their gap. A shard that can't improve is left as it is. Ties go to the smaller number.
    """
    held = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        if shard < shards:
            held[shard].append((weight[slot], slot))
    load = [sum(w for w, _ in h) for h in held]
    for slot, shard in enumerate(shard_of):
        if shard >= shards:  # the shard is gone
            to = load.index(min(load))
            held[to].append((weight[slot], slot))
            load[to] += weight[slot]
    for h in held:
        h.sort()
    settled: set[int] = set()
    for _ in range(rounds):
        givers = [s for s in range(shards) if s not in settled]
        if not givers:
            break
        high, low = max(givers, key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        best = None
        if gap > 1:
            # giving w and taking v changes the gap to |gap - 2 (w - v)|; v = 0 is a plain move
            for v, back in [(0, None), *held[low]]:
                at = bisect_left(held[high], (v + gap / 2,))
                for k in (at - 1, at):
                    if 0 <= k < len(held[high]) and 0 < (d := held[high][k][0] - v) < gap:
                        left = abs(gap - 2 * d)
                        if best is None or (left, back is not None) < best[:2]:
                            best = (left, back is not None, held[high][k], (v, back))
        if best is None:
            settled.add(high)
            continue
        _, swapped, give, take = best
        held[high].remove(give)
        held[low].append(give)
        load[high] -= give[0]
        load[low] += give[0]
        if swapped:
            held[low].remove(take)
            held[high].append(take)
            load[high] += take[0]
            load[low] -= take[0]
        held[high].sort()
        held[low].sort()
    out = list(shard_of)
    for shard, h in enumerate(held):
        for _, slot in h:
            out[slot] = shard
    return out


class SlotMap:
    """The stored map: a table (version, vslot, shard, bytes); every edit appends a version, older ones can still be read.

    Opened at a path that holds a map it goes on from the newest version. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        self.version = int(self._table().agg(F.max("version")).first()[0] or 0) if there else 0

    def _table(self) -> DataFrame:
        return self.spark.read.schema("vslot int, shard int, bytes bigint, version int").parquet(self.path)

    def store(self, shard_of: list[int], weight: list[int]) -> int:
        """Appends a version. The rows travel as one literal, so no Python worker is needed to write them."""
        self.version += 1
        rows = [{"vslot": k, "shard": s, "bytes": w} for k, (s, w) in enumerate(zip(shard_of, weight, strict=True))]
        df = literal_rows(self.spark, rows, "vslot:int,shard:int,bytes:bigint").withColumn("version", F.lit(self.version))
        df.coalesce(1).write.mode("append").parquet(self.path)
        return self.version

    def read(self, version: int | None = None) -> DataFrame:
        return self._table().where(F.col("version") == (version or self.version))

    def newest(self) -> list[int]:
        """The shard of each slot: a row for each slot, some thousands."""
        return [r["shard"] for r in self.read().orderBy("vslot").collect()]


def heavy_slots(weight: list[int], shards: int) -> dict[int, int]:
    """How many slots each heavy slot is dealt over; together no more than HEAVY * shards further ones."""
    most = max(1, sum(weight) // (HEAVY * shards))
    return {k: -(-w // most) for k, w in enumerate(weight) if w > most and most > 1}


def assign_shards(spark: SparkSession, records: DataFrame, shards: int, slots: int = SLOTS, order: tuple[str, str] | None = None, map_path: str | None = None) -> DataFrame:
    """Places all records into shards 0 to shards - 1 under the law `bytes`: sizes near equal.

    records: doc_id, size, text_crc32; any further columns are carried along. Adds vslot (virtual slot), shard and slot
    (place within the shard, gapless from 0). A null identifier is placed by its text's checksum. Records of a heavy slot (many
    rows of one identifier, or equal texts without one) are dealt over further slots, so groups of equal texts need not stay
    together: law `bytes` binds sizes alone. No rows in, no rows out. Columns of the input named vslot, shard or slot are replaced.

    `map_path` is where the map is kept: a map that stands there is edited by as few moves as restore the balance, for more or
    fewer shards too, and the edit becomes its next version. Without it a map of its own is made. `order` names two columns that
    places within a shard ascend in: a piece that a task can sort, and the place in it. Without it they ascend in virtual slot
    and identifier.
    """
    scratch = Scratch(spark, "shards")
    records = records.drop("vslot", "shard", "slot", "_piece", "_row")
    base = records.withColumn("vslot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots)).withColumn("_row", F.monotonically_increasing_id())
    base = scratch.table(base, "records")
    # at most `slots` rows, whatever the input holds
    weight = [0] * slots
    for r in base.groupBy("vslot").agg(F.sum("size").alias("b")).collect():
        weight[r["vslot"]] = r["b"]
    heavy, first = [], slots
    for k, parts in heavy_slots(weight, shards).items():
        heavy.append({"vslot": k, "_first": first, "_parts": parts})
        first += parts
    if heavy:
        base = base.join(F.broadcast(literal_rows(spark, heavy, "vslot:int,_first:int,_parts:int")), "vslot", "left")
        base = base.withColumn("vslot", F.coalesce(F.col("_first") + F.pmod(F.xxhash64("_row"), F.col("_parts")), F.col("vslot")).cast("int")).drop("_first", "_parts")
    sums = base.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()  # slots and a few more
    weight = [0] * first
    for r in sums:
        weight[r["vslot"]] = r["b"]
    maps = SlotMap(spark, map_path or scratch.path("slot_map"))
    if not maps.version:
        maps.store(first_map(shards, slots) + [k % shards for k in range(first - slots)], weight)
    before = maps.newest()[:first]
    before += [k % shards for k in range(first - len(before))]
    maps.store(rebalance(before, weight, shards), weight)
    pieces = 1 + max((r["n"] for r in sums), default=0) // SLOT_ROWS
    placed = base.join(F.broadcast(maps.read().select("vslot", "shard")), "vslot")  # a row of two numbers for each slot
    spread = F.pmod(F.xxhash64("_row"), F.lit(pieces))
    placed = placed.withColumn("_piece", F.col(order[0]) if order else F.col("vslot").cast("long") * pieces + spread)
    return number_within(placed, "shard", "_piece", [*([F.col(order[1])] if order else []), F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("_row")]).drop("_piece", "_row")


def op1(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """All documents in shards 0 to 23, near equal in bytes. grown_shard is null: only the law `key` has it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(assign_shards(spark, docs.select("doc_id", size_of(F.col("text")).alias("size"), crc_of(F.col("text")).alias("text_crc32")), shards))


def digest(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
