"""Helpers that the operators of this subpackage share: scratch tables, word hashing, two-level numbering, binary files."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.session import ready as workers_ready

#: Odd multiplier that combines the hashes of neighbouring words into the hash of a window.
MIX = np.uint64(0x9E3779B97F4A7C15)


#: Bytes of an Arrow batch. Spark's own 64 MB of whole texts stand in the JVM and again in each Python worker.
BATCH_BYTES = 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """A session whose Python workers find this package, with small Arrow batches unless the user set a size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, BATCH_BYTES)
    return workers_ready(spark)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local master (tests) gets a temporary folder when the setting is missing.
    """
    conf = spark.sparkContext.getConf()
    if root := conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="sylva-shared-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Written tables in the shared folder. They cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = ready(spark)
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_binary(df: DataFrame, path: str, rows_a_file: int = 0) -> None:
    """Writes the binary column `bytes` row after row, a NUL byte after each; a task makes one file (0) or more.

    Spark's own writer and committer do the work, so any store that Spark can write will do and a task that is run
    again leaves no half file. Formats on top make the NUL the last byte of a row's own bytes or skip it as padding.
    """
    rows = df.select(F.col("bytes").cast("string"))
    rows.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", rows_a_file).text(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Columns path and content, a row for each file of write_binary()."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_pieces(spark: SparkSession, path: str, glob: str = "part-*") -> DataFrame:
    """The bytes of files of any size as rows (file, piece): a partition holds whole files, one after the other, in order.

    Spark's line reader reads ranges of the files in parallel and cuts at NUL bytes, which the pieces leave out, so no task holds
    a file. Every piece is followed by a NUL, also the last one of a file that does not end with one.
    """
    rows = spark.read.option("lineSep", "\0").option("pathGlobFilter", glob).text(path)
    at = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_n")]
    rows = rows.select(*at, F.col("value").cast("binary").alias("piece"))
    return rows.repartition("file").sortWithinPartitions("file", "_start", "_n").select("file", "piece")


#: Rows of a sift's filter at most (512 bits each, about 30 MB in all as broadcast), and bits for each key below that.
SIFT_ROWS, SIFT_BITS = 1 << 18, 12


def sift(rows: DataFrame, key: str, ids: DataFrame, n: int) -> DataFrame:
    """rows with a boolean _maybe, which is false only where `key` is none of the n keys in the one column of ids.

    A Bloom filter out of plain expressions: a key sets three bits in one of the eight words of a filter row. It is broadcast
    and never larger than SIFT_ROWS rows. With more keys than those can tell apart more rows say maybe, nothing else changes:
    an exact join of the maybes follows. So wide rows that a few keys decide about need no shuffle of all of them.
    """
    places = max(1, min(SIFT_ROWS, -(-n * SIFT_BITS // 512)))

    def parts(c: Column) -> tuple[Column, Column, Column]:
        other = F.xxhash64(c, F.lit(1))
        bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(other, k).bitwiseAND(63).cast("int"))
        return F.pmod(F.xxhash64(c), F.lit(places)).cast("int"), other.bitwiseAND(7).cast("int"), bit(3).bitwiseOR(bit(9)).bitwiseOR(bit(15))

    place, word, mask = parts(F.col(ids.columns[0]))
    held = ids.where(F.col(ids.columns[0]).isNotNull()).select(place.alias("_place"), word.alias("_word"), mask.alias("_mask"))
    words = F.array(*[F.coalesce(F.bit_or(F.when(F.col("_word") == k, F.col("_mask"))), F.lit(0).cast("long")) for k in range(8)])
    held = held.groupBy("_place").agg(words.alias("_words"))
    place, word, mask = parts(F.col(key))
    hit = F.coalesce(F.element_at("_words", word + 1).bitwiseAND(mask) == mask, F.lit(False)) & F.col(key).isNotNull()
    return rows.join(F.broadcast(held), place == F.col("_place"), "left").withColumn("_maybe", hit).select(*rows.columns, "_maybe")


#: Keys that are dealt over several tasks, at most, and rows of a key that one task takes at least.
HOT_KEYS, HOT_ROWS = 50_000, 20_000


def hot_keys(counts: DataFrame, n: str) -> DataFrame:
    """Of counts (keys and n) the keys with so many rows that they are to be dealt, with _parts, how many tasks share them.

    A key's share of all rows makes it hot, so there are no more than HOT_KEYS, whatever the input holds.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    most = max(HOT_ROWS, -(-total // HOT_KEYS))
    return counts.where(F.col(n) > most).withColumn("_parts", F.ceil(F.col(n) / most).cast("int")).drop(n)


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left joined with right by keys; rows of hot keys (hot_keys()) are dealt over tasks by a hash of left's columns `by`, and
    right's rows go to each of those. right has few rows a key."""
    hot = F.broadcast(hot)
    parts = F.coalesce("_parts", F.lit(1))
    a = left.join(hot, keys, "left").withColumn("_deal", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_parts")
    b = right.join(hot, keys, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return a.join(b.hint("merge"), [*keys, "_deal"], how).drop("_deal")


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table out of a literal; no Python worker and no RDD take part."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a step holds for a batch stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def hash_words(words: list[bytes]) -> np.ndarray:
    of = xxhash.xxh3_64_intdigest
    return np.fromiter(map(of, words), dtype=np.uint64, count=len(words))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k neighbouring words; none if there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= MIX
        out += hashes[j : j + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def number_within(df: DataFrame, group: str, part: str, order: list[Column], out: str = "slot", weight: str | None = None, before: str | None = None) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, however large the group is.

    `part` splits a group into pieces that a task can sort. Rows are ranked within (group, part); counts of the pieces,
    summed in order of `part`, give where each piece starts. With `weight`, `before` gets the weight of all rows before a
    row. df is read twice, so it should be a written table; group and part are not null.
    """
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(weight).alias("_w")] if weight else [])
    pieces = df.groupBy(group, part).agg(*sums)
    ahead = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = [F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start")]
    starts += [F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_weight_start")] if weight else []
    pieces = pieces.select(group, part, *starts)
    own = Window.partitionBy(group, part).orderBy(*order)
    ranked = df.withColumn(out, F.row_number().over(own).cast("long") - 1)
    if weight:
        ranked = ranked.withColumn(before, F.coalesce(F.sum(weight).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = ranked.join(pieces, [group, part])
    joined = joined.withColumn(out, F.col(out) + F.col("_start"))
    if weight:
        joined = joined.withColumn(before, F.col(before) + F.col("_weight_start"))
    return joined.drop("_start", "_weight_start")


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the identifier as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
