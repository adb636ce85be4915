"""The corpus pipeline: language ID, near-dedup, decontamination, mixing and sharding, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import decontaminate, dedup, langid, mixing, sharding
from sylva.llm.common import Scratch

SHARDS = 24


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts that are null, have no letter or resemble no language go."""
    return langid.reject_unknown(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return dedup.one_of_each(docs, Scratch(spark, "pipeline-dedup"))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each once, in the order that mixes the sources to their target weights: files and rows ascend in it."""
    rows = docs.withColumn("_row", F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")))
    return mixing.mix(rows, row="_row").orderBy("mix_slot", "mix_offset").select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: the columns of op1. Within a shard documents stand in the order of docs' files and rows."""
    file, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    piece = F.concat_ws("/", file, F.lpad(F.floor(row / sharding.SLOT_ROWS).cast("string"), 12, "0"))
    rows = docs.select("doc_id", sharding.size_of(F.col("text")).alias("size"), sharding.crc_of(F.col("text")).alias("text_crc32"), piece.alias("file_piece"), row.alias("file_row"))
    return sharding.digest(sharding.assign_shards(spark, rows, SHARDS, order=("file_piece", "file_row")))


STAGES = [("language", known_language), ("near_duplicates", one_of_each), ("decontamination", without_leaks), ("mixing", mixed), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again as the next one's documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs


#: Language profiles, hash minima and the schedule have no plain SQL; the tests hold run() against brute force.
ORACLE_SQL = None
