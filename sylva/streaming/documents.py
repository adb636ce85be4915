"""Documents as they arrive: a record is a whole document, so shredding and all operators on single documents keep no state.

Grouping by document within a stream would wait for a watermark that documents do not have. Operators with a shuffle
therefore run on each micro-batch as on a table; a document never spans batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sylva.sources.shred import shred


def stream_texts(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """doc_id and xml of whole files as they appear. The identifier is a hash of the path that is never negative."""
    raw = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_a_batch).text(path)
    return raw.select(F.xxhash64("_metadata.file_path").bitwiseAND(F.lit((1 << 63) - 1)).alias("doc_id"), F.col("value").alias("xml"))


def stream_nodes(spark: SparkSession, path: str, on_error: str = "drop", paths: list[str] | None = None) -> DataFrame:
    """The node table of documents as they appear; malformed ones are left out unless told otherwise."""
    return shred(stream_texts(spark, path), on_error=on_error, paths=paths)


def each_batch(nodes: DataFrame, query: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Applies a query on node tables to each micro-batch and writes its result as Parquet.

    A batch goes to a folder that its number names and is overwritten when run again, so each document counts once.
    """

    def run(batch: DataFrame, number: int) -> None:
        query(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = nodes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
