"""Reading and writing documents and node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.model import COLUMNS, NODES, SpecError
from sylva.operators.serialize import to_xml
from sylva.sources.shred import shred


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path and text of whole files. The identifier is a hash of the path, so it is the same in every run and nothing is
    gathered to number the files."""
    rows = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select(F.xxhash64("path").bitwiseAND((1 << 63) - 1).alias("doc_id"), "path", "text")


def detect(spark: SparkSession, path: str) -> str:
    """nodes for a stored node table, html or xml for text, by the first 512 bytes of one of the files."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.listFiles(where, True) if files.exists(where) else None
    while found is not None and found.hasNext():
        status = found.next()
        if not status.getPath().getName().startswith(("_", ".")) and status.getLen():
            break
    else:
        raise SpecError(f"nothing at {path}")
    stream = files.open(status.getPath())
    try:
        head = bytes(stream.readNBytes(512))
    finally:
        stream.close()
    if head[:4] == b"PAR1":
        return "nodes"
    start = head.lstrip(b"\xef\xbb\xbf \t\r\n").lower()
    return "html" if start.startswith((b"<!doctype html", b"<html")) else "xml"


def read_documents(spark: SparkSession, path: str, form: str = "auto", on_error: str = "fail", paths: list[str] | None = None, record: str | None = None) -> DataFrame:
    """The node table of what lies at a path: a stored node table, XML files or HTML files.

    record: an element of large files that is a document of its own; many tasks then read one file (read_records()).
    """
    form = detect(spark, path) if form == "auto" else form
    if form == "nodes":
        return read_nodes(spark, path)
    if record is not None:
        return shred(read_records(spark, path, record), "xml", dialect=form, on_error=on_error, paths=paths)
    return shred(read_texts(spark, path), "text", dialect=form, on_error=on_error, paths=paths)


def read_records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """doc_id and xml of each element `tag` of large files, which many tasks read at once.

    The text source cuts at the end tags. The element must not lie within itself, nor its end tag within comments or CDATA.
    Identifiers ascend in the order of files and of elements in a file, with gaps.
    """
    rows = spark.read.option("lineSep", f"</{tag}>").text(path).select(F.monotonically_increasing_id().alias("doc_id"), "value")
    start = F.regexp_extract("value", rf"(?s)(<{tag}(?:\s[^>]*)?>.*)$", 1)
    return rows.select("doc_id", F.concat(start, F.lit(f"</{tag}>")).alias("xml")).where(start != "")


def write_nodes(nodes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Stores a node table with each task's rows in order of label path, so a query on few paths skips the others by the page and
    row group statistics of each file.

    Nodes are computed once and stay in the task that makes them: what a task sorts does not grow with the table, and an order over
    all files would take a shuffle of all nodes and their making twice, the first time for the sample of its ranges.
    """
    nodes.select(*COLUMNS).sortWithinPartitions("path", "doc_id", "pre").write.mode(mode).parquet(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODES).parquet(path)


def write_xml(nodes: DataFrame, path: str, indent: int = 0, mode: str = "errorifexists") -> None:
    """Writes each document on a line of its own (or lines, with an indent)."""
    to_xml(nodes, indent=indent).select("xml").write.mode(mode).text(path)


def discard(df: DataFrame) -> None:
    """Computes everything and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()
