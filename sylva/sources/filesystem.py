"""Directory trees as node tables: a Python data source named `sylva_fs`.

directory(name, file(name, filelink(@xlink:type, @xlink:href), path, size, permissions, type, userid, groupid, lastAccess,
lastModification)*, directory*), depth first and by name; symbolic links are left out. Each root given is a document.
"""

from __future__ import annotations

import os
import stat
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sylva.model import NODES
from sylva.session import ready
from sylva.sources.shred import Builder


def _leaf(builder: Builder, tag: str, text: str) -> None:
    builder.start(tag, ())
    builder.text(text)
    builder.end()


def _file(builder: Builder, entry: os.DirEntry) -> None:
    s = entry.stat(follow_symlinks=False)
    when = lambda t: datetime.fromtimestamp(t, UTC).strftime("%Y-%m-%d %H:%M:%S")
    builder.start("file", ())
    _leaf(builder, "name", entry.name)
    builder.start("filelink", (("xlink:type", "simple"), ("xlink:href", f"file://{entry.path}")))
    builder.end()
    mode = stat.filemode(s.st_mode)
    for tag, text in (("path", entry.path), ("size", str(s.st_size)), ("permissions", mode[1:]), ("type", "regular" if stat.S_ISREG(s.st_mode) else "special"), ("userid", str(s.st_uid)), ("groupid", str(s.st_gid)), ("lastAccess", when(s.st_atime)), ("lastModification", when(s.st_mtime))):
        _leaf(builder, tag, text)
    builder.end()


def walk(builder: Builder, path: str) -> None:
    """Adds a directory and all below it."""
    builder.start("directory", ())
    _leaf(builder, "name", os.path.basename(path.rstrip("/")) or path)
    entries = sorted((e for e in os.scandir(path) if not e.is_symlink()), key=lambda e: e.name)
    for e in entries:
        if not e.is_dir(follow_symlinks=False):
            _file(builder, e)
    for e in entries:
        if e.is_dir(follow_symlinks=False):
            walk(builder, e.path)
    builder.end()


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots = roots

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(len(self.roots))]

    def read(self, partition: InputPartition):
        builder = Builder(partition.value)
        walk(builder, self.roots[partition.value])
        for row in builder.finish():
            yield (*row, None, None, None)


class FileSystemSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sylva_fs"

    def schema(self):
        return NODES

    def reader(self, schema) -> _Reader:
        return _Reader([p for p in self.options["path"].split(os.pathsep) if p])


def list_files(spark: SparkSession, *roots: str) -> DataFrame:
    """The node table of directory trees that every executor sees under the same path."""
    ready(spark).dataSource.register(FileSystemSource)
    return spark.read.format("sylva_fs").option("path", os.pathsep.join(roots)).load()
