"""Directories as tables: a Python data source that lists every file, dot-files included, and a reader of contents."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.functions.registry import EXCLUDED_DIRS


class Folder(InputPartition):
    def __init__(self, root: str, sub: str, deep: bool):
        self.root, self.sub, self.deep = root, sub, deep


class Inventory(DataSource):
    """``spark.read.format("quern_files").option("path", folder)``: path, rel_path, length, mtime of all files below.

    Options: ``exclude_dirs`` (comma list, besides the usual ones), ``recursive`` (default true), ``splits`` (folders
    that the driver looks into to deal the work out, default 256). Pruned folders are
    not entered. Spark's own recursive file source leaves out names that start with a dot or underscore.
    """

    @classmethod
    def name(cls) -> str:
        return "quern_files"

    def schema(self) -> str:
        return "path string, rel_path string, length long, mtime double"

    def reader(self, schema) -> DataSourceReader:
        return _Lister(self.options)


class _Lister(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.splits = int(options.get("splits", "256"))
        self.pruned = {*EXCLUDED_DIRS, *(x.strip().strip("/\\") for x in options.get("exclude_dirs", "").split(",") if x.strip())}

    def partitions(self) -> list[InputPartition]:
        """Folders are taken apart from the top, level by level, until there are ``splits`` of them: the own files of each
        folder taken apart, and each folder not taken apart with all below it, are a partition. So one deep folder is
        spread as well, and the driver lists no more than about ``splits`` folders."""
        own, whole = [], [""]
        while whole and self.recursive and len(own) + len(whole) < self.splits:
            top = whole.pop(0)
            own.append(top)
            with os.scandir(os.path.join(self.root, top)) as entries:
                whole += sorted(os.path.join(top, x.name) for x in entries if x.is_dir(follow_symlinks=False) and x.name not in self.pruned)
        return [Folder(self.root, x, False) for x in (own if self.recursive else whole)] + [Folder(self.root, x, True) for x in whole if self.recursive]

    def read(self, partition: Folder) -> Iterator[tuple]:
        for top, folders, names in os.walk(os.path.join(partition.root, partition.sub)):
            folders[:] = sorted(x for x in folders if x not in self.pruned) if partition.deep else []
            for name in sorted(names):
                path = os.path.join(top, name)
                try:
                    stat = os.stat(path)
                except OSError:
                    yield path, os.path.relpath(path, partition.root), None, None
                    continue
                yield path, os.path.relpath(path, partition.root), stat.st_size, stat.st_mtime


def inventory(spark: SparkSession, folder: str, exclude_dirs: str = "", recursive: bool = True) -> DataFrame:
    spark.dataSource.register(Inventory)
    return spark.read.format("quern_files").option("path", folder).option("exclude_dirs", exclude_dirs).option("recursive", str(recursive).lower()).load()


def with_content(listed: DataFrame, most: int = (1 << 31) - 1) -> DataFrame:
    """``listed`` with ``content``, read by the executors; null for what cannot be read or is above ``most`` bytes.
    Filter before this step: listing reads no content."""
    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                try:
                    size = os.path.getsize(row.column("path")[0].as_py())
                    with open(row.column("path")[0].as_py(), "rb") as file:
                        data = file.read() if size <= most else None
                except OSError:
                    data = None
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], [*row.schema.names, "content"])

    return listed.mapInArrow(read, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema) + ", content binary")


def read_binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, content) by Spark's own reader: any file system Spark knows, without names that start with a dot."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select("path", "content")
