"""A pluggable source: files of a folder through Spark's Python data source API."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.suffixes = options["path"], tuple(options.get("suffixes", "").split(",")) if options.get("suffixes") else ()
        self.bytes_per_part = int(options.get("bytesPerPart", str(64 << 20)))

    def _open(self):
        """The file system that the folder's address names, and the path in it: a shared folder of any kind that Arrow reads."""
        from pyarrow import fs

        if "://" in self.folder or self.folder.startswith("file:"):
            return fs.FileSystem.from_uri(self.folder)
        return fs.LocalFileSystem(), self.folder

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        system, root = self._open()
        found = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and (not self.suffixes or f.path.endswith(self.suffixes))]
        parts, size = [[]], 0
        for f in sorted(found, key=lambda f: f.path):
            if parts[-1] and size + f.size > self.bytes_per_part:
                parts.append([])
                size = 0
            parts[-1].append(f.path)
            size += f.size
        return [Part(p) for p in parts]

    def read(self, partition: Part) -> Iterator[tuple]:
        system, _ = self._open()
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                raw = f.read()
            yield path, raw.decode("utf-8", "replace"), "sha256:" + hashlib.sha256(raw).hexdigest()


class FolderSource(DataSource):
    """``spark.read.format("sourcefolder").option("path", …)``: path, source and sha256; parts are made by size in bytes."""

    @classmethod
    def name(cls) -> str:
        return "sourcefolder"

    def schema(self) -> str:
        return "path string, source string, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSource)
