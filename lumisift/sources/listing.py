"""Files of folders as a data source: one task lists one shard of folders.

Options: ``folders`` (a JSON list of folders), or ``root`` with ``skip`` (a JSON
list of beginnings of names): then the root and its direct subfolders but those
that are skipped. Names that begin with ``_`` or ``.`` are files like others.
Only the subfolders of a root are listed by the driver.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .paths import filesystem, same_path

SCHEMA = "folder string, path string, name string, suffix string, length long, modified timestamp"
#: Most tasks of a listing.
SHARDS = 4096


def suffix_of(name: str) -> str:
    """With its dot, in lower case; a name's first character begins none."""
    at = name.rfind(".")
    return name[at:].lower() if at > 0 and at < len(name) - 1 else ""


class FolderFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def folders(self) -> list[str]:
        if "folders" in self.options:
            return json.loads(self.options["folders"])
        root, skip = self.options["root"], tuple(json.loads(self.options.get("skip", "[]")))
        fs, path, before = filesystem(root)
        below = [f for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.Directory]
        return [root, *sorted(before + f.path for f in below if not (skip and f.base_name.startswith(skip)))]

    def partitions(self) -> list[InputPartition]:
        folders = self.folders()
        n = max(1, min(SHARDS, len(folders)))
        return [InputPartition(folders[i::n]) for i in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for folder in partition.value:
            fs, path, before = filesystem(folder)
            for name, inner, size, seconds in _files(fs, path):
                yield same_path(folder), same_path(before + inner), name, suffix_of(name), size, datetime.fromtimestamp(seconds, timezone.utc)


def _files(fs: pafs.FileSystem, path: str) -> Iterator[tuple[str, str, int, float]]:
    """Name, path, size and time of change of a folder's files; those of a local
    folder are told one by one, so that a large one is not held."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(path) as entries:
            for e in entries:
                if e.is_file():
                    yield e.name, f"{path.rstrip('/')}/{e.name}", e.stat().st_size, e.stat().st_mtime
        return
    for f in fs.get_file_info(pafs.FileSelector(path)):
        if f.type == pafs.FileType.File:
            yield f.base_name, f.path, f.size, f.mtime.timestamp() if f.mtime is not None else 0.0


def list_folders(spark: SparkSession, **options) -> DataFrame:
    """The listing, with ``folders=[...]`` or ``root=...`` and ``skip=[...]``."""
    spark.dataSource.register(FolderFiles)
    given = {k: v if isinstance(v, str) else json.dumps(list(v)) for k, v in options.items()}
    return spark.read.format("folder_files").options(**given).load()
