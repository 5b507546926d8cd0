"""Sets of files as a data source: staged by tasks, moved into place by one
commit.

Rows have ``target`` (a path below the set's root) and ``source`` (a file to
copy) or ``content`` (its bytes). Every task attempt writes to a folder of its
own in the staging folder below the root; the attempts that Spark accepts name
their manifests, and the driver moves what these list. A job that fails removes
its staging folder and leaves nothing behind; an attempt that failed, was
repeated or ran twice is not moved. Of rows with one target one is left.
"""

from __future__ import annotations

import io
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..sources.paths import filesystem, same_path

COLUMNS = ("target", "source", "content")
#: Moves that the driver has under way at once.
MOVERS = 16
#: Moves whose names the driver holds at once.
MOVES = 4096
BLOCK = 1 << 20
#: How often a staging folder is tried to be removed.
TRIES = 10


class FileSet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_set"

    def schema(self) -> str:
        return "target string, source string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileSetWriter(self.options["path"])


@dataclass
class Staged(WriterCommitMessage):
    """The manifest of an accepted attempt."""

    manifest: str | None


class FileSetWriter(DataSourceWriter):
    """Made on the driver, which makes the staging folder: tasks that go on for
    a moment after a failed job cannot make it anew."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.run = f".staging-{uuid.uuid4().hex}"
        fs, base, _ = filesystem(self.root)
        fs.create_dir(f"{base}/{self.run}", recursive=True)

    def write(self, iterator: Iterator) -> Staged:
        fs, base, _ = filesystem(self.root)
        folder = f"{base}/{self.run}/{uuid.uuid4().hex}"
        manifest = []
        for n, row in enumerate(iterator):
            target = row["target"]
            if not target or target.startswith("/") or ".." in target.split("/"):
                raise ValueError(f"not a path below the set's root: {target}")
            if not manifest:
                fs.create_dir(folder, recursive=False)
            staged = f"{folder}/{n}"
            if row["source"] is not None:
                self._copy(row["source"], fs, staged)
            else:
                with fs.open_output_stream(staged) as out:
                    out.write(bytes(row["content"]))
            manifest.append(f"{n}\t{target}")
        if not manifest:
            return Staged(None)
        with fs.open_output_stream(f"{folder}/manifest") as out:
            out.write("\n".join(manifest).encode())
        return Staged(folder)

    @staticmethod
    def _copy(source: str, fs: pafs.FileSystem, staged: str) -> None:
        other, path, _ = filesystem(source)
        if isinstance(fs, pafs.LocalFileSystem) and isinstance(other, pafs.LocalFileSystem):
            shutil.copy2(path, staged)  # with its times
            return
        with other.open_input_stream(path) as read, fs.open_output_stream(staged) as out:
            while block := read.read(BLOCK):
                out.write(block)

    def commit(self, messages: list) -> None:
        fs, base, _ = filesystem(self.root)
        made: set[str] = set()

        def move(pairs: list[tuple[str, str]]) -> None:
            for staged, target in pairs:
                if isinstance(fs, pafs.LocalFileSystem):
                    os.replace(staged, target)
                else:
                    if fs.get_file_info(target).type != pafs.FileType.NotFound:
                        fs.delete_file(target)
                    fs.move(staged, target)

        with ThreadPoolExecutor(MOVERS) as movers:
            for folder in (m.manifest for m in messages if m is not None and m.manifest):
                for lines in _manifest_parts(fs, f"{folder}/manifest"):
                    last = {target: n for n, target in lines}  # one of equal targets
                    for target in last:
                        place = f"{base}/{target}".rsplit("/", 1)[0]
                        if place not in made:
                            fs.create_dir(place, recursive=True)
                            made.add(place)
                    moves = [(f"{folder}/{n}", f"{base}/{target}") for target, n in last.items()]
                    list(movers.map(move, (moves[i::MOVERS] for i in range(MOVERS))))
        self._drop(fs, base)

    def abort(self, messages: list) -> None:
        fs, base, _ = filesystem(self.root)
        self._drop(fs, base)

    def _drop(self, fs: pafs.FileSystem, base: str) -> None:
        staging = f"{base}/{self.run}"
        for _ in range(TRIES):  # a task that is being killed may still add a file
            if fs.get_file_info(staging).type != pafs.FileType.Directory:
                return
            try:
                fs.delete_dir(staging)
            except OSError:
                time.sleep(0.2)


def _manifest_parts(fs: pafs.FileSystem, path: str) -> Iterator[list[list[str]]]:
    """``[number, target]`` of a manifest's lines, ``MOVES`` at a time: however
    many files a task wrote, the driver holds few of their names."""
    with fs.open_input_stream(path) as read, io.TextIOWrapper(io.BufferedReader(read, BLOCK), "utf-8", newline="\n") as lines:
        while part := [line.rstrip("\n").split("\t", 1) for line in islice(lines, MOVES)]:
            yield part


def below(root: str, path: Column) -> Column:
    """``path`` relative to ``root``; an error if it lies elsewhere."""
    top = same_path(root).rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, len(top) + 1, 1 << 30)).otherwise(F.raise_error(F.concat(F.lit(f"not below {top}: "), path)))


def write_files(rows: DataFrame, root: str, target: Column, source: Column | None = None, content: Column | None = None) -> None:
    """Write a set of files below ``root``: copies of ``source``, or files of
    ``content``. Rows without a target, or without both, are an error or nothing."""
    rows.sparkSession.dataSource.register(FileSet)
    nothing = F.lit(None)
    given = rows.select(target.alias("target"), (nothing if source is None else source).cast("string").alias("source"), (nothing if content is None else content).cast("binary").alias("content"))
    given.where("source IS NOT NULL OR content IS NOT NULL").write.format("file_set").mode("append").option("path", root).save()
