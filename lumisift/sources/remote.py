"""A paginated remote listing as a Spark data source.

Options: ``folder_id``, ``client`` (``module:function`` that returns an object
with ``page(folder_id, token, size) -> (list of dicts, next token)`` and
``content(file_id) -> bytes``), ``page_size``, ``min_pixels``, ``content``,
``max_bytes`` (longer content is null) and, for streams, ``pages_per_batch``.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition

from ..config import CurationConfig

MAX_BYTES = CurationConfig.max_download_bytes
# Accepted kinds of files.
MIME_TYPES = frozenset({"image/jpeg", "image/png", "image/tiff", "image/bmp", "image/webp"})
#: Most tasks of a listing.
TASKS = 256
SCHEMA = "file_id string, name string, mime_type string, width int, height int, megapixels double"


def _client(spec: str):
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)()


class RemoteImages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_images"

    def schema(self) -> str:
        return SCHEMA + (", content binary" if self.options.get("content", "false") == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Reader(DataSourceReader):
    """The plan walks the pages for their tokens and keeps nothing else of them;
    tasks list their pages again, so files and bytes are held where they are
    used. A page keeps its files between both, as for streams. Limits on size
    and kind are pushed here, before any byte is read."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.least = int(self.options.get("min_pixels", 0))
        self.mime = None
        self.pixels = 0.0

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("mime_type",) and self.mime in (None, f.value):
                self.mime = f.value
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("megapixels",):
                self.pixels = max(self.pixels, float(f.value))
                yield f  # rounded here, so Spark checks again
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Tokens of pages that follow each other, with how many files each has,
        dealt into ``TASKS`` partitions at most."""
        client, token, pages = _client(self.options["client"]), None, []
        while True:
            begin = token
            files, token = self._page(client, begin)
            if any(map(self._wanted, files)):
                pages.append((begin, len(files)))
            if not token:
                step = -(-len(pages) // TASKS) or 1
                return [InputPartition(pages[i:i + step]) for i in range(0, len(pages), step)] or [InputPartition([])]

    def _page(self, client, token: str | None) -> tuple[list, str | None]:
        return client.page(self.options["folder_id"], token, int(self.options.get("page_size", 100)))

    def _wanted(self, f: dict) -> bool:
        w, h = f.get("width"), f.get("height")
        return bool(f.get("mime_type") in MIME_TYPES and w and h and w * h >= self.least and (self.mime is None or f["mime_type"] == self.mime) and round(w * h / 1e6, 2) >= self.pixels)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        client = _client(self.options["client"])
        for token, count in partition.value:
            yield from self.rows(client, self._page(client, token)[0][:count])

    def rows(self, client, files: list[dict]) -> Iterator[tuple]:
        """A row for each of ``files`` that is wanted."""
        with_content, most = self.options.get("content", "false") == "true", int(self.options.get("max_bytes", MAX_BYTES))
        for f in filter(self._wanted, files):
            row = (f["file_id"], f["name"], f["mime_type"], int(f["width"]), int(f["height"]), round(f["width"] * f["height"] / 1e6, 2))
            if with_content:
                data = client.content(f["file_id"])
                row += (data if len(data) <= most else None,)
            yield row


class _StreamReader(DataSourceStreamReader):
    """A listing that grows at its end, as a stream. An offset is a page's token
    and how many of its files were read, so any range can be read again; each
    page of a batch is a partition, listed and fetched by its task.

    The first file of a page keeps its place, as tokens do; files that are
    inserted or removed before an offset are not noticed.
    """

    def __init__(self, options: dict):
        self.batch = _Reader(options)
        self.most = int(options.get("pages_per_batch", 100))
        self.client = None
        self.at: dict | None = None

    def _page(self, token: str) -> tuple[list, str | None]:
        self.client = self.client or _client(self.batch.options["client"])
        return self.client.page(self.batch.options["folder_id"], token or None, int(self.batch.options.get("page_size", 100)))

    def initialOffset(self) -> dict:
        return {"token": "", "read": 0}

    def latestOffset(self) -> dict:
        """Up to ``pages_per_batch`` pages from where the last call came to."""
        at = self.at or self.initialOffset()
        for n in range(self.most):
            files, after = self._page(at["token"])
            at = {"token": at["token"], "read": max(at["read"], len(files))}
            if not after:
                break
            at = {"token": after, "read": 0}
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.at is None:  # after a restart Spark plans the last batch first
            self.at = end
        out, token, skip = [], start["token"], start["read"]
        while True:
            last = token == end["token"]
            if not last or end["read"] > skip:
                out.append(InputPartition((token, skip, end["read"] if last else None)))
            if last:
                return out
            after = self._page(token)[1]
            if not after:
                raise ValueError(f"the listing ends before the page {end['token']!r}")
            token, skip = after, 0

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        token, skip, stop = partition.value
        self.client = None
        files = self._page(token)[0][skip:stop]
        yield from self.batch.rows(self.client, files)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RemoteImages)
