"""Packing token pieces into fixed-length sequences by bounded-space best-fit.

Each packer keeps a fixed number of open bins in lists by free space, with a
bitset of the free spaces in use: the tightest bin that fits is the lowest set
bit at or above a piece's length. If all bins are open and none fits, the
fullest closes. A packer places its pieces one by one as they come, but they
are sorted from long to short first, so its result depends on its rows alone
and is a best-fit decreasing one as long as no bin has to close.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, tidy
from .tokens import END_ID, VOCABULARY, encoder

LENGTH = 1024
OPEN_BINS = 16_384
#: Documents whose short pieces share one packer.
PACKER_DOCS = 50_000
#: Words that a worker remembers the ids of.
PACK_MEMO = 80_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, length: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: full ones, the first may be shorter."""
    if n <= length:
        return [n]
    head = n % length
    return [head] * bool(head) + [length] * (n // length)


class BestFit:
    """Bounded-space online best-fit. ``place`` returns ``(bin, offset)``."""

    def __init__(self, capacity: int = LENGTH, most: int = OPEN_BINS):
        self.capacity, self.most = capacity, most
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free = 0  # bit f is set if an open bin has f free places
        self.open = self.made = 0

    def _take(self, f: int) -> int:
        bins = self.by_free[f]
        got = bins.pop()
        if not bins:
            self.free &= ~(1 << f)
        return got

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            got = self._take(f)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
            f, got = self.capacity, self.made
            self.made += 1
            self.open += 1
        left = f - length
        if left:
            self.by_free[left].append(got)
            self.free |= 1 << left
        else:
            self.open -= 1
        return got, self.capacity - f


def token_pieces(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``length`` ids of every document with its end id; with
    ``with_ids`` also their ids as little-endian unsigned 32-bit integers."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def run(batches):
        tokens = encoder(vocabulary, PACK_MEMO)
        for batch in batches:
            rows, doc_ids = [], batch.column(0).to_pylist()
            for first, ids, lengths in tokens.encode_column(batch.column(1), END_ID):
                data, at = memoryview(ids.astype("<u4").tobytes()), 0
                for doc_id, size in zip(doc_ids[first:], lengths.tolist()):
                    start = 0
                    for i, n in enumerate(cut_lengths(size, length)):
                        part = data[4 * (at + start):4 * (at + start + n)]
                        rows.append((doc_id, i, start, n, zlib.crc32(part), bytes(part) if with_ids else None)[: len(schema)])
                        start += n
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), PIECES + ", ids binary" * with_ids)


def pack(pieces: DataFrame, packers: int, length: int = LENGTH, most: int = OPEN_BINS) -> DataFrame:
    """``pieces`` with sequence_id and offset. Full pieces fill a sequence of
    their own; the others are dealt to ``packers`` in equal numbers."""
    full = pieces.where(F.col("length") == length).select("*", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.where(F.col("length") < length).repartition(packers).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")

    def run(batches):
        fit, base = BestFit(length, most), TaskContext.get().partitionId() << 33
        for batch in batches:
            placed = [fit.place(n) for n in batch.column("length").to_pylist()]
            ids = pa.array([2 * (base + b) + 1 for b, _ in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array([o for _, o in placed], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"{c} {t}" for c, t in full.dtypes)
    return full.unionByName(short.mapInArrow(tidy(run), fields))


def pack_documents(docs: DataFrame, length: int = LENGTH, most: int = OPEN_BINS, packer_docs: int = PACKER_DOCS, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text has its end id alone. A very long text is cut whole,
    into as many pieces as it takes. Repeated rows, ties and null ids are
    packed like others, each row by itself. Extra columns are ignored; an
    empty table gives an empty result. A sequence's pieces lie at gapless
    offsets from 0 and never exceed ``length`` ids.
    """
    pieces = cut(token_pieces(docs, length, vocabulary=vocabulary, with_ids=with_ids))
    packers = -(-docs.count() // packer_docs) or 1
    return pack(pieces, packers, length, most)
