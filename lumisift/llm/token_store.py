"""Token-id files in Simple-8b: word-aligned coding with selectors.

A 64-bit word holds a 4-bit selector and 60 bits of equally wide ids. Selector
0 is an escape: the next word is one id of up to 64 bits. Ids are coded in
blocks of ``BLOCK`` ids, each a whole number of words; a file ends with the
word offset of every block, the documents' ids and lengths, and a trailer, so
blocks decode independently and in vectors.

Layout, little-endian: 8 bytes magic; words; block word offsets (u64, one more
than blocks); doc ids (i64); doc id validity (u8); doc lengths (u64); trailer
of three u64 (ids, blocks, docs) and the magic again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, cut, filesystem, fresh_path, plan_bytes, shuffle_partitions
from .tokens import END_ID, VOCABULARY, encoder

MAGIC = b"LSS8B001"
BLOCK = 1024
#: Blocks coded or decoded at once.
GROUP = 512
#: Bytes of input, as the plan estimates them, that make one file at most.
FILE_BYTES = 256 << 20
# Ids per word and bits per id of the selectors; 0 is the escape.
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
_COUNT = np.array(COUNTS + (0,), dtype=np.int64)
_WIDTH = np.array([x.bit_length() for x in range(1 << 17)], dtype=np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    if not len(values) or int(values.max()) < len(_WIDTH):
        return _WIDTH[values]
    return np.searchsorted(np.array([1 << b for b in range(64)], dtype=np.uint64), values, side="right").astype(np.uint8)


def _selectors(width: np.ndarray) -> np.ndarray:
    """The selector that a word beginning at each place of a block would take:
    the one with most ids that all fit. Works on rows of blocks."""
    rows, n = width.shape
    padded = np.full((rows, n + 64), 255, dtype=np.uint8)
    padded[:, :n] = width
    widest = {1: padded}  # greatest width among 1, 2, 4, ... ids from each place
    for k in (1, 2, 4, 8, 16):
        wider = np.full_like(padded, 255)
        np.maximum(widest[k][:, :-k], widest[k][:, k:], out=wider[:, :-k])
        widest[2 * k] = wider
    best = np.where(width <= 60, np.uint8(14), np.uint8(0))
    for s in range(13, 0, -1):
        count = COUNTS[s]
        half = 1 << (count - 1).bit_length() - 1  # two overlapping spans make one of any length
        fits = np.maximum(widest[half][:, :n], widest[half][:, count - half:count - half + n]) <= BITS[s]
        best[fits] = s
    return best


def encode_blocks(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``values`` (u64) in blocks of ``block``, and words per block.
    Only the last block may be partial."""
    n = len(values)
    rows = -(-n // block)
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = np.full(rows * block, 255, dtype=np.uint8)
    width[:n] = _widths(values)
    best = _selectors(width.reshape(rows, block))
    size = np.full(rows, block, dtype=np.int64)
    size[-1] = n - (rows - 1) * block
    # all blocks step from word to word together
    at, live, flat = np.zeros(rows, np.int64), np.arange(rows), best.reshape(-1)
    whose, starts, kinds = [], [], []
    while len(live):
        start = live * block + at[live]
        kind = flat[start]
        whose.append(live)
        starts.append(start)
        kinds.append(kind)
        at[live] += _COUNT[kind]
        live = live[at[live] < size[live]]
    whose, starts, kinds = np.concatenate(whose), np.concatenate(starts), np.concatenate(kinds)
    order = np.argsort(starts, kind="stable")
    whose, starts, kinds = whose[order], starts[order], kinds[order]
    wide = kinds == 0
    place = np.arange(len(kinds)) + np.concatenate([[0], np.cumsum(wide)[:-1]])
    words = np.zeros(len(kinds) + int(wide.sum()), dtype=np.uint64)
    for s in np.unique(kinds):
        mine = kinds == s
        first = starts[mine]
        if s == 0:
            words[place[mine] + 1] = values[first]
            continue
        word = np.full(len(first), int(s) << 60, dtype=np.uint64)
        for k in range(COUNTS[s]):
            word |= values[first + k] << np.uint64(BITS[s] * k)
        words[place[mine]] = word
    return words, np.bincount(whose, minlength=rows) + np.bincount(whose[wide], minlength=rows)


def decode_words(words: np.ndarray) -> np.ndarray:
    """The ids (u64) of whole blocks."""
    kinds = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), dtype=bool)
    if (kinds == 0).any():  # a word after an escape is no selector word
        i = 0
        zeros = np.flatnonzero(kinds == 0)
        for z in zeros:
            if z >= i:
                raw[z + 1] = True
                i = z + 2
    counts = np.where(raw, 0, _COUNT[kinds])
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(first[-1], dtype=np.uint64)
    for s in np.unique(kinds[~raw]):
        mine = np.flatnonzero((kinds == s) & ~raw)
        if s == 0:
            out[first[mine]] = words[mine + 1]
            continue
        mask = np.uint64((1 << BITS[s]) - 1)
        for k in range(COUNTS[s]):
            out[first[mine] + k] = (words[mine] >> np.uint64(BITS[s] * k)) & mask
    return out


class Writer:
    """Streams documents' ids into one file."""

    def __init__(self, out, block: int = BLOCK):
        self.out, self.block = out, block
        self.held: list[np.ndarray] = []
        self.n_held = self.n = self.words = 0
        self.offsets, self.ids, self.valid, self.lengths = [np.zeros(1, np.uint64)], [], [], []
        out.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents in turn: the ids of all, and how many are whose."""
        self.ids.append(np.array([i or 0 for i in doc_ids], dtype="<i8"))
        self.valid.append(np.array([i is not None for i in doc_ids], dtype="u1"))
        self.lengths.append(lengths.astype("<u8"))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= GROUP * self.block:
            self._flush(self.n_held // self.block * self.block)

    def _flush(self, n: int) -> None:
        data = np.concatenate(self.held)
        for at in range(0, n, GROUP * self.block):
            words, counts = encode_blocks(data[at:min(n, at + GROUP * self.block)].astype(np.uint64), self.block)
            self.out.write(words.astype("<u8").tobytes())
            self.offsets.append(self.words + np.cumsum(counts).astype(np.uint64))
            self.words += len(words)
        self.n += n
        self.held, self.n_held = [data[n:].copy()], self.n_held - n

    def close(self) -> tuple[int, int]:
        if self.n_held:
            self._flush(self.n_held)
        offsets = np.concatenate(self.offsets).astype("<u8")
        docs = sum(map(len, self.lengths))
        for column in ([offsets], self.ids, self.valid, self.lengths, [np.array([self.n, len(offsets) - 1, docs], dtype="<u8")]):
            for part in column:
                self.out.write(part.tobytes())
        self.out.write(MAGIC)
        return docs, self.n


class Reader:
    """Random access to the blocks of one file (opened with seek and size)."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 32)
        tail = source.read(32)
        source.seek(0)
        if tail[24:] != MAGIC or source.read(8) != MAGIC:
            raise ValueError("not a token file, or cut short")
        self.n, self.blocks, self.docs = (int(x) for x in np.frombuffer(tail[:24], "<u8"))
        source.seek(size - 32 - 8 * (self.blocks + 1) - 17 * self.docs)
        self.offsets = np.frombuffer(source.read(8 * (self.blocks + 1)), "<u8").astype(np.int64)
        ids = np.frombuffer(source.read(8 * self.docs), "<i8")
        valid = np.frombuffer(source.read(self.docs), "u1")
        self.doc_ids = [int(i) if v else None for i, v in zip(ids, valid)]
        self.lengths = np.frombuffer(source.read(8 * self.docs), "<u8").astype(np.int64)

    def read_blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks ``first`` to ``last - 1``."""
        a, b = self.offsets[first], self.offsets[last]
        self.source.seek(int(8 + 8 * a))
        return decode_words(np.frombuffer(self.source.read(int(8 * (b - a))), "<u8").astype(np.uint64))

    def documents(self):
        """``(doc_id, n_tokens, crc32)`` of every document, in file order."""
        doc, left, crc = 0, None, 0
        for first in range(0, self.blocks, GROUP):
            data = self.read_blocks(first, min(self.blocks, first + GROUP)).astype("<u4")
            at = 0
            while doc < self.docs:
                left = int(self.lengths[doc]) if left is None else left
                take = min(left, len(data) - at)
                crc = zlib.crc32(data[at:at + take].tobytes(), crc)
                at, left = at + take, left - take
                if left:
                    break
                yield self.doc_ids[doc], int(self.lengths[doc]), crc
                doc, left, crc = doc + 1, None, 0


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Write all documents' ids, each with its end id, in ascending id order
    over the files; returns ``(seq, part, docs, tokens)``, one row per file."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # a hash parts rows that share an id, null ids among them
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    parts = max(shuffle_partitions(spark), plan_bytes(rows) // FILE_BYTES)
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())

    def run(batches):
        fs, base = filesystem(folder)
        task, tokens, writer = TaskContext.get(), encoder(vocabulary), None
        seq = task.partitionId()
        name, temp = f"{base}/part-{seq:06d}.s8b", f"{base}/_{seq:06d}-{task.taskAttemptId()}"
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, ids, lengths in tokens.encode_column(batch.column(1), END_ID):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    writer = Writer(fs.open_output_stream(temp, compression=None))
                writer.add(doc_ids[at:at + len(lengths)], ids, lengths)
        if writer is not None:
            n_docs, n = writer.close()
            writer.out.close()
            fs.move(temp, name)
            yield pa.RecordBatch.from_pydict({"seq": pa.array([seq], pa.int32()), "part": [name], "docs": [n_docs], "tokens": [n]})

    return cut(rows.mapInArrow(run, "seq int, part string, docs long, tokens long"))


def read_tokens(parts: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32."""
    before = W.orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    # one row per file: as many as there were partitions
    starts = parts.select("seq", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    placed = parts.join(F.broadcast(starts), "seq").select("part", "start")

    def run(batches):
        fs, _ = filesystem(folder)
        for batch in batches:
            for part, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                with fs.open_input_file(part) as source:
                    for doc_id, n, crc in Reader(source, source.size()).documents():
                        out.append((doc_id, start, n, crc))
                        start += n
                        if len(out) == 50_000:
                            yield _batch(out)
                            out = []
                yield _batch(out)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def store_documents(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write ``docs`` as token files, read the files back, and return per
    document doc_id, start, n_tokens (with the end id) and ids_crc32.

    A null or empty text has its end id alone; null ids come first; rows with
    equal ids follow each other in the order of their texts' hashes, equal rows
    each by itself. A very long text is coded whole, block by block. Extra
    columns are ignored. An empty table writes no file and gives an empty
    result.
    """
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, vocabulary=vocabulary), folder)
