"""Groups of similar frames that grow with a stream of files.

State is kept per folder and name prefix: the frames by bucket of their index,
and a forest of groups. A new frame is compared with the frames of its own and
the neighbouring buckets only, and its edges are merged into the forest; nothing
that was grouped before is compared again. Of two groups that a late file joins
the smaller one moves, so a frame moves a number of times that grows with the
logarithm of its group. What changed is appended to a table, from which
``current_groups`` reads the state of all groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import text
from ..operators.grouping import Limits

CHANGES = "level int, folder string, seq string, path string, root string, label string, size int"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _numbers(values, dtype) -> bytes:
    return b"" if values is None else np.asarray(values, dtype=dtype).tobytes()


class _Frame:
    __slots__ = ("path", "idx", "vector", "color", "hash")

    def __init__(self, path: str, idx: int, vector: bytes, color: bytes, hash_: int | None):
        self.path, self.idx, self.hash = path, idx, hash_
        self.vector, self.color = np.frombuffer(vector, np.float64), np.frombuffer(color, np.float64)


def close(a: _Frame, b: _Frame, limits: Limits) -> bool:
    """The visual test of a pair, as ``grouping.similar`` has it."""
    if abs(a.idx - b.idx) > limits.window:
        return False
    if limits.hash is not None and (a.hash is None or b.hash is None or ((a.hash ^ b.hash) & (2**64 - 1)).bit_count() > limits.hash):
        return False
    if limits.color is not None:
        n = min(len(a.color), len(b.color))
        if len(a.color) and np.abs(a.color[:n] - b.color[:n]).sum() / len(a.color) > limits.color:
            return False
    n = min(len(a.vector), len(b.vector))
    return float(a.vector[:n] @ b.vector[:n]) >= limits.cosine


class FrameForest(StatefulProcessor):
    """Frames and groups of one folder and prefix, for each of ``limits``."""

    def __init__(self, limits: list[Limits]):
        self.limits, self.window = limits, max(x.window for x in limits)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frames = handle.getMapState("frames", "bucket long, n int", "path string, idx long, vector binary, color binary, hash long")
        self.fill = handle.getMapState("fill", "bucket long", "n int")
        self.levels = [
            (
                handle.getMapState(f"roots{i}", "path string", "root string"), handle.getMapState(f"groups{i}", "root string", "label string, size int"),
                handle.getMapState(f"members{i}", "root string, n int", "path string"),
            )
            for i in range(len(self.limits))
        ]

    def _bucket(self, cache: dict, b: int) -> list[_Frame]:
        if b not in cache:
            found = self.fill.getValue((b,)) if self.fill.containsKey((b,)) else (0,)
            cache[b] = [_Frame(*self.frames.getValue((b, n))) for n in range(found[0])]
        return cache[b]

    def _merge(self, level: int, a: str, b: str, moved: dict, changed: dict) -> None:
        roots, groups, members = self.levels[level]
        (a,), (b,) = roots.getValue((a,)), roots.getValue((b,))
        if a == b:
            return
        big, small = groups.getValue((a,)), groups.getValue((b,))
        if (big[1], b) < (small[1], a):
            a, b, big, small = b, a, small, big
        for n in range(small[1]):
            (path,) = members.getValue((b, n))
            roots.updateValue((path,), (a,))
            members.updateValue((a, big[1] + n), (path,))
            members.removeKey((b, n))
            moved[path] = a
        groups.updateValue((a,), (min(big[0], small[0]), big[1] + small[1]))
        groups.removeKey((b,))
        changed[a], changed[b] = (min(big[0], small[0]), big[1] + small[1]), (None, 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        folder, seq = key
        cache: dict[int, list[_Frame]] = {}
        moved: list[dict] = [{} for _ in self.limits]
        changed: list[dict] = [{} for _ in self.limits]
        for frame in rows:
            for path, idx, vector, color, hash_ in zip(frame["path"], frame["idx"], frame["img_vector"], frame["color_thumb"], frame["hash"]):
                if self.levels[0][0].containsKey((path,)):
                    continue  # a file that comes again is known
                hash_ = None if hash_ is None or pd.isna(hash_) else int(hash_)
                value = (path, int(idx), _numbers(vector, np.float64), _numbers(color, np.float64), hash_)
                new, b = _Frame(*value), int(idx) // (self.window + 1)
                near = [f for i in (b - 1, b, b + 1) for f in self._bucket(cache, i)]
                self.frames.updateValue((b, len(cache[b])), value)
                cache[b].append(new)
                self.fill.updateValue((b,), (len(cache[b]),))
                for level, (roots, groups, members) in enumerate(self.levels):
                    roots.updateValue((path,), (path,))
                    groups.updateValue((path,), (path, 1))
                    members.updateValue((path, 0), (path,))
                    moved[level][path], changed[level][path] = path, (path, 1)
                    for other in near:
                        if close(new, other, self.limits[level]):
                            self._merge(level, path, other.path, moved[level], changed[level])
        out = []
        for level in range(len(self.limits)):
            out += [(level, folder, seq, path, root, None, None) for path, root in moved[level].items()]
            out += [(level, folder, seq, None, root, label, size) for root, (label, size) in changed[level].items()]
        if out:
            yield pd.DataFrame(out, columns=["level", "folder", "seq", "path", "root", "label", "size"]).astype({"level": "int32", "size": "Int32"})

    def close(self) -> None:
        pass


def group_changes(frames: DataFrame, limits: list[Limits]) -> DataFrame:
    """Changes (``CHANGES``) of groups and of their members by a stream of
    frames: folder, path, filename, img_vector, color_thumb, hash. Frames whose
    names hold no number stand alone. Null vectors are near to nothing that a
    limit above 0 admits."""
    stem = text.stem(F.col("filename"))
    seq, idx = text.sequence_prefix(stem), text.sequence_index(stem)
    numbered = idx.isNotNull()
    rows = frames.select(
        "folder", F.when(numbered, F.concat(F.lit("p"), seq)).otherwise(F.concat(F.lit("f"), "path")).alias("seq"), "path", F.coalesce(idx, F.lit(0)).cast("long").alias("idx"),
        F.col("img_vector").cast("array<double>").alias("img_vector"), F.col("color_thumb").cast("array<double>").alias("color_thumb"), F.col("hash").cast("long").alias("hash"),
    )
    return rows.groupBy("folder", "seq").transformWithStateInPandas(FrameForest(limits), CHANGES, "Update", "None")


def group_stream(frames: DataFrame, limits: list[Limits], store: str, checkpoint: str) -> StreamingQuery:
    """Append the changes of each batch to ``store`` under the batch's number,
    so that a batch that is repeated after a failure replaces itself."""
    spark = frames.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_id", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(store)

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # keyed map state needs it
    try:
        changes = group_changes(frames, limits)
        return changes.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)


def current_groups(spark: SparkSession, store: str, level: int = 0) -> DataFrame:
    """``folder, path, group_id, group_size`` as of the last batch: groups are
    numbered from 1 per folder in the order of their first files."""
    rows = spark.read.schema(CHANGES + ", batch_id long").parquet(store).where(F.col("level") == level)
    members = rows.where("path IS NOT NULL").groupBy("folder", "seq", "path").agg(F.max_by("root", "batch_id").alias("root"))
    groups = rows.where("path IS NULL").groupBy("folder", "seq", "root").agg(F.max_by(F.struct("label", "size"), "batch_id").alias("g"))
    groups = groups.where("g.size > 0").select("folder", "seq", "root", "g.label", F.col("g.size").cast("long").alias("group_size"))
    numbered = groups.withColumn("group_id", F.row_number().over(W.partitionBy("folder").orderBy("label")))  # one narrow row per group
    return members.join(numbered, ["folder", "seq", "root"]).select("folder", "path", "group_id", "group_size")
