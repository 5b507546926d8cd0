"""Helpers shared by the training-data operators: lineage cuts, bounded Arrow
batches, size-checked broadcasts, connected components and shared storage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampType

#: Largest side, in rows, that an operator may broadcast after counting it.
BROADCAST_ROWS = 200_000
#: Largest side, in measured bytes.
BROADCAST_BYTES = 64 << 20
#: Bytes of one Arrow batch handed to a Python worker.
ARROW_BATCH_BYTES = 4 << 20


_held: dict = {}


def held(kind: str, key, make):
    """``make()``, kept in a worker process for the same ``kind`` and ``key``.
    A worker keeps the large things of one kind only: the next kind of work
    frees what the last one held."""
    if (kind, key) not in _held:
        release()
        _held[kind, key] = make()
    return _held[kind, key]


def release() -> None:
    """Free what a worker process holds, and give the memory back. Tasks that
    hold nothing call it too, as an idle worker would keep what it held."""
    if not _held:
        return
    _held.clear()
    trim()


def trim() -> None:
    """Give back what Arrow and the C library hold of freed memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """``run`` over a task's batches for ``mapInArrow``; freed memory is given
    back when it ends, as a worker that waits for another task would keep it."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only when the session names none (tests on one machine) a temporary one is
    made.
    """
    ctx = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and ctx.getCheckpointDir():
        base = ctx.getCheckpointDir()
    if not base:
        if not ctx.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lumisift-")
        ctx.setCheckpointDir(base)
    return base


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no earlier call returned."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the
    lineage, and later reads take the columns they need."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_path(df: DataFrame) -> str:
    """The folder of a table that ``stored`` returned."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, whatever the length of the texts in them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plan_bytes(df: DataFrame) -> int:
    """The size of ``df`` as the optimiser estimates it, without a job; 0 if it
    has no idea."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


def small_side(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its ``rows`` (counted here, if not given)
    are within ``bound`` and its measured bytes within ``most``."""
    if rows is not None and rows > bound:
        return df
    wide = [f.name for f in df.schema.fields if not isinstance(f.dataType, (NumericType, BooleanType, DateType, TimestampType))]
    if rows is None or wide:
        held = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in wide]
        size = sum(held, F.lit(8 * (len(df.columns) + 1)))
        rows, n = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    else:
        n = rows * 8 * (len(df.columns) + 1)
    return F.broadcast(df) if rows <= bound and n <= most else df


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a Hadoop-style URI and the path inside it."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every end of ``edges``; component is the
    smallest node that can be reached.

    Alternates the large-star and small-star steps until the edge set is a
    forest of stars. A step is one grouped minimum (combined before the
    shuffle) and one equi-join per side, so a hub is split by skew handling;
    edges never leave the executors. Null ends, self-loops and repeated edges
    are ignored; an empty table gives an empty result.
    """
    x, y = F.col(a), F.col(b)
    e = cut(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
        .distinct()
    )

    def state(t: DataFrame) -> tuple:
        return tuple(
            t.agg(
                F.count(F.lit(1)),
                F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            ).first()
        )

    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = cut(small)
        after = state(e)
        if after == before:
            break
        before = after
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


def let(value, body):
    """``body`` applied to ``value``, which is computed once however often the
    body names it."""
    return F.transform(F.array(value), body)[0]


def trimmed_split(text, breaks: str):
    """The words of ``text`` between matches of ``breaks``, none of them empty.
    Only the first and the last part of a split can be empty."""
    def inner(parts):
        n = F.size(parts)
        lead = (parts[0] == "").cast("int")
        trail = (parts[n - 1] == "").cast("int")
        return F.slice(parts, lead + 1, F.greatest(F.lit(0), n - lead - trail))

    return let(F.split(F.coalesce(text, F.lit("")), breaks), inner)

