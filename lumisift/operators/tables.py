"""Tables in the folder that driver and executors share, and dense places."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Without one a temporary folder
    serves a local master; on a cluster executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="lumisift-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: what
    follows reads it instead of computing it anew."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_place(rows: DataFrame, by: list[str], out: str) -> DataFrame:
    """Adds a dense place (from 0) in the order of ``by`` without one global
    task: rows are dealt out by range and numbered within partitions, and a
    count per partition gives the offsets. The dealt rows are stored, as the
    ranges come from a sample. Names that share a long beginning spread like
    others; equal rows lie in one range and are numbered in any order."""
    spark = rows.sparkSession
    order = [F.col(c).asc_nulls_first() for c in by]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = stored(dealt.select("*", F.spark_partition_id().alias("part_"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos_")), "placed")
    counts = dealt.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    # a row per partition of the exchange above
    before = counts.select("part_", (F.sum("n_").over(W.orderBy("part_")) - F.col("n_")).alias("before_"))
    return dealt.join(F.broadcast(before), "part_").withColumn(out, F.col("before_") + F.col("pos_")).drop("part_", "pos_", "before_")
