"""Incremental ingest: new files of a folder, recomputing touched albums.

Grouping needs a whole album, so a stream cannot group by itself: every batch
is appended to a table partitioned by album, and the albums it touched are
curated again from that table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """A stream of the files below ``folder`` (names that begin with ``_`` or
    ``.`` must be linked to neutral names first)."""
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(folder)


def curate_stream(measured: DataFrame, store: str, log: str, checkpoint: str, curate: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Run ``curate`` on the albums that each batch of ``measured`` (with a
    ``folder`` column) touches, overwriting their part of ``log``.

    A batch is written under its number, so that replaying it after a failure
    stores nothing twice.
    """
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch_id", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "folder").parquet(store)
        touched = batch.select("folder").distinct()
        schema = StructType(list(batch.schema.fields)).add("batch_id", LongType())  # a folder named in digits stays text
        albums = spark.read.schema(schema).option("basePath", store).parquet(store).drop("batch_id").join(touched, "folder", "left_semi")
        curate(albums).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(log)

    return measured.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
