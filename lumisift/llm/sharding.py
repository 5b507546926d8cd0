"""Sharding by a keyed Feistel permutation of global row numbers.

Rows get dense numbers in ``(doc_id, crc, size)`` order. A balanced or
unbalanced Feistel network over the smallest power of two that holds all
numbers, walked along its cycle until it lands inside the table, permutes
them. The permuted number ``p`` gives ``shard = p mod n`` and
``slot = p div n``: both follow from a row's number alone, shard counts differ
by one row at most, and slots have no gap.

Built-in DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

ROUNDS = 6
#: Steps of a cycle walk that are laid out in the plan. The domain is under
#: twice the table, so a walk needs more with a chance under 2**-128; such a
#: row raises an error instead of getting a wrong place.
WALK = 128


def number_rows(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with a dense global ``row_number`` (from 0) by ``keys``, and
    their count.

    Rows are dealt out by range and sorted within partitions; the lineage is
    cut there, so that sampled range bounds are fixed once. Offsets come from
    one count per partition.
    """
    spark = rows.sparkSession
    order = [F.col(k).asc_nulls_first() for k in keys]
    placed = cut(
        rows.repartitionByRange(shuffle_partitions(spark), *order)
        .sortWithinPartitions(*order)
        .select(
            "*",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
        )
    )
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    # one row per partition of the exchange above: bounded by its partition count
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn("row_number", F.col("_off") + F.col("_pos"))
    return numbered.drop("_part", "_pos", "_off"), total


def feistel(number: Column, n: int, seed: int) -> Column:
    """A keyed permutation of ``0 .. n-1``."""
    if n <= 1:
        return F.lit(0).cast("long")
    bits = max(2, (n - 1).bit_length())
    low, high = bits // 2, bits - bits // 2
    # the halves swap their widths each round; an even count of rounds restores them
    rounds = F.array(*[
        F.struct(F.lit(seed * ROUNDS + r).cast("long").alias("key"), F.lit((1 << (high if r % 2 == 0 else low)) - 1).cast("long").alias("mask"))
        for r in range(ROUNDS)
    ])

    def once(x: Column) -> Column:
        halves = F.struct(F.shiftright(x, low).alias("l"), x.bitwiseAND(F.lit((1 << low) - 1).cast("long")).alias("r"))
        return F.aggregate(
            rounds, halves,
            lambda h, k: F.struct(h["r"].alias("l"), h["l"].bitwiseXOR(F.xxhash64(h["r"], k["key"]).bitwiseAND(k["mask"])).alias("r")),
            lambda h: F.shiftleft(h["l"], low).bitwiseOR(h["r"]),
        )

    walked = F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), once(number), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    # bound to a name by a one-element transform, so that it is computed once
    return F.transform(F.array(walked), lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long")))[0]


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 20240501, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every document in one of ``n_shards`` shards.

    Returns doc_id, size (UTF-8 bytes plus 16), text_crc32, row_number, law
    (``rows``), shard, slot and grown_shard (null: this law promises nothing
    for one more shard). A null or empty text counts as no bytes, a very long one
    as all of its bytes; null ids come first; ties go by the text's checksum
    and size, and repeated rows are placed one by one; other columns are not
    looked at. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    numbered, total = number_rows(rows, ["doc_id", "text_crc32", "size"])
    placed = numbered.withColumn("p", feistel(F.col("row_number").cast("long"), total, seed))
    return placed.select(
        "doc_id", "size", "text_crc32", "row_number",
        F.lit("rows").alias("law"),
        (F.col("p") % n_shards).cast("int").alias("shard"),
        F.expr(f"p div {n_shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
