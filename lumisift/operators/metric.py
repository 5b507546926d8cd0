"""Exact similarity join of unit vectors by pivots and angles.

Angles between vectors are a metric. A vector lives in the cell of its nearest
pivot; a partner within ``t`` of it is at most ``2 t`` farther from that cell's
pivot than from its own nearest one, so only such cells are visited, and there
only the rings whose angles to the pivot differ by ``t`` or less. What the
triangle inequality rules out is never paired. Cells and rings that are crowded
are cut into tiles of bounded size, dealt to as many tasks. A tile is one product
of two matrices; only pairs that can reach the limit leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from .tables import stored

#: Pivots of a key, rows of one side of a tile, and angle (radians) that rounding may cost.
PIVOTS, TILE, SLACK = 32, 2048, 1e-6
#: Bytes of pairs that leave a tile together.
PIECE = 4 << 20


def _angle(v: Column, norm: Column, p: Column) -> Column:
    cos = vectors.dot(v, p["v"]) / (norm * p["norm"])
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))


def widest_angle(limit: float, longest: float) -> float:
    """The widest angle at which vectors of a norm up to ``longest`` can have an
    inner product of ``limit`` > 0; negative if none can."""
    cos = limit / longest**2 if longest else math.inf
    return math.acos(cos) if cos <= 1 else math.acos(1.0) if cos <= 1 + 1e-9 else -1.0


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """A row per vector; shorter ones end in zeros."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None] < sizes[:, None]] = flat
    return out


def tile_product(rows: pa.Table, columns: list[str], order: str, vector: str, limit: float, longest: float) -> Iterator[pa.RecordBatch]:
    """Pairs ``l_*``, ``v_*`` of a living and a visiting row of one tile whose
    inner product may be ``limit`` or more: what rounding of vectors of a norm up
    to ``longest`` may cost is let through. ``PIECE`` bytes or one pair at a time."""
    lives = rows.column("lives").to_numpy()
    sides = []
    for mine in (lives, ~lives):
        some = rows.filter(pa.array(mine))
        sides.append({c: pa.concat_arrays(chunks) if (chunks := some.column(c).chunks) else pa.array([], some.schema.field(c).type) for c in ["home_", "cell", *("r_" + x for x in columns)]})
    left, right = sides
    if not len(left["cell"]) or not len(right["cell"]):
        return
    x, y = _matrix(left["r_" + vector]), _matrix(right["r_" + vector])
    width = min(x.shape[1], y.shape[1])
    least = limit - 1e-14 * (width + 1) * longest**2
    step = max(1, PIECE // max(1, 2 * rows.nbytes // rows.num_rows))
    names = [side + c for side in ("l_", "v_") for c in columns]
    block = max(1, PIECE // (8 * len(y)))
    for at in range(0, len(x), block):
        i, j = np.nonzero(~(x[at:at + block, :width] @ y[:, :width].T < least))
        i += at
        for lo in range(0, len(i), step):
            p, q = pa.array(i[lo:lo + step]), pa.array(j[lo:lo + step])
            # a pair of one cell is seen from both its rows
            once = pc.or_(pc.greater(right["home_"].take(q), right["cell"].take(q)), pc.less(left["r_" + order].take(p), right["r_" + order].take(q)))
            p, q = p.filter(once), q.filter(once)
            if len(p):
                yield pa.RecordBatch.from_arrays([*(left["r_" + c].take(p) for c in columns), *(right["r_" + c].take(q) for c in columns)], names=names)


def metric_pairs(rows: DataFrame, key: str, order: str, vector: str, limit: float, carry: list[str] = (), pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """Pairs ``a_*``, ``b_*`` of rows with equal ``key`` and ``a.order <
    b.order``, among them every pair whose vectors have an inner product of
    ``limit`` or more, and each once. ``limit`` must be above 0.

    Vectors need not be of unit length; zero and empty ones are in no pair. A
    row with a null key, order or vector is in none. ``order`` is unique in its
    key.
    """
    if limit <= 0:
        raise ValueError("an inner product of zero or less is no limit of an angle")
    columns = list(dict.fromkeys([key, order, vector, *carry]))
    known = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull() & F.col(vector).isNotNull()).select(*columns, F.sqrt(vectors.dot(F.col(vector), F.col(vector))).alias("norm_")).where("norm_ > 0")
    known = stored(known, "metric")
    longest = known.agg(F.max("norm_")).first()[0] or 0.0
    theta = widest_angle(limit, longest)
    if theta < 0:
        known, theta = known.limit(0), 0.0
    theta += SLACK
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64(order), order))
    chosen = known.withColumn("n_", nth).where(F.col("n_") <= pivots)
    chosen = stored(chosen.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_", F.col(vector).alias("v"), F.col("norm_").alias("norm")))), lambda x: F.struct(x["v"].alias("v"), x["norm"].alias("norm"))).alias("pivots_")), "pivots")
    placed = known.join(chosen, key).withColumn("angles_", F.transform("pivots_", lambda p: _angle(F.col(vector), F.col("norm_"), p))).drop("pivots_", "norm_")
    home = F.array_position("angles_", F.array_min("angles_")).cast("int") - 1
    placed = stored(placed.withColumns({"home_": home, "near_": F.array_min("angles_")}), "placed")

    def ring(angle: Column) -> Column:
        return F.floor(angle / theta).cast("int")

    living = placed.select(*[F.col(c).alias("l_" + c) for c in columns], F.col("home_").alias("cell"), ring(F.col("near_")).alias("ring"))
    # a pair of two cells is made in the one of the lower number
    seen = placed.select(*[F.col(c).alias("v_" + c) for c in columns], "home_", "near_", F.posexplode(F.slice("angles_", 1, F.col("home_") + 1)).alias("cell", "angle_"))
    seen = seen.where(F.col("angle_") <= F.col("near_") + 2 * theta)
    around = F.filter(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: ring(F.col("angle_")) + d), lambda r: r >= 0)
    visiting = seen.withColumn("ring", F.explode(around)).drop("near_", "angle_")
    place = ["cell", "ring"]
    l_n = living.groupBy(F.col("l_" + key).alias("k_"), *place).agg(F.count(F.lit(1)).alias("l_n"))
    v_n = visiting.groupBy(F.col("v_" + key).alias("k_"), *place).agg(F.count(F.lit(1)).alias("v_n"))
    cuts = stored(l_n.join(v_n, ["k_", *place]).select("k_", *place, F.ceil(F.col("l_n") / tile).cast("int").alias("l_cuts"), F.ceil(F.col("v_n") / tile).cast("int").alias("v_cuts")), "cuts")

    def dealt(side: DataFrame, mine: str, other: str) -> DataFrame:
        rows = side.join(cuts.withColumnRenamed("k_", mine[0] + "_" + key), [mine[0] + "_" + key, *place])
        own = F.pmod(F.xxhash64(mine[0] + "_" + order), F.col(mine + "_cuts")).cast("int")
        return rows.select(*side.columns, own.alias(f"{mine}_cut"), F.explode(F.sequence(F.lit(0), F.col(other + "_cuts") - 1)).alias(f"{other}_cut"))

    left = dealt(living, "l", "v").select(*[F.col("l_" + c).alias("r_" + c) for c in columns], F.lit(True).alias("lives"), F.col("cell").alias("home_"), *place, "l_cut", "v_cut")
    right = dealt(visiting, "v", "l").select(*[F.col("v_" + c).alias("r_" + c) for c in columns], F.lit(False).alias("lives"), "home_", *place, "l_cut", "v_cut")
    # dealt out by number: tiles are few bytes and much work, and would be put together by size
    spread = ["r_" + key, *place, "l_cut", "v_cut"]
    rows = left.unionByName(right).repartition(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), *spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tile_product(pa.Table.from_batches(list(batches)), columns, order, vector, limit, longest)

    fields = [T.StructField(side + c, rows.schema["r_" + c].dataType) for side in ("l_", "v_") for c in columns]
    pairs = rows.groupBy(*spread).applyInArrow(run, T.StructType(fields))
    first = F.col("l_" + order) < F.col("v_" + order)
    a = [F.when(first, F.col("l_" + c)).otherwise(F.col("v_" + c)).alias("a_" + c) for c in columns]
    b = [F.when(first, F.col("v_" + c)).otherwise(F.col("l_" + c)).alias("b_" + c) for c in columns]
    return pairs.select(*a, *b)
