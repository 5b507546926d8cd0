"""Similar frames: a bucketed band self-join and connected components."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CurationConfig
from ..functions import text, vectors
from .metric import metric_pairs
from .tables import shared_folder, stored


@dataclass(frozen=True)
class Limits:
    """When two gated frames count as similar; all limits are inclusive."""

    window: int
    cosine: float
    color: float | None = None
    hash: int | None = None


def strict_limits(c: CurationConfig) -> Limits:
    return Limits(c.group_window, c.group_cosine, c.group_color, c.group_hash)


def family_limits(c: CurationConfig) -> Limits:
    return Limits(c.family_window, c.family_cosine, c.family_color, c.family_hash)


def with_sequence(photos: DataFrame, name: str = "filename") -> DataFrame:
    """Adds ord (place in its folder by path), prefix and idx of the name.

    Only folders and paths are sorted; the rest of a photo meets its place in a
    join, so an album's vectors are never in one task. A path is one file of
    its folder. ``photos`` is read twice and had better be stored."""
    s = text.stem(F.col(name))
    places = photos.select(F.col("folder").alias("f_"), F.col("path").alias("p_"))
    places = places.withColumn("ord", F.row_number().over(W.partitionBy("f_").orderBy("p_")))
    placed = photos.join(places, (F.col("folder") == F.col("f_")) & (F.col("path") == F.col("p_"))).drop("f_", "p_")
    return placed.withColumns({"prefix": text.sequence_prefix(s), "idx": text.sequence_index(s)})


def band_pairs(rows: DataFrame, keys: list[str], order: str, index: str, window: int, carry: list[str] = ()) -> DataFrame:
    """Pairs ``a_*``, ``b_*`` of rows with equal ``keys``, ``a.order <
    b.order`` and indexes at most ``window`` apart.

    Indexes are cut into buckets of ``window`` + 1. Of a pair the row with the
    higher index comes to the other's bucket or the next, so one side is
    repeated once; rows of a key meet only near each other, and as the bucket
    is part of the join key, the key itself need not spread.
    """
    columns = list(dict.fromkeys([*keys, order, index, *carry]))
    known = rows.where(F.col(index).isNotNull())
    bucket = F.floor(F.col(index) / (window + 1))
    low = known.select(*[F.col(c).alias("l_" + c) for c in columns], bucket.alias("l_bucket"))
    high = known.select(*[F.col(c).alias("h_" + c) for c in columns], F.explode(F.array(bucket - 1, bucket)).alias("h_bucket"))
    gap = F.col("h_" + index) - F.col("l_" + index)
    cond = (F.col("l_bucket") == F.col("h_bucket")) & (gap <= window) & ((gap > 0) | ((gap == 0) & (F.col("l_" + order) < F.col("h_" + order))))
    for k in keys:
        cond = (F.col("l_" + k) == F.col("h_" + k)) & cond
    pairs = low.join(high, cond)
    first = F.col("l_" + order) < F.col("h_" + order)
    sides = [(F.when(first, F.col("l_" + c)).otherwise(F.col("h_" + c)).alias("a_" + c), F.when(first, F.col("h_" + c)).otherwise(F.col("l_" + c)).alias("b_" + c)) for c in columns]
    return pairs.where(F.col("l_" + order) != F.col("h_" + order)).select(*[x[0] for x in sides], *[x[1] for x in sides])


#: Frames of one side of a tile, when all pairs of a folder are candidates.
TILE = 256


def tile_pairs(rows: DataFrame, key: str, order: str, carry: list[str] = ()) -> DataFrame:
    """All pairs ``a_*``, ``b_*`` of rows with equal ``key`` and ``a.order <
    b.order``, in tiles of ``TILE`` by ``TILE``: a large folder is dealt out
    over as many tasks as it has tiles. ``order`` is dense from 1."""
    columns = list(dict.fromkeys([key, order, *carry]))
    tile = F.floor((F.col(order) - 1) / TILE)
    tiles = rows.groupBy(key).agg(F.max(tile).alias("last_"))
    rows = rows.join(tiles, key).withColumn("tile_", tile)
    a = rows.select(*[F.col(c).alias("a_" + c) for c in columns], F.col("tile_").alias("a_row"), F.explode(F.sequence("tile_", "last_")).alias("a_col"))
    b = rows.select(*[F.col(c).alias("b_" + c) for c in columns], F.explode(F.sequence(F.lit(0).cast("long"), F.col("tile_"))).alias("b_row"), F.col("tile_").alias("b_col"))
    same = (F.col("a_" + key) == F.col("b_" + key)) & (F.col("a_row") == F.col("b_row")) & (F.col("a_col") == F.col("b_col"))
    return a.join(b, same & (F.col("a_" + order) < F.col("b_" + order))).drop("a_row", "a_col", "b_row", "b_col")


def similar(limits: Limits) -> Column:
    """The visual test of a pair, cheapest part first."""
    parts = []
    if limits.hash is not None:
        parts.append(vectors.packed_hamming(F.col("a_hash"), F.col("b_hash")) <= limits.hash)
    if limits.color is not None:
        parts.append(vectors.mean_abs_distance(F.col("a_color_thumb"), F.col("b_color_thumb")) <= limits.color)
    parts.append(vectors.cosine(F.col("a_img_vector"), F.col("b_img_vector")) >= limits.cosine)
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _hash_near(limits: list[Limits]) -> Column:
    """Whether a pair's indexes and hashes allow an edge under any limits."""
    far, gap = vectors.packed_hamming(F.col("a_hash"), F.col("b_hash")), F.abs(F.col("a_idx") - F.col("b_idx"))
    out = F.lit(False)
    for x in limits:
        out = out | ((far <= x.hash) & (gap <= x.window))
    return out


def _fetched(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with the ``columns`` of both their rows."""
    out = pairs
    for side in "ab":
        found = rows.select(F.col("folder").alias("f_"), F.col("ord").alias("o_"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        out = out.join(found, (F.col("a_folder") == F.col("f_")) & (F.col(f"{side}_ord") == F.col("o_"))).drop("f_", "o_")
    return out


def similarity_edges(candidates: DataFrame, limits: list[Limits], gate: bool = True, keep: list[str] = ()) -> DataFrame:
    """``folder, prefix, a, b`` and ``edge_0``, ``edge_1``, ... per limits: pairs
    are made once, at the widest window, and tested for all limits together.
    Both frames' columns ``keep`` come with the pair as ``a_*`` and ``b_*``, which
    spares a join of the edges.

    If every limit has a hash, pairs are made of names, indexes and hashes
    alone; vectors are fetched for those whose hashes are near enough.

    Without the sequence gate every pair of a folder is a candidate. Those that
    the least cosine rules out by angle are not made (``metric_pairs``); only if
    a limit admits any angle of 90 degrees or more are all made, in tiles.
    """
    visual = ["img_vector", *(["color_thumb"] if any(x.color is not None for x in limits) else [])]
    carry = [*visual, *(["hash"] if any(x.hash is not None for x in limits) else []), *keep]
    if gate and all(x.hash is not None for x in limits):
        near = band_pairs(candidates, ["folder", "prefix"], "ord", "idx", max(x.window for x in limits), ["hash", *keep])
        pairs = _fetched(near.where(_hash_near(limits)), candidates, visual)
    elif gate:
        pairs = band_pairs(candidates, ["folder", "prefix"], "ord", "idx", max(x.window for x in limits), carry)
    else:
        flat = candidates.withColumns({"prefix": F.lit(""), "idx": F.lit(0)})
        least = min(x.cosine for x in limits)
        pairs = metric_pairs(flat, "folder", "ord", "img_vector", least, ["prefix", "idx", *carry]) if least > 0 else tile_pairs(flat, "folder", "ord", ["prefix", "idx", *carry])
    gap = F.abs(F.col("a_idx") - F.col("b_idx"))
    tests = [(similar(x) & (gap <= x.window) if gate else similar(x)).alias(f"edge_{i}") for i, x in enumerate(limits)]
    return pairs.select(F.col("a_folder").alias("folder"), F.col("a_prefix").alias("prefix"), F.col("a_ord").alias("a"), F.col("b_ord").alias("b"), *[f"{side}_{c}" for side in "ab" for c in keep], *tests)


def _union_find(edges: pd.DataFrame) -> pd.DataFrame:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(edges["a"], edges["b"]):
        ra, rb = find(int(a)), find(int(b))
        parent[max(ra, rb)] = min(ra, rb)
    rows = [(x, find(x)) for x in parent]
    first = edges.iloc[0]
    return pd.DataFrame({"folder": first["folder"], "prefix": first["prefix"], "ord": [r[0] for r in rows], "root": [r[1] for r in rows]})


#: Edges of one component partition that a single union-find task may hold.
LOCAL_EDGES = 2_000_000


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``folder, prefix, ord, root`` of every frame that has an edge; root is
    the smallest frame that can be reached.

    With the gate on no edge leaves its folder and prefix, so a task per such
    key is exact and needs one exchange; keys with more edges than a task
    should hold go through repeated minimum-label rounds instead. ``edges`` is
    read twice, so it had better be stored.
    """
    e = edges.select("folder", "prefix", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    sized = e.groupBy("folder", "prefix").agg(F.count(F.lit(1)).alias("n"))
    big = sized.where(F.col("n") > local_edges).select("folder", "prefix")
    schema = "folder string, prefix string, ord long, root long"
    if not big.take(1):
        return e.groupBy("folder", "prefix").applyInPandas(_union_find, schema)
    small = e.join(big, ["folder", "prefix"], "left_anti").groupBy("folder", "prefix").applyInPandas(_union_find, schema)
    return small.unionByName(label_rounds(e.join(big, ["folder", "prefix"], "left_semi")))


def label_rounds(edges: DataFrame) -> DataFrame:
    """Components by rounds of minimum labels with pointer jumping; every round
    is cut with a reliable checkpoint."""
    shared_folder(edges.sparkSession)
    key = ["folder", "prefix"]
    both = edges.unionByName(edges.select(*key, F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(*key, "a").agg(F.min("b").alias("m")).select(*key, F.col("a").alias("ord"), F.least("a", "m").alias("root")).checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("ord", "b"), [*key, "b"]).groupBy(*key, F.col("a").alias("ord")).agg(F.min("root").alias("near"))
        hop = labels.select(*key, F.col("ord").alias("near"), F.col("root").alias("far"))
        after = labels.join(near, [*key, "ord"]).withColumn("near", F.least("root", "near")).join(hop, [*key, "near"], "left").select(*key, "ord", F.least("near", "far").alias("root"), "near")
        after = after.select(*key, "ord", "root").checkpoint()
        if after.join(labels.withColumnRenamed("root", "old"), [*key, "ord"]).where("root <> old").isEmpty():
            return after
        labels = after


def group_numbers(places: DataFrame, roots: DataFrame, group: str, size: str) -> DataFrame:
    """``folder, ord`` of ``places`` with group numbers from 1 per folder, in the
    order of their first frames, and group sizes; frames without an edge stand
    alone. Rows are a few numbers each, also where an album is one window."""
    r = roots.select("folder", "ord", "root")
    placed = places.select("folder", "ord").join(r, ["folder", "ord"], "left").withColumn("root", F.coalesce("root", "ord"))
    groups = placed.groupBy("folder", "root").agg(F.count(F.lit(1)).alias(size))
    groups = groups.withColumn(group, F.row_number().over(W.partitionBy("folder").orderBy("root")))
    return placed.join(groups, ["folder", "root"]).select("folder", "ord", group, size)


def numbered_groups(frames: DataFrame, roots: DataFrame, group: str, size: str) -> DataFrame:
    """``frames`` with the numbers and sizes of their groups."""
    return frames.join(group_numbers(frames, roots, group, size), ["folder", "ord"])


def linked(candidates: DataFrame, limits: list[Limits], gate: bool = True) -> DataFrame:
    """``similarity_edges`` that hold under any of the limits, made once and
    stored: frame numbers and flags, no vectors."""
    edges = similarity_edges(candidates, limits, gate)
    any_ = F.greatest(*[F.col(f"edge_{i}") for i in range(len(limits))]) if len(limits) > 1 else F.col("edge_0")
    return stored(edges.where(any_), "edges")


def grouped(candidates: DataFrame, c: CurationConfig) -> DataFrame:
    """Strict groups and scene families of all candidates, rejected ones
    included: they are vertices too and may link two good frames."""
    edges = linked(candidates, [strict_limits(c), family_limits(c)], c.sequence_gate)
    strict = group_numbers(candidates, components(edges.where("edge_0")), "group_id", "group_size")
    family = group_numbers(candidates, components(edges.where("edge_1")), "scene_family_id", "scene_family_size")
    return candidates.join(strict.join(family, ["folder", "ord"]), ["folder", "ord"])
