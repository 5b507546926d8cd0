"""Registered queries over the test tables, each beside its SQL."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CurationConfig
from ..functions import image_files, lenient_json, scoring, text, vectors
from ..functions.pixels import measure
from ..operators import grouping, lookups, selection, tournament
from ..operators.grouping import Limits
from ..operators.tables import dense_place
from ..sinks import outputs
from ..sources.albums import album_filter
from . import stage1, stage2
from .stand_in import OrdinalModel

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
C = CurationConfig()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- scalar measures over lineitem rows as images

METRICS_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity * 5 AS lap, l_discount * 200 + 0.0 AS black, l_tax * 250 + 0.0 AS white, l_extendedprice / 5000 AS mp FROM lineitem"""


def metrics(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_quantity") * 5).alias("lap"), (F.col("l_discount") * 200 + F.lit(0.0)).alias("black"),
        (F.col("l_tax") * 250 + F.lit(0.0)).alias("white"), (F.col("l_extendedprice") / 5000).alias("mp"),
    )


@query(f"""SELECT tier, count(*) AS n FROM (SELECT CASE WHEN mp >= 8 THEN 'above_8mp' WHEN mp >= 1 THEN 'between_1mp_and_8mp' ELSE 'below_1mp' END AS tier FROM ({METRICS_SQL})) GROUP BY tier""")
def resolution_tier(spark, d):
    return metrics(spark, d).groupBy(scoring.resolution_tier(F.col("mp"), C).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT l_linenumber, CASE WHEN lap < 25 THEN 'blur' WHEN black > 15 THEN 'underexposed' WHEN white > 15 THEN 'overexposed' ELSE '' END AS reason, count(*) AS n FROM ({METRICS_SQL}) GROUP BY ALL""")
def first_fail_filter(spark, d):
    reason = scoring.filter_code(F.col("lap"), F.col("black"), F.col("white"), C)
    return metrics(spark, d).groupBy("l_linenumber", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


QUALITY_SQL = """(CASE WHEN lap >= 25 AND black <= 15 AND white <= 15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + least(lap / 80.0::DOUBLE, 3.0::DOUBLE) + least(mp / 8.0::DOUBLE, 2.0::DOUBLE) + 0.0::DOUBLE
  - (abs(black - 7.5::DOUBLE) / 15.0::DOUBLE + abs(white - 7.5::DOUBLE) / 15.0::DOUBLE) - 0.0::DOUBLE)"""


@query(f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(floor({QUALITY_SQL} * 10000) AS BIGINT) AS quality_e4 FROM ({METRICS_SQL})""")
def quality_score(spark, d):
    passed = scoring.filter_code(F.col("lap"), F.col("black"), F.col("white"), C) == ""
    q = scoring.quality_score(F.col("mp"), F.col("lap"), F.col("black"), F.col("white"), passed, F.lit(0.0), F.lit(False), F.lit(0.0), C)
    return metrics(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.floor(q * 10000).alias("quality_e4"))


@query("""SELECT c_custkey, regexp_extract(c_name, '^(.*?)(\\d+)$', 1) AS prefix, CAST(regexp_extract(c_name, '^(.*?)(\\d+)$', 2) AS BIGINT) AS idx FROM customer""")
def sequence_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.sequence_prefix(F.col("c_name")).alias("prefix"), text.sequence_index(F.col("c_name")).alias("idx"))


@query("""WITH k AS (SELECT c_custkey, regexp_extract(c_name, '^(.*?)(\\d+)$', 1) AS p, CAST(regexp_extract(c_name, '^(.*?)(\\d+)$', 2) AS BIGINT) AS i FROM customer)
SELECT a.c_custkey AS a, b.c_custkey AS b FROM k a JOIN k b ON a.p = b.p AND a.c_custkey < b.c_custkey AND abs(a.i - b.i) <= 20""")
def band_pairs(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", text.sequence_prefix(F.col("c_name")).alias("prefix"), text.sequence_index(F.col("c_name")).alias("idx"))
    return grouping.band_pairs(rows, ["prefix"], "c_custkey", "idx", 20).select(F.col("a_c_custkey").alias("a"), F.col("b_c_custkey").alias("b"))


# -- embeddings as photos of one album

PHOTO_SQL = """SELECT CAST(vec_id // 100 AS VARCHAR) AS folder, vec_id, 'DSCF' || lpad(CAST(vec_id AS VARCHAR), 6, '0') || '.JPG' AS filename, CAST(embedding AS DOUBLE[]) AS v,
  CAST((vec_id * 37) % 140 AS DOUBLE) AS lap, CAST((vec_id * 13) % 18 AS DOUBLE) AS black, CAST((vec_id * 7) % 17 AS DOUBLE) AS white, ((vec_id * 11) % 120) / 8.0::DOUBLE AS mp, ((vec_id * 29) % 128) / 128.0::DOUBLE AS clip,
  CAST(embedding[1:8] AS DOUBLE[]) AS color, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits, vec_id % 41 <> 0 AS decoded,
  list_sort([600 + (vec_id * 31) % 4000, (vec_id * 17) % 900, (vec_id * 23) % 700][1 : vec_id % 4], 'DESC') AS areas FROM embeddings"""
#: Thresholds that the test vectors can reach.
STRICT, FAMILY = Limits(20, 0.25), Limits(4, 0.2)


def photos(spark, d) -> DataFrame:
    v = F.col("vec_id")
    num = lambda a, m: ((v * a) % m).cast("double")
    return table(spark, d, "embeddings").select(
        F.expr("CAST(vec_id div 100 AS STRING)").alias("folder"), "vec_id", F.format_string("DSCF%06d.JPG", v).alias("filename"), F.format_string("/album/DSCF%06d.JPG", v).alias("path"),
        F.col("embedding").alias("img_vector"), num(37, 140).alias("laplacian_var"), num(13, 18).alias("black_clip_pct"), num(7, 17).alias("white_clip_pct"),
        (num(11, 120) / 8.0).alias("mp_raw"), (num(29, 128) / 128.0).alias("clip_score"), "label",
        F.slice("embedding", 1, 8).alias("color_thumb"), vectors.pack_bits(F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0))).alias("hash"), (v % 41 != 0).alias("decode_ok"),
        F.slice(F.array(F.lit(600) + num(31, 4000), num(17, 900), num(23, 700)), 1, (v % 4).cast("int")).alias("areas"), F.lit(20000.0).alias("image_area"),
    )


def pair_sql(limits: Limits, source: str = PHOTO_SQL, where: str = "true") -> str:
    look = f"AND list_dot_product(a.v, b.v) >= {limits.cosine}"
    if limits.color is not None:
        look += f" AND list_sum(list_transform(list_zip(a.color, b.color), lambda x: abs(x[1] - x[2]))) / 8 <= {limits.color}"
    if limits.hash is not None:
        look += f" AND list_sum(list_transform(list_zip(a.bits, b.bits), lambda x: CASE WHEN x[1] <> x[2] THEN 1 ELSE 0 END)) <= {limits.hash}"
    return f"""SELECT a.folder AS folder, a.vec_id AS a, b.vec_id AS b FROM (SELECT * FROM ({source}) WHERE {where}) a JOIN (SELECT * FROM ({source}) WHERE {where}) b
  ON a.folder = b.folder AND a.vec_id < b.vec_id AND b.vec_id - a.vec_id <= {limits.window} {look}"""


def edges_of(rows: DataFrame, limits: Limits) -> DataFrame:
    return grouping.similarity_edges(grouping.with_sequence(rows), [limits]).where("edge_0")


def with_ids(edges: DataFrame, rows: DataFrame) -> DataFrame:
    ids = grouping.with_sequence(rows).select("folder", "ord", "vec_id")
    a = ids.select("folder", F.col("ord").alias("a"), F.col("vec_id").alias("va"))
    b = ids.select("folder", F.col("ord").alias("b"), F.col("vec_id").alias("vb"))
    return edges.join(a, ["folder", "a"]).join(b, ["folder", "b"]).select("folder", F.col("va").alias("a"), F.col("vb").alias("b"))


@query(pair_sql(STRICT))
def similar_edges(spark, d):
    rows = photos(spark, d)
    return with_ids(edges_of(rows, STRICT), rows)


@query(pair_sql(FAMILY))
def family_edges(spark, d):
    rows = photos(spark, d)
    return with_ids(edges_of(rows, FAMILY), rows)


@query("""WITH e AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_transform(list_zip(a.embedding, b.embedding), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE)) AS g FROM e a JOIN e b ON a.vec_id + 1 = b.vec_id)
SELECT a, b, CAST(floor(list_sum(g) / len(g) * 100000 + 0.5) AS BIGINT) AS distance_e5 FROM p""")
def color_distance(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    gap = vectors.mean_abs_distance(F.col("x"), F.col("y"))
    return a.join(b, F.col("a") + 1 == F.col("b")).select("a", "b", F.floor(gap * 100000 + 0.5).alias("distance_e5"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS h FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, CAST(list_sum(list_transform(list_zip(a.h, b.h), lambda x: CASE WHEN x[1] <> x[2] THEN 1 ELSE 0 END)) AS BIGINT) AS distance FROM e a JOIN e b ON b.vec_id - a.vec_id BETWEEN 1 AND 3""")
def hamming_hash(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", vectors.pack_bits(F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0))).alias("h"), F.lit("").alias("k"))
    pairs = grouping.band_pairs(e, ["k"], "vec_id", "vec_id", 3, ["h"])
    return pairs.select(F.col("a_vec_id").alias("a"), F.col("b_vec_id").alias("b"), vectors.packed_hamming(F.col("a_h"), F.col("b_h")).cast("long").alias("distance"))


FLAT_SQL = """SELECT 'all' AS folder, vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE / sqrt(list_dot_product(embedding[1:4]::DOUBLE[], embedding[1:4]::DOUBLE[]))) AS v FROM embeddings"""


@query(f"""SELECT a.vec_id AS a, b.vec_id AS b FROM ({FLAT_SQL}) a JOIN ({FLAT_SQL}) b ON a.vec_id < b.vec_id AND list_dot_product(a.v, b.v) >= 0.97""")
def metric_edges(spark, d):
    """Without the sequence gate: one album, frames of four numbers."""
    rows = table(spark, d, "embeddings").select(F.lit("all").alias("folder"), F.format_string("/%09d", "vec_id").alias("path"), F.lit("x.jpg").alias("filename"), "vec_id", vectors.unit(F.slice("embedding", 1, 4)).alias("img_vector"))
    edges = grouping.similarity_edges(grouping.with_sequence(rows), [Limits(0, 0.97)], gate=False, keep=["vec_id"]).where("edge_0")
    return edges.select(F.col("a_vec_id").alias("a"), F.col("b_vec_id").alias("b"))


def groups_sql(limits: Limits, source: str = PHOTO_SQL, where: str = "true") -> str:
    """folder, vec_id, root, gid, gsize by recursive reachability."""
    return f"""(WITH RECURSIVE base AS (SELECT * FROM ({source}) WHERE {where}), e AS ({pair_sql(limits, source, where)}), s AS (SELECT folder, a, b FROM e UNION SELECT folder, b, a FROM e),
  reach AS (SELECT folder, vec_id AS a, vec_id AS b FROM base UNION SELECT r.folder, r.a, s.b FROM reach r JOIN s ON r.folder = s.folder AND r.b = s.a),
  roots AS (SELECT folder, a AS vec_id, min(b) AS root FROM reach GROUP BY folder, a)
  SELECT folder, vec_id, root, dense_rank() OVER (PARTITION BY folder ORDER BY root) AS gid, count(*) OVER (PARTITION BY folder, root) AS gsize FROM roots)"""


def grouped(rows: DataFrame, limits: Limits, group: str, size: str) -> DataFrame:
    seq = grouping.with_sequence(rows)
    return grouping.numbered_groups(seq, grouping.components(grouping.linked(seq, [limits])), group, size)


@query(f"SELECT folder, vec_id, CAST(gid AS BIGINT) AS group_id, CAST(gsize AS BIGINT) AS group_size FROM {groups_sql(STRICT)}")
def strict_groups(spark, d):
    return grouped(photos(spark, d), STRICT, "group_id", "group_size").select("folder", "vec_id", F.col("group_id").cast("long").alias("group_id"), "group_size")


@query(f"SELECT folder, vec_id, CAST(gid AS BIGINT) AS scene_family_id, CAST(gsize AS BIGINT) AS scene_family_size FROM {groups_sql(FAMILY)}")
def scene_families(spark, d):
    return grouped(photos(spark, d), FAMILY, "scene_family_id", "scene_family_size").select("folder", "vec_id", F.col("scene_family_id").cast("long").alias("scene_family_id"), "scene_family_size")


WINNER_SQL = f"""SELECT g.folder, g.vec_id, g.gid, g.gsize, p.lap, p.mp, row_number() OVER (PARTITION BY g.folder, g.gid ORDER BY (p.lap >= 25 AND p.black <= 15 AND p.white <= 15) DESC, p.clip >= 0.55 DESC, p.lap DESC, p.mp DESC, g.vec_id) = 1 AND (p.lap >= 25 AND p.black <= 15 AND p.white <= 15) AS win
  FROM {groups_sql(STRICT)} g JOIN ({PHOTO_SQL}) p USING (vec_id)"""


@query(f"SELECT folder, CAST(gid AS BIGINT) AS group_id, vec_id FROM ({WINNER_SQL}) WHERE win")
def group_winner(spark, d):
    rows = grouped(photos(spark, d), STRICT, "group_id", "group_size").withColumns({
        "eligible": scoring.filter_code(F.col("laplacian_var"), F.col("black_clip_pct"), F.col("white_clip_pct"), C) == "", "passed_clip": F.col("clip_score") >= C.clip_threshold,
        "quality": F.col("laplacian_var"), "megapixels": F.col("mp_raw"),
    })
    won = selection.winners(rows, ["folder", "group_id"], selection.winner_order())
    return won.where("is_winner").select("folder", F.col("group_id").cast("long").alias("group_id"), "vec_id")


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) / 3000 AS lap, max(o_totalprice) / 100000 AS q FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN n > 1 THEN '' ELSE concat_ws('; ', CASE WHEN lap < 50 THEN 'singleton_blur' END, CASE WHEN q < 2.75 THEN 'singleton_quality' END) END AS reason FROM g""")
def singleton_guard(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), (F.max("o_totalprice") / 3000).alias("lap"), (F.max("o_totalprice") / 100000).alias("q"))
    full = selection.singleton_reason(F.col("lap"), F.col("q"), F.col("n"), C)
    return g.select("o_custkey", F.regexp_replace(full, r" \([^)]*\)", "").alias("reason"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE k <= greatest(1, ceil(n * 0.3::DOUBLE))""")
def keep_ratio_trim(spark, d):
    rows = table(spark, d, "orders").withColumn("is_winner", F.lit(True))
    cut = selection.trimmed(rows, 0.3, key="o_custkey", score="o_totalprice", tie="o_orderkey")
    return cut.where(~F.col("trimmed")).select("o_custkey", "o_orderkey")


FLAGSHIP = replace(C, keep_ratio=0.8, group_cosine=0.25, family_cosine=0.2, group_hash=26, family_hash=28, check_background_people=True)
CANDIDATE = "decoded AND mp >= 1"
#: Numbers of reasons are compared to one decimal.
CUT = r"([0-9]+\.[0-9])[0-9]*"
DECISION_SQL = f"""WITH p AS ({PHOTO_SQL}), s AS (
  SELECT *, lap >= 25 AND black <= 15 AND white <= 15 AS passed, CASE WHEN mp >= 8 THEN 'above_8mp' WHEN mp >= 1 THEN 'between_1mp_and_8mp' ELSE 'below_1mp' END AS tier,
    CASE WHEN NOT decoded THEN 'decode_failed' WHEN mp < 1 THEN 'resolution_below_1mp' ELSE '' END AS gate,
    CASE WHEN lap < 25 THEN printf('blur (Laplacian var %.1f < 25.0)', lap) WHEN black > 15 THEN printf('underexposed (black clip %.1f%% > 15.0%%)', black)
      WHEN white > 15 THEN printf('overexposed (white clip %.1f%% > 15.0%%)', white) ELSE '' END AS base,
    len(areas) AS faces, coalesce(areas[1] / 20000, 0.0::DOUBLE) AS dominant, CASE WHEN len(areas) <= 1 THEN 0 ELSE len(list_filter(areas[2:], lambda x: x / 20000 >= 0.015 AND x / areas[1] <= 0.45)) END AS behind FROM p
), n AS (SELECT *, faces > 1 AND dominant >= 0.05 AND behind > 0 AS flagged FROM s
), c AS (
  SELECT *, passed AND clip >= 0.55 AS pclip, CASE WHEN flagged THEN 0.25::DOUBLE * behind ELSE 0.0::DOUBLE END AS penalty,
    (CASE WHEN passed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + least(lap / 80.0::DOUBLE, 3.0::DOUBLE) + least(mp / 8.0::DOUBLE, 2.0::DOUBLE)
    + CASE WHEN passed AND clip >= 0.55 THEN clip ELSE 0.0::DOUBLE END - (abs(black - 7.5::DOUBLE) / 15.0::DOUBLE + abs(white - 7.5::DOUBLE) / 15.0::DOUBLE) - CASE WHEN flagged THEN 0.25::DOUBLE * behind ELSE 0.0::DOUBLE END) AS q FROM n
), g AS (SELECT * FROM {groups_sql(grouping.strict_limits(FLAGSHIP), where=CANDIDATE)}), f AS (SELECT * FROM {groups_sql(grouping.family_limits(FLAGSHIP), where=CANDIDATE)}),
w AS (
  SELECT c.*, g.gid, g.gsize, f.gid AS fid, f.gsize AS fsize, row_number() OVER (PARTITION BY c.folder, g.gid ORDER BY passed DESC, pclip DESC, q DESC, mp DESC, c.vec_id) = 1 AND passed AS win,
    bool_or(passed) OVER (PARTITION BY c.folder, g.gid) AS any_ok
  FROM c JOIN g ON c.vec_id = g.vec_id JOIN f ON c.vec_id = f.vec_id
), k AS (SELECT *, CASE WHEN win AND gsize = 1 THEN concat_ws('; ', CASE WHEN lap < 50 THEN printf('singleton_blur (%.1f < 50.0)', lap) END, CASE WHEN q < 2.75 THEN printf('singleton_quality (%.3f < 2.75)', q) END) ELSE '' END AS guard FROM w
), t AS (SELECT *, win AND guard = '' AS stays, CASE WHEN win AND guard = '' AND gsize = 1 THEN q - 0.6::DOUBLE ELSE q END AS score FROM k
), r AS (SELECT *, row_number() OVER (PARTITION BY folder, stays ORDER BY score DESC, gid) AS rk, greatest(1, ceil(count(*) OVER (PARTITION BY folder, stays) * 0.8::DOUBLE)) AS keep FROM t
), x AS (SELECT *, stays AND rk <= keep AS selected, max(CASE WHEN rk = keep THEN score END) OVER (PARTITION BY folder, stays) AS cutoff FROM r
), y AS (SELECT *, max(CASE WHEN selected THEN filename END) OVER (PARTITION BY folder, gid) AS winner, max(CASE WHEN selected THEN tier END) OVER (PARTITION BY folder, gid) AS wtier FROM x
), z AS (
  SELECT folder, filename, tier, decoded, gate, passed, pclip, mp, lap, black, white, faces, behind, dominant, flagged, penalty, CASE WHEN passed THEN clip ELSE 0.0::DOUBLE END AS clip, CASE WHEN selected THEN score ELSE q END AS quality,
    CASE WHEN selected THEN 'selected' WHEN NOT any_ok OR guard <> '' OR (stays AND NOT selected) OR base <> '' THEN 'rejected' ELSE 'eligible' END AS status,
    CASE WHEN selected THEN '' WHEN NOT any_ok THEN CASE WHEN base = '' THEN 'no_eligible_image_in_group' ELSE base END WHEN guard <> '' THEN guard WHEN stays THEN printf('keep_ratio_trim (score=%.3f, cutoff=%.3f)', score, cutoff)
      WHEN winner IS NOT NULL THEN CASE WHEN base = '' THEN 'similar_to_selected:' || winner ELSE base || '; replaced by ' || winner END ELSE base END AS reason,
    gid, gsize, fid, fsize, selected, coalesce(winner, '') AS winner, coalesce(wtier, '') AS wtier, gsize = 1 AS single, CASE WHEN stays AND gsize = 1 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS lone FROM y
  UNION ALL SELECT folder, filename, tier, decoded, gate, passed, pclip, mp, lap, black, white, faces, behind, dominant, flagged, penalty, CASE WHEN passed THEN clip ELSE 0.0::DOUBLE END, q, 'rejected', gate, 0, 0, 0, 0, false, '', '', false, 0.0::DOUBLE FROM c WHERE gate <> ''
)
SELECT folder, filename, '/album/' || filename AS source_path, '.jpg' AS extension, tier AS resolution_tier, status, regexp_replace(reason, '{CUT}', '\\1', 'g') AS rejection_reason,
  CAST(gid AS BIGINT) AS group_id, CAST(gsize AS BIGINT) AS group_size, CAST(fid AS BIGINT) AS scene_family_id, CAST(fsize AS BIGINT) AS scene_family_size, selected AS selected_in_group, winner AS selected_filename, wtier AS selected_tier,
  decoded AS decode_ok, gate = '' AS passed_resolution, gate = '' AND passed AS passed_opencv, gate = '' AND pclip AS passed_clip, round_even(mp, 2) AS megapixels, lap AS laplacian_var, black AS black_clip_pct, white AS white_clip_pct,
  single AS singleton_group, lone AS singleton_penalty_applied, CAST(faces AS INT) AS face_count, CAST(behind AS INT) AS background_face_count, dominant AS dominant_face_ratio, true AS passed_scene_check, flagged AS scene_flagged,
  penalty AS scene_penalty, CASE WHEN flagged THEN printf('background_people_detected (%d smaller faces behind subject)', behind) ELSE '' END AS scene_rejection_reason, clip AS clip_score, CAST(floor(quality * 10000) AS BIGINT) AS quality_e4 FROM z"""


@query(DECISION_SQL)
def decision_log(spark, d):
    log = stage1.curate(photos(spark, d), FLAGSHIP)
    return log.withColumns({c: F.col(c).cast("long") for c in ("group_id", "group_size", "scene_family_id", "scene_family_size")}).withColumns({
        "rejection_reason": F.regexp_replace("rejection_reason", CUT, "$1"), "quality_e4": F.floor(F.col("quality_score") * 10000),
    }).drop("quality_score")


@query(f"""SELECT CASE WHEN flagged THEN 'people' ELSE '' END AS kind, count(*) AS n FROM (SELECT len(areas) > 1 AND areas[1] / 20000 >= 0.05 AND len(list_filter(areas[2:], lambda x: x / 20000 >= 0.015 AND x / areas[1] <= 0.45)) > 0 AS flagged
FROM ({PHOTO_SQL}) WHERE {CANDIDATE} AND lap >= 25 AND black <= 15 AND white <= 15) GROUP BY ALL""")
def scene_gate(spark, d):
    rows = stage1.scored(photos(spark, d), replace(FLAGSHIP, reject_background_people=True)).where("gate = '' AND filter_passed")
    kind = F.when(F.col("reason").startswith("background_people_detected") & (F.col("status") == "rejected"), "people").otherwise(F.col("reason"))
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT folder, filename FROM ({PHOTO_SQL}) WHERE decoded AND mp >= 8 AND lap >= 25 AND black <= 15 AND white <= 15 AND clip >= 0.55""")
def remote_gate(spark, d):
    return stage1.remote(photos(spark, d), C).select("folder", "filename")


@query(f"""SELECT folder, filename, mp >= 8 AS large FROM ({PHOTO_SQL}) WHERE decoded AND mp >= 8 AND lap >= 25 AND black <= 15 AND white <= 15""")
def gate_without_model(spark, d):
    """A remote run whose scoring model cannot be made: nothing is dropped for
    its score."""
    def broken():
        raise RuntimeError("no weights")

    scored, there = stage1.with_scores(photos(spark, d).drop("clip_score"), None, broken, None)
    return stage1.remote(scored, C, there).select("folder", "filename", (F.col("tier") == "above_8mp").alias("large"))


@query("""SELECT count(*) AS total_listed, count(*) FILTER (WHERE d.n_chars = 0) AS decode_failures, count(*) FILTER (WHERE d.n_chars > 0 AND d.n_chars < 500) AS rejected_resolution,
  count(*) FILTER (WHERE d.n_chars >= 500 AND coalesce(quality, 1) = 0) AS rejected_opencv, count(*) FILTER (WHERE d.n_chars >= 500 AND coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 1) AS below_clip,
  count(*) FILTER (WHERE d.n_chars >= 500 AND coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0) AS kept FROM documents d LEFT JOIN labels l USING (doc_id)""")
def run_stats(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    ok, res = F.col("n_chars") > 0, F.col("n_chars") >= 500
    cv = res & (F.coalesce("quality", F.lit(1)) == 1)
    clip = cv & (F.coalesce("toxic", F.lit(0)) == 0)
    return selection.run_stats(rows.select(ok.alias("decode_ok"), res.alias("passed_resolution"), cv.alias("passed_opencv"), clip.alias("passed_clip"), F.when(clip, "selected").otherwise("rejected").alias("status")))


# -- 8 by 8 pixels

PIXEL_SQL = """SELECT vec_id, i // 8 AS y, i % 8 AS x, CAST(greatest(0, least(255, floor(127.5 + 640 * embedding[i + 1]::DOUBLE))) AS INT) AS v FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)"""


def pixel_measures(spark, d, names) -> DataFrame:
    """The kernels' measures of 8 by 8 grey pictures made from embeddings."""
    v = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.lit(127.5) + 640 * x.cast("double")))).cast("int"))
    data = F.unhex(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), data.alias("data"))
    return table(spark, d, "embeddings").select("vec_id", image.alias("image")).select("vec_id", measure(F.col("image"), names).alias("m"))


@query(f"""WITH p AS ({PIXEL_SQL}), n AS (SELECT c.vec_id, c.y, c.x, c.v,
  (SELECT v FROM p q WHERE q.vec_id = c.vec_id AND q.x = c.x AND q.y = CASE WHEN c.y = 0 THEN 1 ELSE c.y - 1 END) AS u, (SELECT v FROM p q WHERE q.vec_id = c.vec_id AND q.x = c.x AND q.y = CASE WHEN c.y = 7 THEN 6 ELSE c.y + 1 END) AS d,
  (SELECT v FROM p q WHERE q.vec_id = c.vec_id AND q.y = c.y AND q.x = CASE WHEN c.x = 0 THEN 1 ELSE c.x - 1 END) AS l, (SELECT v FROM p q WHERE q.vec_id = c.vec_id AND q.y = c.y AND q.x = CASE WHEN c.x = 7 THEN 6 ELSE c.x + 1 END) AS r FROM p c)
SELECT vec_id, CAST(64 * sum(k * k) - sum(k) * sum(k) AS BIGINT) AS variance_x4096 FROM (SELECT vec_id, CAST(u + d + l + r - 4 * v AS BIGINT) AS k FROM n) GROUP BY vec_id""")
def laplacian_var(spark, d):
    return pixel_measures(spark, d, ["laplacian_var"]).select("vec_id", F.round(F.col("m.laplacian_var") * 4096).cast("long").alias("variance_x4096"))


@query(f"""SELECT vec_id, count(*) FILTER (WHERE v < 5) AS black, count(*) FILTER (WHERE v >= 251) AS white, 100.0::DOUBLE * count(*) FILTER (WHERE v < 5) / count(*) > 8 AS underexposed FROM ({PIXEL_SQL}) GROUP BY vec_id""")
def exposure_clip(spark, d):
    m = pixel_measures(spark, d, ["black_clip_pct", "white_clip_pct"])
    black, white = (F.round(F.col(f"m.{c}_clip_pct") * 64 / 100).cast("long") for c in ("black", "white"))
    return m.select("vec_id", black.alias("black"), white.alias("white"), (F.col("m.black_clip_pct") > 8).alias("underexposed"))


# -- 40 by 40 colour pictures: area resampling, cosine transform and median, as sums over tables of weights

#: Pixel values from an embedding's components, by place and channel (blue, green, red).
COLOR_SQL = """SELECT vec_id, y, x, c, CASE WHEN y < 2 AND x < 2 THEN 200 ELSE (v + 31 * c + 5 * x + 3 * y) % 256 END AS v FROM (
  SELECT vec_id, y, x, c, CAST(floor((embedding[1 + (y // 5) * 8 + x // 5]::DOUBLE + 1) * 997) AS BIGINT) AS v FROM embeddings, (SELECT unnest(range(40)) AS y), (SELECT unnest(range(40)) AS x), (SELECT unnest(range(3)) AS c))"""
#: How much of pixel j lies in cell i of 32, as a share of the cell.
BANDS_SQL = """SELECT i, j, (least(j + 1, (i + 1) * 1.25::DOUBLE) - greatest(j, i * 1.25::DOUBLE)) * 0.8::DOUBLE AS w FROM (SELECT unnest(range(32)) AS i), (SELECT unnest(range(40)) AS j) WHERE least(j + 1, (i + 1) * 1.25::DOUBLE) > greatest(j, i * 1.25::DOUBLE)"""
GREY_SQL = f"""p AS ({COLOR_SQL}), b AS ({BANDS_SQL}),
g AS (SELECT vec_id, y, x, round_even(0.114::DOUBLE * max(v) FILTER (WHERE c = 0) + 0.587::DOUBLE * max(v) FILTER (WHERE c = 1) + 0.299::DOUBLE * max(v) FILTER (WHERE c = 2), 0) AS v FROM p GROUP BY vec_id, y, x),
r AS (SELECT vec_id, i AS y, x, sum(w * v) AS v FROM g JOIN b ON y = j GROUP BY vec_id, i, x),
s AS (SELECT vec_id, y, i AS x, round_even(sum(w * v), 0) AS v FROM r JOIN b ON x = j GROUP BY vec_id, y, i)"""


def color_bytes(embeddings: pd.Series) -> pd.Series:
    """The pixels of 40 by 40 pictures, blue, green and red; null for a null
    embedding or one of other than 64 numbers. A picture is made at a time."""
    y, x, c = np.ogrid[:40, :40, :3]
    shift, corner = 31 * c + 5 * x + 3 * y, (y < 2) & (x < 2)

    def pixels(e) -> bytes | None:
        if e is None or len(e) != 64:
            return None
        e = np.asarray(e, np.float64)  # a null component is not a number here
        if not np.isfinite(e).all():
            return None
        base = np.floor((e + 1) * 997).astype(np.int64).reshape(8, 8)
        value = base.repeat(5, axis=0).repeat(5, axis=1)[..., None] + shift
        return np.where(corner, 200, np.fmod(value, 256)).astype(np.uint8).tobytes()

    return pd.Series([pixels(e) for e in embeddings], dtype=object)


def color_pictures(spark, d) -> DataFrame:
    """40 by 40 pictures made from embeddings; the first pixels are 200. Each is
    made in its row, so that no pixel is shuffled."""
    data = F.pandas_udf(color_bytes, "binary")("embedding")
    rows = table(spark, d, "embeddings").select("vec_id", data.alias("data"))
    return rows.select("vec_id", F.struct(F.lit(40).alias("height"), F.lit(40).alias("width"), F.lit(3).alias("nChannels"), "data").alias("image"))


def coded_pictures(spark, d) -> DataFrame:
    """The same pictures, with embeddings as data: ``color_bytes`` decodes them
    where they are looked at, so that no pixel goes to a worker or back."""
    image = F.struct(F.lit(40).alias("height"), F.lit(40).alias("width"), F.lit(3).alias("nChannels"), F.col("embedding").alias("data"))
    return table(spark, d, "embeddings").select("vec_id", image.alias("image"))


@query(f"""WITH {GREY_SQL} SELECT vec_id, array_to_string(list(CAST(v AS INT) ORDER BY y, x), ',') AS cells, true AS unit FROM s GROUP BY vec_id""")
def grey_vector(spark, d):
    """The unit vector's cells, told by the first, which is 200."""
    m = color_pictures(spark, d).select("vec_id", measure(F.col("image"), ["img_vector"])["img_vector"].alias("v"))
    cells = F.transform("v", lambda x: F.round(x.cast("double") / F.col("v")[0] * 200).cast("int").cast("string"))
    return m.select("vec_id", F.array_join(cells, ",").alias("cells"), (F.abs(vectors.dot(F.col("v"), F.col("v")) - 1) < 1e-5).alias("unit"))


@query(f"""WITH p AS ({COLOR_SQL}), b AS ({BANDS_SQL}), r AS (SELECT vec_id, i AS y, x, c, sum(w * v) AS v FROM p JOIN b ON y = j GROUP BY vec_id, i, x, c),
s AS (SELECT vec_id, y, i AS x, c, round_even(sum(w * v), 0) AS v FROM r JOIN b ON x = j GROUP BY vec_id, y, i, c)
SELECT vec_id, array_to_string(list(CAST(v AS INT) ORDER BY y, x, c), ',') AS cells FROM s GROUP BY vec_id""")
def colour_thumb(spark, d):
    m = coded_pictures(spark, d).select("vec_id", measure(F.col("image"), ["color_thumb"], color_bytes)["color_thumb"].alias("v"))
    return m.select("vec_id", F.array_join(F.transform("v", lambda x: F.floor(x.cast("double") * 255 + 0.5).cast("string")), ",").alias("cells"))


@query(f"""WITH {GREY_SQL}, t AS (SELECT u, n, sqrt(CASE WHEN u = 0 THEN 1 ELSE 2 END / 32.0::DOUBLE) * cos((2 * n + 1) * u * pi() / 64) AS w FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(32)) AS n)),
h AS (SELECT vec_id, u AS k, x, sum(w * v) AS v FROM s JOIN t ON y = n GROUP BY vec_id, u, x), f AS (SELECT vec_id, k, u AS l, sum(w * v) AS v FROM h JOIN t ON x = n GROUP BY vec_id, k, u),
m AS (SELECT vec_id, median(v) AS middle FROM f WHERE k > 0 GROUP BY vec_id)
SELECT vec_id, string_agg(CASE WHEN v > middle THEN '1' ELSE '0' END, '' ORDER BY k, l) AS bits FROM f JOIN m USING (vec_id) GROUP BY vec_id""")
def perceptual_hash(spark, d):
    m = coded_pictures(spark, d).select("vec_id", measure(F.col("image"), ["phash"], color_bytes)["phash"].alias("v"))
    return m.select("vec_id", F.array_join(F.transform("v", lambda x: x.cast("string")), "").alias("bits"))


@query("""SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 3 / sqrt(list_dot_product(list_transform(embedding, lambda y: y::DOUBLE * 3), list_transform(embedding, lambda y: y::DOUBLE * 3))) * 10000 + 0.5) AS BIGINT)), ',') AS unit_e4 FROM embeddings""")
def unit_vector(spark, d):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(vectors.unit(tripled), lambda x: F.floor(x * 10000 + 0.5).cast("string")), ",").alias("unit_e4"))


@query("""WITH c AS (SELECT label, i, sum(CAST(floor(embedding[i] * 1048576) AS BIGINT)) / 1048576.0::DOUBLE / count(*) AS m FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings WHERE label IN (0, 1)) GROUP BY label, i),
p AS (SELECT list(m ORDER BY i) AS v FROM c WHERE label = 0), n AS (SELECT list(m ORDER BY i) AS v FROM c WHERE label = 1)
SELECT vec_id, CAST(floor(s * 10000 + 0.5) AS BIGINT) AS score_e4, s >= 0.5 AS passed FROM (SELECT vec_id, exp(list_dot_product(embedding::DOUBLE[], p.v)) / (exp(list_dot_product(embedding::DOUBLE[], p.v)) + exp(list_dot_product(embedding::DOUBLE[], n.v))) AS s FROM embeddings, p, n)""")
def clip_score(spark, d):
    e = table(spark, d, "embeddings")
    parts = e.where(F.col("label").isin(0, 1)).select("label", F.posexplode("embedding").alias("i", "x"))
    mean = parts.groupBy("label", "i").agg((F.sum(F.floor(F.col("x") * F.lit(1048576.0).cast("float"))) / F.lit(1048576.0) / F.count(F.lit(1))).alias("m"))
    prompts = mean.groupBy().agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == k, F.struct("i", "m")))), lambda x: x["m"]).alias(n) for k, n in ((0, "pos"), (1, "neg"))])
    s = vectors.preference(F.col("embedding"), F.col("pos"), F.col("neg"))
    out = e.crossJoin(F.broadcast(prompts)).select("vec_id", s.alias("s"))  # one row of two prompts
    return out.select("vec_id", F.floor(F.col("s") * 10000 + 0.5).alias("score_e4"), (F.col("s") >= 0.5).alias("passed"))


FACE_SQL = """WITH a AS (SELECT l_orderkey, list(l_quantity * l_quantity ORDER BY l_quantity DESC) AS s FROM lineitem GROUP BY l_orderkey), b AS (
  SELECT l_orderkey, len(s) AS face_count, s[1] / 20000 AS dom, CASE WHEN len(s) <= 1 THEN 0 ELSE len(list_filter(s[2:], lambda x: x / 20000 >= 0.015 AND x / s[1] <= 0.45)) END AS bg FROM a)
SELECT l_orderkey, CAST(face_count AS INT) AS face_count, CAST(bg AS INT) AS background_face_count, face_count > 1 AND dom >= 0.05 AND bg > 0 AS flagged, CASE WHEN face_count > 1 AND dom >= 0.05 AND bg > 0 THEN 0.25::DOUBLE * bg ELSE 0.0::DOUBLE END AS penalty FROM b"""


@query(FACE_SQL)
def face_penalty(spark, d):
    boxes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity") * F.col("l_quantity")).alias("areas"))
    face = scoring.face_summary(F.col("areas"), F.lit(20000.0), C)
    return boxes.select("l_orderkey", face.alias("f")).select("l_orderkey", "f.face_count", "f.background_face_count", "f.flagged", "f.penalty")


# -- families and tournaments

@query("""SELECT source, count(*) AS input_count, CAST(greatest(1, ceil(count(*) / 4.0::DOUBLE)) AS INT) AS keep_limit FROM documents GROUP BY source""")
def family_quota(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("input_count")).withColumn("keep_limit", tournament.quota(F.col("input_count"), 4))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT o_custkey, o_orderkey, k = 1 AS is_primary, n > 1 AS is_distinct FROM r WHERE n <= greatest(1, ceil(n / 1.0::DOUBLE))""")
def auto_keep(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return tournament.auto_decisions(tournament.family_plan(rows, 1, "o_custkey", "o_orderkey"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "is_primary", "is_distinct")


@query("""WITH r AS (SELECT o_custkey || '/' || o_orderpriority AS family, o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k FROM orders)
SELECT family, o_orderkey, k = 1 AS is_primary, n > 1 AS is_distinct FROM r WHERE n <= greatest(1, ceil(n / 4.0::DOUBLE))""")
def auto_keep_whole(spark, d):
    rows = table(spark, d, "orders").select(F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("family"), "o_orderkey")
    return tournament.auto_decisions(tournament.family_plan(rows, 4, "family", "o_orderkey"), "family", "o_orderkey").select("family", "o_orderkey", "is_primary", "is_distinct")


BATCH_SQL = """SELECT p_partkey, p_size, (row_number() OVER (ORDER BY p_name, p_partkey) - 1) AS place FROM part"""


@query("""SELECT p_partkey, place // 12 + 1 AS batch, place % 12 AS slot FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part)""")
def batching(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.format_string("%09d.jpg", "p_partkey").alias("filename"))
    return tournament.batches(rows, 12).select("p_partkey", F.col("batch").cast("long").alias("batch"), F.col("slot").cast("long").alias("slot"))


TOP_SQL = """WITH b AS (SELECT p_partkey, p_size, (row_number() OVER (ORDER BY p_partkey) - 1) // 12 + 1 AS batch FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY p_size DESC, p_partkey) AS rk FROM b), f AS (SELECT * FROM r WHERE rk <= 3)"""


def _ranked(spark, d) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_size", F.format_string("%09d.jpg", "p_partkey").alias("filename"))
    rows = tournament.batches(rows, 12)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("batch").orderBy(F.desc("p_size"), "p_partkey")))


@query(TOP_SQL + " SELECT batch, rk AS rank, p_partkey FROM f")
def batch_topk(spark, d):
    top = tournament.per_batch_top(_ranked(spark, d), 12, 4)
    return top.select(F.col("batch").cast("long").alias("batch"), F.col("rank").cast("long").alias("rank"), "p_partkey")


@query(TOP_SQL + """, n AS (SELECT CAST(ceil(count(*) / 3.0::DOUBLE) AS BIGINT) AS n FROM b), fc AS (SELECT count(*) AS c FROM f),
rest AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS k FROM b WHERE p_partkey NOT IN (SELECT p_partkey FROM f)),
own AS (SELECT p_partkey, row_number() OVER (ORDER BY batch, rk) AS place FROM f)
SELECT p_partkey, place FROM own UNION ALL SELECT p_partkey, k + c FROM rest, n, fc WHERE c < n.n AND k + c <= n.n""")
def tournament_backfill(spark, d):
    ranked = _ranked(spark, d)
    total = ranked.count()
    n = -(-total // 3)
    finalists = tournament.per_batch_top(ranked, 12, 4).select("filename", "p_partkey", "batch", "rank")
    placed = dense_place(finalists, ["batch", "rank"], "p_").select("filename", (F.col("p_") + 1).alias("place"))
    scores = ranked.select("filename", F.col("p_size").alias("printworthy_score"), F.col("p_partkey").alias("ord"))
    out = tournament.back_filled(scores, placed, n, n)
    return out.select(F.substring("filename", 1, 9).cast("long").alias("p_partkey"), F.col("final_place").alias("place"))


@query("""WITH n AS (SELECT p_brand, p_brand LIKE '%1' AS lost, list(p_name || '-' || p_partkey ORDER BY p_partkey) AS names FROM part GROUP BY p_brand),
v AS (SELECT p_brand, names, CASE WHEN lost THEN ['nobody'] ELSE list_concat(['nobody', names[5]], list_reverse(names)) END AS asked, CASE WHEN lost THEN 'nobody' ELSE names[7] END AS top FROM n),
w AS (SELECT p_brand, names, top, list_filter(asked, lambda x, i: list_contains(names, x) AND list_position(asked, x) = i) AS ok FROM v),
r AS (SELECT p_brand, names, top, CASE WHEN len(ok) > 0 THEN ok[1:4] ELSE names[1:4] END AS ranked FROM w)
SELECT p_brand, array_to_string(ranked, '|') AS ranked, CASE WHEN list_contains(names, top) THEN top ELSE ranked[1] END AS top_filename FROM r""")
def final_rank_fallback(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("filename"), F.col("p_partkey").alias("final_place"))
    lost, names = F.col("p_brand").endswith("1"), F.col("names")
    answer = F.when(lost, F.array(F.lit("nobody"))).otherwise(F.concat(F.array(F.lit("nobody"), F.get(names, F.lit(4))), F.reverse(names)))
    top = F.when(lost, "nobody").otherwise(F.get(names, F.lit(6)))
    return tournament.final_ranking(rows, answer, top, 4, ["p_brand"]).select("p_brand", F.array_join("ranked_filenames", "|").alias("ranked"), "top_filename")


@query("""WITH b AS (SELECT p_name || '-' || p_partkey AS filename, p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 12 + 1 AS batch FROM part),
n AS (SELECT batch, list(filename ORDER BY p_partkey) AS names FROM b GROUP BY batch),
v AS (SELECT batch, names, CASE batch % 4 WHEN 0 THEN ['nobody'] ELSE ['nobody', names[5], names[3], names[5], names[9]] END AS asked, CASE batch % 3 WHEN 0 THEN 'nobody' ELSE names[7] END AS top FROM n),
w AS (SELECT batch, names, top, list_filter(asked, lambda x, i: list_contains(names, x) AND list_position(asked, x) = i) AS ok FROM v),
r AS (SELECT batch, names, top, CASE WHEN len(ok) > 0 THEN ok ELSE names[1:10] END AS ranked FROM w)
SELECT batch, array_to_string(ranked, '|') AS ranked, CASE WHEN list_contains(names, top) THEN top ELSE ranked[1] END AS top_filename FROM r""")
def final_rank_whole(spark, d):
    rows = table(spark, d, "part").select(F.format_string("%09d.jpg", "p_partkey").alias("place_name"), F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("filename"), F.col("p_partkey").alias("final_place"))
    rows = tournament.batches(rows, 12, name="place_name").withColumn("batch", F.col("batch").cast("long"))
    name = lambda i: F.get("names", F.lit(i))
    answer = F.when(F.col("batch") % 4 == 0, F.array(F.lit("nobody"))).otherwise(F.array(F.lit("nobody"), name(4), name(2), name(4), name(8)))
    top = F.when(F.col("batch") % 3 == 0, "nobody").otherwise(name(6))
    return tournament.final_ranking(rows, answer, top, 10, ["batch"]).select("batch", F.array_join("ranked_filenames", "|").alias("ranked"), "top_filename")


OVERRIDE_SQL = """WITH r AS (SELECT doc_id, lang AS base, CASE doc_id % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{"image_type":null,"safe_edits":[]}' WHEN 2 THEN '{"image_type":"","safe_edits":["crop",""]}' ELSE '{"image_type":"new","safe_edits":null}' END AS j FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN base WHEN 1 THEN 'None' WHEN 2 THEN '' ELSE 'new' END AS image_type, CASE WHEN doc_id % 4 = 2 THEN 'crop' ELSE base END AS safe_edits FROM r"""


@query(OVERRIDE_SQL)
def reason_override(spark, d):
    j = F.element_at(F.array(F.lit("{}"), F.lit('{"image_type":null,"safe_edits":[]}'), F.lit('{"image_type":"","safe_edits":["crop",""]}'), F.lit('{"image_type":"new","safe_edits":null}')), (F.col("doc_id") % 4 + 1).cast("int"))
    v = F.parse_json(j)
    return table(spark, d, "documents").select(
        "doc_id", lenient_json.override_text(v, "image_type", F.col("lang")).alias("image_type"), F.array_join(lenient_json.override_list(v, "safe_edits", F.array("lang")), "|").alias("safe_edits")
    )


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events""")
def json_extract(spark, d):
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure, here it is: "), "props", F.lit(" Enjoy."))).otherwise(F.col("props"))
    v = lenient_json.from_free_text(wrapped)
    return table(spark, d, "events").select("event_id", lenient_json.field(v, "$.k", "string").alias("k"), v.isNotNull().alias("valid"))


ASPECT_SQL = "CASE i WHEN 0 THEN '1:1' WHEN 1 THEN '4:3' WHEN 2 THEN '3:4' WHEN 3 THEN '16:9' WHEN 4 THEN '9:16' WHEN 5 THEN '3:2' ELSE '2:3' END"


@query(f"""WITH v AS (SELECT * FROM (VALUES (0, 1, 1), (1, 4, 3), (2, 3, 4), (3, 16, 9), (4, 9, 16), (5, 3, 2), (6, 2, 3)) t(i, a, b)),
r AS (SELECT p_partkey, i, row_number() OVER (PARTITION BY p_partkey ORDER BY abs((p_size - 3)::DOUBLE / (p_partkey % 37 + 1) - a::DOUBLE / b), i) AS k, p_size FROM part, v)
SELECT p_partkey, CASE WHEN p_size - 3 <= 0 THEN '1:1' ELSE {ASPECT_SQL} END AS aspect FROM r WHERE k = 1""")
def aspect_ratio(spark, d):
    return table(spark, d, "part").select("p_partkey", scoring.aspect_ratio(F.col("p_size") - 3, F.col("p_partkey") % 37 + 1).alias("aspect"))


@query("""SELECT p_partkey, array_to_string(list_distinct_ordered, '; ') AS joined FROM (SELECT p_partkey, list_filter([p_brand, p_type, p_brand], lambda x, i: x <> '' AND list_position([p_brand, p_type, p_brand], x) = i) AS list_distinct_ordered FROM part)""")
def joined_unique(spark, d):
    return table(spark, d, "part").select("p_partkey", text.joined_unique(F.array("p_brand", "p_type", F.lit(""), "p_brand"), "none").alias("joined"))


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), '.'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '' AND NOT regexp_matches(lower(x), 'rotat|turn 90|flip|orient')), '|') AS kept FROM documents""")
def rotation_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.drop_rotation(F.split(F.coalesce("text", F.lit("")), r"\.")), "|").alias("kept"))


@query("""SELECT p_partkey, lower(trim(regexp_replace(p_brand || ' / ' || p_type || '!', '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS slug FROM part""")
def slug(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat("p_brand", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"))


LADDER = "[1600, 1360, 1156, 982, 834]"


@query(f"""WITH s AS (SELECT o_orderkey, o_totalprice, unnest(range(25)) AS step FROM orders), z AS (SELECT o_orderkey, step, {LADDER}[step // 5 + 1] AS side, 84 - 6 * (step % 5) AS quality, CAST(floor(o_totalprice * {LADDER}[step // 5 + 1] * (84 - 6 * (step % 5)) / 20000) AS BIGINT) AS bytes FROM s),
f AS (SELECT o_orderkey, min(CASE WHEN bytes <= 900000 THEN step END) AS first, max(step) AS last FROM z GROUP BY o_orderkey)
SELECT z.o_orderkey, CAST(z.step AS INT) AS step, CAST(z.side AS INT) AS side, CAST(z.quality AS INT) AS quality, z.bytes FROM z JOIN f ON z.o_orderkey = f.o_orderkey AND z.step = coalesce(f.first, f.last)""")
def review_ladder(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(4000).alias("width"), F.lit(3000).alias("height"))
    rungs = tournament.review_ladder(rows).withColumn("bytes", F.floor(F.col("o_totalprice") * F.col("side") * F.col("quality") / 20000))
    return tournament.first_fit(rungs, ["o_orderkey"], "bytes", 900_000).select("o_orderkey", "step", "side", "quality", "bytes")


@query("""SELECT o.o_orderkey, c.c_mktsegment AS detail FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderpriority <> '1-URGENT'""")
def detail_lookup(spark, d):
    name = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("unknown"), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string"))
    ranked = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("07_"), name).alias("filename"))
    details = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("filename"), F.col("c_mktsegment").alias("detail"), F.col("c_custkey").alias("pos"))
    return lookups.with_details(ranked, details).select("o_orderkey", "detail")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def skip_existing(spark, d):
    images = table(spark, d, "orders").select("o_orderkey", F.concat(F.col("o_custkey").cast("string"), F.lit(".jpg")).alias("filename"))
    done = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".png")).alias("filename"))
    return lookups.skip_existing(images, done).select("o_orderkey")


@query("""SELECT c_custkey, c_name FROM customer ORDER BY c_name LIMIT 20 OFFSET 9""")
def rank_slice(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.concat("c_name", F.lit(".jpg")).alias("filename"))
    return lookups.rank_slice(rows, 10, 20).select("c_custkey", "c_name")


@query("""WITH r AS (SELECT l_orderkey, min(CASE WHEN l_linenumber % 2 = 0 THEN '.RAF' ELSE '.raf' END) FILTER (WHERE l_returnflag = 'R') AS ext FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN r.ext IS NOT NULL THEN '/raw/' || o_orderkey || r.ext END AS raw_path FROM orders LEFT JOIN r ON o_orderkey = l_orderkey""")
def raw_companion(spark, d):
    o = table(spark, d, "orders")
    winners = o.select("o_orderkey", F.lit("a").alias("folder"), F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, ".tif").otherwise(".JPG")).alias("filename"))
    raw = F.when(F.col("l_linenumber") % 2 == 0, ".RAF").otherwise(".raf")
    name = F.concat(F.col("l_orderkey").cast("string"), F.when(F.col("l_returnflag") == "R", raw).otherwise(".xmp"))
    files = table(spark, d, "lineitem").select(F.lit("a").alias("folder"), name.alias("name"), F.concat(F.lit("/raw/"), name).alias("path")).distinct()
    return lookups.raw_companions(winners, files).select("o_orderkey", "raw_path")


@query("""WITH f AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'DSC1.JPG' WHEN 1 THEN 'trip/_DSC.heic' WHEN 2 THEN 'Stage2_x/a.jpg' WHEN 3 THEN 'trip/deep/a.jpg' WHEN 4 THEN 'Curated_Best/a.png' ELSE regexp_extract(url, '//([^/]+)/', 1) || '/page.html' END AS rel FROM pages)
SELECT page_id, rel FROM f WHERE page_id % 6 IN (0, 1)""")
def album_files(spark, d):
    host = F.concat(F.regexp_extract("url", "//([^/]+)/", 1), F.lit("/page.html"))
    rel = F.coalesce(F.get(F.array(*map(F.lit, ("DSC1.JPG", "trip/_DSC.heic", "Stage2_x/a.jpg", "trip/deep/a.jpg", "Curated_Best/a.png"))), (F.col("page_id") % 6).cast("int")), host)
    return album_filter(table(spark, d, "pages").select("page_id", rel.alias("rel"))).select("page_id", "rel")


@query("""WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'edge_completion' WHEN 1 THEN 'crowd_cleanup' WHEN 2 THEN event_type ELSE 'edge_completion' END AS m, event_id % 5 AS k, CAST(floor(value) AS BIGINT) % 4 AS s FROM events)
SELECT event_id, CASE WHEN k IN (1) THEN 'crowd_cleanup' WHEN k = 2 THEN 'tonal_only' WHEN k = 0 THEN 'square_and_level' WHEN s IN (0, 1) THEN 'edge_completion' ELSE 'square_and_level' END AS repair_mode,
  CASE WHEN k IN (3, 4) AND s = 0 THEN 'left' WHEN k IN (3, 4) AND s = 1 THEN 'right' ELSE '' END AS pad_sides FROM e""")
def analysis_validate(spark, d):
    k = F.col("event_id") % 5
    mode = F.when(k == 1, "crowd_cleanup").when(k == 2, F.col("event_type")).otherwise("edge_completion")
    side = F.get(F.array(*map(F.lit, ("left", "right", "top", "bottom"))), F.floor("value").cast("int") % 4)
    sides = F.when(k == 0, F.array(*map(F.lit, ("left", "right", "top", "bottom")))).otherwise(F.array(side, F.lit("middle")))
    plan = lenient_json.validated_analysis(mode, sides)
    return table(spark, d, "events").select("event_id", plan["repair_mode"].alias("repair_mode"), F.array_join(plan["pad_sides"], ",").alias("pad_sides"))


@query("""WITH n AS (SELECT o_orderkey, o_custkey || '.jpg' AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 1 THEN name ELSE replace(name, '.jpg', '') || '_' || (k - 1) || '.jpg' END AS out_name FROM n""")
def download_names(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.col("o_custkey").cast("string"), F.lit(".jpg")).alias("name"), F.col("o_orderkey").alias("ord"))
    return lookups.collision_names(rows).select("o_orderkey", "out_name")


@query("""SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM conversations""")
def fenced_text(spark, d):
    fenced = F.concat(F.lit("```json\n"), "text", F.lit("\n```"))
    return table(spark, d, "conversations").select("conv_id", "turn", lenient_json.strip_fence(fenced).alias("body"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '.png' WHEN p_size % 4 IN (1, 2) THEN '.jpg' ELSE '.tif' END AS suffix, CASE WHEN strpos(p_name, '_') > 0 THEN substr(p_name, strpos(p_name, '_') + 1) ELSE p_name END AS bare FROM part""")
def mime_suffix(spark, d):
    mime = F.get(F.array(*map(F.lit, ("IMAGE/png", "image/jpg", "image/JPEG", "image/tiff"))), F.col("p_size") % 4)
    return table(spark, d, "part").select("p_partkey", text.suffix_for_mime(mime, F.lit(".tif")).alias("suffix"), text.strip_rank(F.col("p_name")).alias("bare"))


@query("""SELECT CAST(s_nationkey AS BIGINT) AS scene_family_id, lower(trim(regexp_replace(m, '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS model_slug, count(*) AS n FROM supplier, (VALUES ('gemma-4:31b'), ('Other/Model 2')) t(m) GROUP BY ALL""")
def model_runs(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("scene_family_id"), "s_suppkey")
    return lookups.model_runs(rows, ["gemma-4:31b", "Other/Model 2"]).groupBy("scene_family_id", "model_slug").agg(F.count(F.lit(1)).alias("n"))


# -- families, answers and responses

ANSWER_SQL = """WITH r AS (SELECT o_custkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS name, count(*) OVER (PARTITION BY o_custkey) AS n, list(lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) OVER (PARTITION BY o_custkey) AS members FROM orders),
m AS (SELECT o_custkey, name, n, CAST(greatest(1, ceil(n / 4.0::DOUBLE)) AS INT) AS quota, list_sort(members) AS names FROM r),
v AS (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN ['ghost'] ELSE list_filter(['ghost', names[3], names[2], names[3], names[5]], lambda x: x IS NOT NULL) END AS asked, CASE WHEN o_custkey % 2 = 0 THEN names[2] ELSE 'ghost' END AS first FROM m WHERE n > quota),
w AS (SELECT *, list_filter(asked, lambda x, i: list_contains(names, x) AND list_position(asked, x) = i) AS ok FROM v),
k AS (SELECT *, CASE WHEN len(ok) > 0 THEN ok[1:quota] ELSE names[1:1] END AS kept FROM w)"""


@query(ANSWER_SQL + """ SELECT o_custkey, name, list_contains(kept, name) AS kept, name = CASE WHEN list_contains(kept, first) THEN first ELSE kept[1] END AS is_primary, len(kept) > 1 AS is_distinct,
  CASE WHEN o_custkey % 3 <> 0 AND name = names[3] THEN 'later' ELSE '' END AS reason FROM k""")
def model_keep(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.format_string("%09d", "o_orderkey").alias("name"))
    names = rows.groupBy("o_custkey").agg(F.sort_array(F.collect_list("name")).alias("names"))
    at = lambda i: F.get("names", F.lit(i))
    lost = F.col("o_custkey") % 3 == 0
    entry = lambda n, why: F.struct(n.alias("filename"), F.lit(why).alias("reason"))
    answers = names.select(
        "o_custkey", F.when(lost, F.array(F.lit("ghost"))).otherwise(F.filter(F.array(F.lit("ghost"), at(2), at(1), at(2), at(4)), lambda x: x.isNotNull())).alias("keep"),
        F.when(F.col("o_custkey") % 2 == 0, at(1)).otherwise("ghost").alias("primary"),
        F.when(~lost, F.array(entry(at(2), "first"), entry(F.lit("ghost"), "none"), entry(at(2), "later"))).alias("photos"),
    )
    plan = tournament.family_plan(rows, 4, "o_custkey", "name")
    return tournament.model_decisions(plan, answers, "o_custkey", "name")


@query("""SELECT CAST(o_orderdate AS VARCHAR) AS filename, max(o_custkey) AS scene_family_id FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderdate""")
def survivor_names(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderdate").cast("string").alias("filename"), F.col("o_custkey").alias("scene_family_id"), (F.col("o_orderstatus") != "F").alias("kept"))
    return tournament.survivors(rows).select("filename", "scene_family_id")


@query("""WITH f AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey IN (3, 5, 8, 9, 14, 21) ORDER BY k LIMIT 4) SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT k FROM f)""")
def first_families(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return tournament.first_families(rows, [3, 5, 8, 9, 14, 21], 4, "s_nationkey")


@query("""SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS best_filename FROM orders GROUP BY o_custkey""")
def checked_pick(spark, d):
    answers = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderpriority").alias("best_filename"), F.collect_set("o_orderpriority").alias("names"))
    return lookups.check_answer(answers).drop("names")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE coalesce(nullif(text || coalesce(nullif(role, ''), ''), ''), NULL) END AS said, CASE WHEN turn % 2 = 0 THEN 'image/jpeg' ELSE 'image/png' END AS mime, length(coalesce(text, '')) AS n, CAST(turn AS VARCHAR) AS tokens FROM conversations""")
def model_response(spark, d):
    """Text, last inline image and usage of responses in both spellings."""
    c = table(spark, d, "conversations")
    body = F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    old = F.struct(F.struct(F.lit("image/gif").alias("mimeType"), F.base64(F.lit(b"old")).alias("data")).alias("inlineData"))
    last = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.struct(F.lit("image/jpeg").alias("mime_type"), F.concat(body, F.base64(F.lit(b""))).alias("data")).alias("inline_data")))).otherwise(F.to_json(F.struct(F.struct(body.alias("data")).alias("inlineData"))))
    texts = F.when(F.col("turn") % 3 == 0, F.lit('{"text":""}')).otherwise(F.concat(F.to_json(F.struct("text")), F.lit(","), F.to_json(F.struct(F.col("role").alias("text")))))
    response = F.concat(F.lit('{"candidates":[{"content":{"parts":['), texts, F.lit(","), F.to_json(old), F.lit(","), last, F.lit("]}}],\"usageMetadata\":{\"totalTokenCount\":"), F.col("turn").cast("string"), F.lit("}}"))
    image = lenient_json.response_image(response)
    return c.select("conv_id", "turn", lenient_json.response_text(response).alias("said"), image["mime"].alias("mime"), F.length(F.decode(image["data"], "UTF-8")).cast("long").alias("n"), lenient_json.usage(response)["totalTokenCount"].alias("tokens"))


@query("""WITH e AS (SELECT event_id, [' Yes', 'no', '1', 'maybe', '', 'TRUE '][CAST(event_id % 6 AS INT) + 1] AS t FROM events)
SELECT event_id, CASE WHEN event_id % 6 IN (0, 2, 5) THEN true WHEN event_id % 6 IN (1, 4) THEN false ELSE event_id % 2 = 0 END AS flag, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'a|b' ELSE event_type END AS items FROM events""")
def coerced_fields(spark, d):
    e = table(spark, d, "events")
    said = F.get(F.array(*map(F.lit, (" Yes", "no", "1", "maybe", "", "TRUE "))), (F.col("event_id") % 6).cast("int"))
    items = F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("array<string>")).when(F.col("event_id") % 3 == 1, F.array(F.lit(" a"), F.lit(" "), F.lit("b "))).otherwise(F.array("event_type"))
    return e.select("event_id", lenient_json.coerce_bool(said, F.col("event_id") % 2 == 0).alias("flag"), F.array_join(lenient_json.normalize_list(items), "|").alias("items"))


SCORE_SQL = """WITH b AS (SELECT p_partkey, p_brand, p_size, p_type, (row_number() OVER (ORDER BY p_partkey) - 1) // 12 + 1 AS batch FROM part),
e AS (SELECT *, batch % 5 <> 0 AS readable, p_size % 7 <> 0 AS named FROM b),
s AS (SELECT *, CASE WHEN readable AND named THEN greatest(1.0::DOUBLE, least(10.0::DOUBLE, p_size / 4.0::DOUBLE)) ELSE 1.0::DOUBLE END AS score, readable AND p_size % 3 = 0 AS best FROM e),
r AS (SELECT *, CASE WHEN best THEN row_number() OVER (PARTITION BY batch, best ORDER BY p_size DESC, p_partkey) END AS place FROM s)"""


@query(SCORE_SQL + """ SELECT p_partkey, batch, score AS printworthy_score, CASE WHEN readable AND named THEN p_brand ELSE '' END AS category, CASE WHEN readable AND named THEN p_type || '; calm' ELSE '' END AS strengths,
  readable AND named AND p_size % 2 = 0 AS worth_enhancing, CAST(place AS INT) AS top_place, coalesce(place <= 3, false) AS finalist FROM r""")
def photo_scores(spark, d):
    """Scores of photos and finalists from batches' answers as text, some of
    which cannot be read or leave photos out."""
    rows = tournament.batches(table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_type", F.format_string("%09d.jpg", "p_partkey").alias("filename")), 12)
    rows = rows.withColumn("batch", F.col("batch").cast("long"))
    entry = F.struct(
        "filename", (F.col("p_size") / 4.0).alias("printworthy_score"), F.concat(F.lit(" "), "p_brand").alias("category"), F.array(F.col("p_type"), F.lit(""), F.lit("calm")).alias("strengths"),
        F.when(F.col("p_size") % 2 == 0, "yes").otherwise("no").alias("worth_enhancing"),
    )
    best = F.transform(F.array_sort(F.collect_list(F.when(F.col("p_size") % 3 == 0, F.struct((-F.col("p_size")).alias("s"), F.col("p_partkey").alias("k"), "filename")))), lambda x: x["filename"])
    answers = rows.groupBy("batch").agg(F.collect_list(F.when(F.col("p_size") % 7 != 0, entry)).alias("photos"), F.concat(F.array(F.lit("ghost.jpg")), best, F.slice(best, 1, 1)).alias("top_batch_filenames"))
    said = F.concat(F.lit("Here: "), F.to_json(F.struct("photos", "top_batch_filenames")), F.lit(" done"))
    answers = answers.select("batch", F.when(F.col("batch") % 5 == 0, "sorry, no").otherwise(said).alias("response"))
    scores = tournament.photo_scores(rows, answers)
    chosen = tournament.batch_finalists(scores, 12, 4).select("p_partkey", F.lit(True).alias("finalist"))
    return scores.join(chosen, "p_partkey", "left").select("p_partkey", "batch", "printworthy_score", "category", F.array_join("strengths", "; ").alias("strengths"), "worth_enhancing", "top_place", F.coalesce("finalist", F.lit(False)).alias("finalist"))


@query("""WITH n AS (SELECT p_brand, list(p_partkey ORDER BY p_size DESC, p_partkey)[1:5] AS ks FROM part GROUP BY p_brand), r AS (SELECT p_brand, unnest(ks) AS k, generate_subscripts(ks, 1) AS rank FROM n)
SELECT CAST(rank AS INT) AS rank, p_partkey, p_size AS score, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS final_reason FROM r JOIN part ON k = p_partkey""")
def ranked_details(spark, d):
    part = table(spark, d, "part").withColumn("filename", F.format_string("%09d.jpg", "p_partkey"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("p_size")).alias("s"), F.col("p_partkey").alias("k"), "filename")))
    ranking = part.groupBy("p_brand").agg(F.slice(F.transform(order, lambda x: x["filename"]), 1, 5).alias("ranked_filenames"))
    reasons = part.where("p_partkey % 2 = 0").select("filename", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("early").alias("reason")), F.struct(F.lit(1).alias("pos"), F.col("p_type").alias("reason")))).alias("e")).select("filename", "e.*")
    return tournament.ranked_details(ranking, part.select("filename", "p_partkey", F.col("p_size").alias("score")), reasons).select("rank", "p_partkey", "score", "final_reason")


@query("""SELECT p_partkey, (1000 + p_size * 37) * (800.0::DOUBLE + p_partkey % 900) / 1e6::DOUBLE AS mp FROM part""")
def megapixels(spark, d):
    return table(spark, d, "part").select("p_partkey", scoring.megapixels(F.lit(1000) + F.col("p_size") * 37, F.lit(800) + F.col("p_partkey") % 900).alias("mp"))


# -- stage 2 from end to end, with a stand-in model

STAGE2_SQL = """WITH r AS (SELECT o_custkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '.jpg' AS filename, 1 + o_orderkey % 10 AS score, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS last FROM orders),
d AS (SELECT *, n <= quota OR last <= quota AS kept FROM (SELECT *, greatest(1, ceil(n / 4.0::DOUBLE)) AS quota FROM r)),
b AS (SELECT filename, score, row_number() OVER (ORDER BY filename) - 1 AS ord, (row_number() OVER (ORDER BY filename) - 1) // 12 + 1 AS batch, count(*) OVER () AS total FROM d WHERE kept),
p AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY score DESC, filename) <= 3 AS best, ceil(total / 4.0::DOUBLE) AS top_n, 3 * ceil(total / 12.0::DOUBLE) AS cap FROM b),
f AS (SELECT *, count(*) FILTER (WHERE best) OVER () AS found, row_number() OVER (PARTITION BY best ORDER BY score DESC, ord) AS fill FROM p),
g AS (SELECT * FROM f WHERE best OR (found < top_n AND fill + found <= greatest(top_n, cap)))"""


@query(STAGE2_SQL + """ SELECT o_custkey AS scene_family_id, filename, kept, CASE WHEN n <= quota THEN last = n ELSE last = 1 END AS is_primary, CASE WHEN n <= quota THEN n > 1 ELSE quota > 1 END AS is_distinct,
  CASE WHEN n <= quota THEN 'auto_keep_family_size_within_limit' ELSE 'by number' END AS reason FROM d""")
def stage2_families(spark, d):
    return stage2.reduce_families(stage2_photos(spark, d), OrdinalModel, stage2.Stage2Config())


def stage2_photos(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("scene_family_id"), F.format_string("%09d.jpg", "o_orderkey").alias("filename"))


#: Finalists by place, ranked in groups of 48 of which 12 go on, until one is left.
ROUNDS_SQL = STAGE2_SQL.replace("WITH r AS", "WITH RECURSIVE r AS", 1) + """,
s AS (SELECT filename, score, top_n, CASE WHEN best THEN row_number() OVER (PARTITION BY best ORDER BY batch, score DESC, filename) ELSE found + fill END - 1 AS place FROM g),
t AS (
  SELECT 0 AS round, filename, score, top_n, place, place // 48 AS grp, row_number() OVER (PARTITION BY place // 48 ORDER BY score DESC, filename) AS rk, count(*) OVER () AS m FROM s
  UNION ALL
  SELECT round + 1, filename, score, top_n, place, place // 48, row_number() OVER (PARTITION BY place // 48 ORDER BY score DESC, filename), count(*) OVER ()
  FROM (SELECT round, filename, score, top_n, row_number() OVER (ORDER BY grp, rk) - 1 AS place FROM t WHERE m > 48 AND rk <= 12)
), l AS (SELECT filename, score, top_n, round, grp, rk FROM t QUALIFY row_number() OVER (PARTITION BY filename ORDER BY round DESC) = 1),
n AS (SELECT *, row_number() OVER (ORDER BY round DESC, rk, grp) AS nth FROM l)"""


@query(ROUNDS_SQL + """ SELECT CAST(nth AS INT) AS rank, filename, CAST(score AS DOUBLE) AS printworthy_score, 'c' || substr(filename, 9, 1) AS category, 'by number' AS reason, CASE WHEN rk % 2 = 1 THEN 'last ' || substr(filename, 9, 1) END AS final_reason,
  first_value(filename) OVER (ORDER BY nth) AS top_filename FROM n WHERE nth <= top_n""")
def stage2_portfolio(spark, d):
    _, ranked = stage2.run(stage2_photos(spark, d), OrdinalModel)
    return ranked.select("rank", "filename", "printworthy_score", "category", "reason", "final_reason", "top_filename")


@query(STAGE2_SQL + """ SELECT (SELECT count(*) FROM orders) AS input_selected_count, (SELECT count(DISTINCT o_custkey) FROM orders) AS family_count, (SELECT count(DISTINCT o_custkey) FROM d) AS processed_family_count,
  (SELECT count(DISTINCT o_custkey) FROM d WHERE n > quota) AS model_family_count, max(total) AS input_survivor_count, CAST(max(top_n) AS BIGINT) AS target_top_n, 3 AS top_per_batch, CAST(ceil(max(total) / 12.0::DOUBLE) AS BIGINT) AS batch_count FROM p""")
def stage2_dry_run(spark, d):
    photos, c = stage2_photos(spark, d), stage2.Stage2Config()
    kept = tournament.survivors(stage2.reduce_families(photos, OrdinalModel, c))
    return stage2.reduce_families(photos, OrdinalModel, c, dry_run=True).crossJoin(stage2.rank_portfolio(kept, OrdinalModel, c, dry_run=True))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_partkey % 5000 + 1 AS BIGINT) END AS width, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS height FROM part""")
def image_dimensions(spark, d):
    """Sizes from headers: PNG, GIF, JPEG and HEIC, and what is no image."""
    w, h = F.col("p_partkey") % 5000 + 1, F.col("p_size")
    x = lambda c, n: F.lpad(F.hex(c.cast("long")), n, "0")
    turned = lambda c: F.concat(F.substring(x(c, 4), 3, 2), F.substring(x(c, 4), 1, 2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), x(w, 8), x(h, 8))
    gif = F.concat(F.lit("474946383961"), turned(w), turned(h))
    jpeg = F.concat(F.lit("FFD8FFE000040000FFC0001108"), x(h, 4), x(w, 4), F.lit("0000"))
    heic = F.concat(F.lit("0000000C6674797068656963000000446D657461000000000000003869707270" + "000000306970636F00000014697370650000000000000001" + "00000001" + "0000001469737065" + "00000000"), x(w, 8), x(h, 8))
    data = F.unhex(F.get(F.array(F.lit("68656C6C6F"), png, gif, jpeg, heic), (F.col("p_size") % 5).cast("int")))
    size = image_files.dimensions(data)
    return table(spark, d, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


# -- what the sinks write

COPY_SQL = "SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN 'Above_8MP' ELSE 'Between_1MP_and_8MP' END AS dir, o_orderkey % 3 = 0 AS raw FROM orders"


@query(f"""SELECT '/album/' || o_orderkey || '.JPG' AS src, '/out/' || dir || '/' || o_orderkey || '.JPG' AS dst FROM ({COPY_SQL}) UNION ALL SELECT '/raw/' || o_orderkey || '.RAF', '/out/' || dir || '/' || o_orderkey || '.RAF' FROM ({COPY_SQL}) WHERE raw""")
def copy_targets(spark, d):
    o, key = table(spark, d, "orders"), F.col("o_orderkey").cast("string")
    winners = o.select(
        F.concat(F.lit("/album/"), key, F.lit(".JPG")).alias("path"), F.concat(key, F.lit(".JPG")).alias("filename"), F.when(F.col("o_totalprice") >= 100000, "above_8mp").otherwise("between_1mp_and_8mp").alias("tier"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("/raw/"), key, F.lit(".RAF"))).alias("raw_path"),
    )
    return outputs.copy_manifest(winners, "/out/", C)


@query("""SELECT '/in/' || p_name AS src, '/ranked/' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '_' || p_name AS dst FROM part""")
def ranked_targets(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.lit("/in/"), "p_name").alias("path"), F.col("p_size").alias("rank"), F.col("p_name").alias("filename"))
    return outputs.ranked_manifest(rows, "/ranked", 3)


@query("""SELECT event_type, count(*) FILTER (WHERE event_id % 7 <> 0) AS completed_count, count(*) FILTER (WHERE event_id % 7 = 0) AS failure_count FROM events GROUP BY event_type""")
def improvement_outcome(spark, d):
    rows = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 7 == 0, "failed").alias("error"))
    return outputs.improvement_summary(rows, ["event_type"])


@query("""SELECT format('family_{:04d}.json', s_suppkey) AS name, to_json({'scene_family_id': s_suppkey, 'primary': s_name, 'mode': CASE WHEN s_suppkey % 2 = 0 THEN 'model' END}) AS json FROM supplier""")
def family_json(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("scene_family_id"), F.col("s_name").alias("primary"), F.when(F.col("s_suppkey") % 2 == 0, "model").alias("mode"))
    return outputs.family_documents(rows)


@query("""WITH p AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS kept, list_sort(list(DISTINCT o_orderkey % 5)) AS groups FROM orders GROUP BY o_custkey)
SELECT count(*) AS family_count, CAST(sum(n) AS BIGINT) AS input_count, CAST(sum(kept) AS BIGINT) AS survivor_count, CAST(sum(len(groups)) AS BIGINT) AS group_ids, array_to_string(list(groups[1] ORDER BY o_custkey), '') AS first_ids FROM p""")
def family_totals(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("scene_family_id"), F.col("o_orderkey").cast("string").alias("filename"), (F.col("o_orderstatus") == "O").alias("kept"), F.lit(False).alias("is_primary"), F.lit("").alias("reason"), (F.col("o_orderkey") % 5).alias("strict_group_id"),
    )
    lines = outputs.family_summary(rows)
    item = F.when(F.col("part") == 2, F.parse_json(F.ltrim("line", F.lit(","))))
    head = F.max(F.when(F.col("part") == 0, F.concat("line", F.lit("}"))))
    ids = F.variant_get(item, "$.strict_group_ids", "array<int>")
    doc = lines.select("part", "place", "line", ids.alias("ids")).groupBy().agg(
        head.alias("head"), F.sum(F.size("ids")).alias("group_ids"), F.array_sort(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("place", F.col("ids")[0].cast("string").alias("i"))))).alias("first"),
    )
    counts = [F.get_json_object("head", f"$.{c}").cast("long").alias(c) for c in ("family_count", "input_count", "survivor_count")]
    return doc.select(*counts, "group_ids", F.array_join(F.transform("first", lambda x: x["i"]), "").alias("first_ids"))


@query("""WITH p AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS kept, list_sort(list(DISTINCT o_orderkey % 5)) AS groups FROM orders GROUP BY o_custkey)
SELECT o_custkey AS place, CASE WHEN o_custkey = (SELECT min(o_custkey) FROM p) THEN '' ELSE ',' END || '{"scene_family_id":' || o_custkey || ',"input_count":' || n || ',"kept_count":' || kept || ',"strict_group_ids":[' || array_to_string(groups, ',') || ']' AS begins FROM p""")
def family_lines(spark, d):
    """The summary's lines of families, up to their photos."""
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("scene_family_id"), F.col("o_orderkey").cast("string").alias("filename"), (F.col("o_orderstatus") == "O").alias("kept"), F.lit(False).alias("is_primary"), F.lit("").alias("reason"), (F.col("o_orderkey") % 5).alias("strict_group_id"),
    )
    return outputs.family_summary(rows).where("part = 2").select("place", F.element_at(F.split("line", ',"photos"'), 1).alias("begins"))
