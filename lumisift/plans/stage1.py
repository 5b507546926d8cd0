"""Stage 1 as one declarative plan: measured photos in, decision log out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import models
from ..config import CurationConfig
from ..functions import scoring, text, vectors
from ..models import Embedder
from ..operators import grouping, selection
from ..operators.tables import stored


def _or(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def scored(photos: DataFrame, c: CurationConfig, hard_clip: bool = False, clip_available: bool = True) -> DataFrame:
    """Gates, filters and scores of every photo.

    ``photos``: folder, path, filename, width and height (or mp_raw), the three
    pixel measures, img_vector, and optionally color_thumb, hash, decode_ok,
    areas and image_area of faces, clip_score.
    """
    decoded = _or(photos, "decode_ok", F.lit(True))
    raw = _or(photos, "mp_raw", scoring.megapixels(F.col("width"), F.col("height")) if "width" in photos.columns else F.lit(None))
    rows = photos.withColumns({"decode_ok": decoded, "mp_raw": raw, "clip": _or(photos, "clip_score", F.lit(0.0))})
    rows = rows.withColumn("tier", scoring.resolution_tier(F.col("mp_raw"), c))
    rows = rows.withColumn("gate", scoring.gate_reason(F.col("decode_ok"), F.col("mp_raw").isNotNull(), F.col("tier")))
    lap, black, white = F.col("laplacian_var"), F.col("black_clip_pct"), F.col("white_clip_pct")
    rows = rows.withColumn("filter_reason", scoring.filter_reason(lap, black, white, c))
    face = scoring.face_summary(F.col("areas"), F.col("image_area"), c) if c.check_background_people and "areas" in photos.columns else None
    rows = rows.withColumns({
        "flagged": face["flagged"] if face is not None else F.lit(False), "scene_penalty": face["penalty"] if face is not None else F.lit(0.0),
        "face_count": face["face_count"] if face is not None else F.lit(0), "background_face_count": face["background_face_count"] if face is not None else F.lit(0),
        "dominant_face_ratio": face["dominant_face_ratio"] if face is not None else F.lit(0.0),
    })
    passed, scene_ok = F.col("filter_reason") == "", scoring.scene_passed(F.col("flagged"), c)
    clip_ok, still_in = scoring.clip_gate(F.col("clip"), passed, scene_ok, c, hard_clip, clip_available)
    rows = rows.withColumns({"filter_passed": passed, "passed_clip": clip_ok, "still_in": still_in, "scene_ok": scene_ok})
    rows = rows.withColumns({"clip": F.when(passed & F.col("scene_ok"), F.col("clip")).otherwise(0.0), "scene_reason": scoring.scene_reason(F.col("flagged"), F.col("background_face_count"))})
    reason = F.when(F.col("gate") != "", F.col("gate")).when(~passed, F.col("filter_reason")).when(~F.col("scene_ok"), F.col("scene_reason")).when(~F.col("still_in"), "clip_below_threshold").otherwise("")
    quality = scoring.quality_score(F.col("mp_raw"), lap, black, white, passed, F.col("clip"), F.col("passed_clip"), F.col("scene_penalty"), c)
    return rows.withColumns({"reason": reason, "status": F.when(reason == "", "eligible").otherwise("rejected"), "quality": quality, "megapixels": F.bround("mp_raw", 2)})


def with_scores(photos: DataFrame, images: DataFrame, factory: Callable[[], Embedder], prompts: DataFrame) -> tuple[DataFrame, bool]:
    """``photos`` with clip_score, and whether there is a model to score them.

    The model is probed once, on the driver, before anything is planned: if it
    cannot be made, no photo is scored for the whole run and nothing fails.
    ``images`` has path and image; ``prompts`` one row of the vectors ``pos``
    and ``neg``.
    """
    if not models.probe(factory):
        return photos.withColumn("clip_score", F.lit(0.0)), False
    seen = models.embed_images(images.where("image.width > 0"), factory, ["path"])
    score = vectors.preference(F.col("clip_vector"), F.col("pos"), F.col("neg"))
    scores = seen.crossJoin(F.broadcast(prompts.limit(1))).select("path", score.alias("clip_score"))  # one row of two vectors
    return photos.join(scores, "path", "left").withColumn("clip_score", F.coalesce("clip_score", F.lit(0.0))), True


def curate(photos: DataFrame, c: CurationConfig, clip_available: bool = True) -> DataFrame:
    """The decision log: one row per photo. Photos that fail a gate have no
    group; those that fail a filter are vertices of the graph all the same.
    Without a scoring model (``clip_available``) no photo passes its test and
    none is dropped for it."""
    # pictures are decoded and measured once, whatever reads them below
    rows = stored(scored(photos, c, clip_available=clip_available), "scored")
    candidates = grouping.grouped(grouping.with_sequence(rows.where("gate = ''")), c)
    decided = selection.decide(candidates, c)
    done = decided.withColumns({"status": F.col("final_status"), "reason": F.col("final_reason"), "quality": F.when(F.col("selected"), F.col("score")).otherwise(F.col("quality"))})
    gated = rows.where("gate <> ''").withColumns({
        "group_id": F.lit(0), "group_size": F.lit(0).cast("long"), "scene_family_id": F.lit(0), "scene_family_size": F.lit(0).cast("long"), "selected": F.lit(False),
        "selected_filename": F.lit(""), "selected_tier": F.lit(""), "singleton_group": F.lit(False), "singleton_penalty_applied": F.lit(0.0),
    })
    return done.unionByName(gated, allowMissingColumns=True).select(
        "folder", "filename", F.col("path").alias("source_path"), text.suffix(F.col("filename")).alias("extension"), F.col("tier").alias("resolution_tier"), "status", F.col("reason").alias("rejection_reason"),
        "group_id", "group_size", "scene_family_id", "scene_family_size", F.col("selected").alias("selected_in_group"), "selected_filename", "selected_tier", "decode_ok",
        ((F.col("gate") == "") | ~F.col("gate").isin("decode_failed", "metadata_unavailable", "resolution_below_1mp")).alias("passed_resolution"),
        ((F.col("gate") == "") & F.col("filter_passed")).alias("passed_opencv"), ((F.col("gate") == "") & F.col("passed_clip")).alias("passed_clip"), "megapixels", "laplacian_var", "black_clip_pct", "white_clip_pct",
        "singleton_group", "singleton_penalty_applied", "face_count", "background_face_count", "dominant_face_ratio", F.col("scene_ok").alias("passed_scene_check"), F.col("flagged").alias("scene_flagged"),
        "scene_penalty", F.col("scene_reason").alias("scene_rejection_reason"), F.col("clip").alias("clip_score"), F.col("quality").alias("quality_score"),
    )


def remote(photos: DataFrame, c: CurationConfig, clip_available: bool = True) -> DataFrame:
    """A remote run: no groups, and the aesthetic score is a hard gate, unless
    there is no model for it."""
    rows = scored(photos, c, hard_clip=True, clip_available=clip_available)
    return rows.where((F.col("gate") == "") & F.col("still_in")).where(F.col("mp_raw") >= c.min_megapixels)
