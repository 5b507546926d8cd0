"""Resolution tiers, filters and the quality score, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CurationConfig


def megapixels(width: Column, height: Column) -> Column:
    return width.cast("double") * height / F.lit(1e6)


def resolution_tier(mp: Column, c: CurationConfig) -> Column:
    """Labels stay the same whatever the thresholds are."""
    return F.when(mp >= c.min_megapixels, "above_8mp").when(mp >= c.medium_min_megapixels, "between_1mp_and_8mp").otherwise("below_1mp")


def quality_score(mp: Column, lap: Column, black: Column, white: Column, passed: Column, clip: Column, passed_clip: Column, penalty: Column, c: CurationConfig) -> Column:
    """Sharpness and resolution, capped, plus passes and the aesthetic score,
    less the distance of exposure from half its limits, less the penalty."""
    sharp = F.least(lap / max(c.laplacian_threshold, 1.0), F.lit(3.0))
    exposure = F.abs(black - c.black_clip_pct / 2) / max(c.black_clip_pct, 1.0) + F.abs(white - c.white_clip_pct / 2) / max(c.white_clip_pct, 1.0)
    resolution = F.least(mp / max(c.min_megapixels, 1.0), F.lit(2.0))
    return F.when(passed, 1.0).otherwise(0.0) + sharp + resolution + F.when(passed_clip, clip).otherwise(0.0) - exposure - penalty


def filter_reason(lap: Column, black: Column, white: Column, c: CurationConfig) -> Column:
    """The first failing test, or an empty text: blur, then dark, then bright."""
    return (
        F.when(lap < c.hard_blur_threshold, F.format_string(f"blur (Laplacian var %.1f < {c.hard_blur_threshold})", lap))
        .when(black > c.black_clip_pct, F.format_string(f"underexposed (black clip %.1f%% > {c.black_clip_pct}%%)", black))
        .when(white > c.white_clip_pct, F.format_string(f"overexposed (white clip %.1f%% > {c.white_clip_pct}%%)", white))
        .otherwise("")
    )


def filter_code(lap: Column, black: Column, white: Column, c: CurationConfig) -> Column:
    return F.when(lap < c.hard_blur_threshold, "blur").when(black > c.black_clip_pct, "underexposed").when(white > c.white_clip_pct, "overexposed").otherwise("")


def gate_reason(decoded: Column, has_size: Column, tier: Column) -> Column:
    """Decode, metadata and resolution gates, the first failure alone."""
    return F.when(~decoded, "decode_failed").when(~has_size, "metadata_unavailable").when(tier == "below_1mp", "resolution_below_1mp").otherwise("")


def clip_gate(score: Column, filter_passed: Column, scene_passed: Column, c: CurationConfig, hard: bool, available: bool = True) -> tuple[Column, Column]:
    """``(passed_clip, still_in)``. Local runs use the score as a bonus; remote
    runs (``hard``) drop what fails. If the model is not available, which is
    probed once before planning, nothing passes and nothing is dropped."""
    passed = (filter_passed & scene_passed & (score >= c.clip_threshold)) if available else F.lit(False)
    return F.coalesce(passed, F.lit(False)), (F.coalesce(passed, F.lit(False)) if hard and available else filter_passed & scene_passed)


def face_summary(areas: Column, image_area: Column, c: CurationConfig) -> Column:
    """``(face_count, background_face_count, dominant_face_ratio, flagged,
    penalty)`` from face areas; a lone face is never flagged."""
    ordered = F.sort_array(areas.cast("array<double>"), asc=False)
    n = F.coalesce(F.size(areas), F.lit(0))
    top = F.get(ordered, F.lit(0))
    rest = F.slice(ordered, 2, F.greatest(F.lit(0), n - 1))
    background = F.size(F.filter(rest, lambda a: (a / image_area >= c.min_background_face_ratio) & (a / F.get(ordered, F.lit(0)) <= c.max_background_relative)))
    background = F.when(n <= 1, 0).otherwise(background)
    dominant = F.coalesce(top / image_area, F.lit(0.0))
    flagged = (n > 1) & (dominant >= c.min_dominant_face_ratio) & (background > c.max_background_faces)
    return F.struct(
        n.alias("face_count"), background.alias("background_face_count"), dominant.alias("dominant_face_ratio"),
        F.coalesce(flagged, F.lit(False)).alias("flagged"), F.when(flagged, c.background_face_penalty * background).otherwise(0.0).alias("penalty"),
    )


def scene_reason(flagged: Column, background: Column) -> Column:
    return F.when(flagged, F.format_string("background_people_detected (%d smaller faces behind subject)", background)).otherwise("")


def scene_passed(flagged: Column, c: CurationConfig) -> Column:
    return ~flagged if c.reject_background_people else F.lit(True)


#: The output shapes a model accepts, in order of preference.
ASPECTS = ((1, 1), (4, 3), (3, 4), (16, 9), (9, 16), (3, 2), (2, 3))


def aspect_ratio(width: Column, height: Column) -> Column:
    """The nearest accepted shape, the first of equally near ones."""
    actual = width.cast("double") / F.nullif(height.cast("double"), F.lit(0.0))
    ranked = F.array(*[F.struct(F.abs(actual - a / b).alias("gap"), F.lit(i).alias("i"), F.lit(f"{a}:{b}").alias("label")) for i, (a, b) in enumerate(ASPECTS)])
    return F.when((width <= 0) | (height <= 0), "1:1").otherwise(F.array_min(ranked)["label"])
