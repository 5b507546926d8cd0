"""Winners, guards, trimming and final statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CurationConfig

ELIGIBLE = ("pending", "eligible", "selected")


def winners(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with ``is_winner``: the first of its group among the eligible,
    by (passed_clip, unrounded quality, rounded megapixels), ties to the
    earliest. ``rows.eligible`` says who may win."""
    w = W.partitionBy(*keys).orderBy(F.desc("eligible"), *order)
    return rows.withColumn("is_winner", (F.row_number().over(w) == 1) & F.col("eligible"))


def winner_order() -> list[Column]:
    return [F.desc("passed_clip"), F.desc("quality"), F.desc("megapixels"), F.asc("ord")]


def singleton_reason(lap: Column, quality: Column, size: Column, c: CurationConfig) -> Column:
    """Why a lone winner is dropped: either test, or both joined."""
    soft = F.when(lap < c.singleton_blur, F.format_string(f"singleton_blur (%.1f < {c.singleton_blur})", lap))
    weak = F.when(quality < c.singleton_min_quality, F.format_string(f"singleton_quality (%.3f < {c.singleton_min_quality})", quality))
    return F.when(size == 1, F.concat_ws("; ", soft, weak)).otherwise("")


def keep_count(n: Column, ratio: float) -> Column:
    """How many of ``n`` winners a ratio keeps; in doubles, as 0.07 of 100 is 8."""
    return F.greatest(F.lit(1), F.ceil(n * F.lit(float(ratio))).cast("int"))


def trimmed(rows: DataFrame, ratio: float, key: str = "folder", score: str = "score", tie: str = "group_id", who: str = "is_winner") -> DataFrame:
    """Adds ``trimmed`` and ``cutoff``: per ``key`` the winners beyond the top
    share by score. Nothing is trimmed at a ratio of 1."""
    if ratio >= 1:
        return rows.withColumns({"trimmed": F.lit(False), "cutoff": F.lit(None).cast("double")})
    all_ = W.partitionBy(key, who)
    n = F.count(F.lit(1)).over(all_)
    rank = F.row_number().over(all_.orderBy(F.desc(score), F.asc(tie)))
    ranked = rows.withColumns({"rank_": rank, "keep_": keep_count(n, ratio)})
    cutoff = F.max(F.when(F.col("rank_") == F.col("keep_"), F.col(score))).over(all_)
    return ranked.withColumns({"trimmed": F.col(who) & (F.col("rank_") > F.col("keep_")), "cutoff": F.when(F.col(who), cutoff)}).drop("rank_", "keep_")


def decide(candidates: DataFrame, c: CurationConfig) -> DataFrame:
    """Final status, reason and winner of every grouped candidate.

    Input: folder, ord, filename, group_id, group_size, status, reason,
    filter_passed, passed_clip, quality, megapixels, laplacian_var, tier.
    """
    group = W.partitionBy("folder", "group_id")
    rows = candidates.withColumn("eligible", F.col("status").isin(*ELIGIBLE) & F.col("filter_passed"))
    rows = winners(rows, ["folder", "group_id"], winner_order())
    guard = F.when(F.col("is_winner"), singleton_reason(F.col("laplacian_var"), F.col("quality"), F.col("group_size"), c)).otherwise("")
    rows = rows.withColumn("guard", guard).withColumn("stays", F.col("is_winner") & (F.col("guard") == ""))
    lone = F.col("stays") & (F.col("group_size") == 1)
    rows = rows.withColumns({
        "singleton_penalty_applied": F.when(lone, c.singleton_penalty).otherwise(0.0),
        "score": F.when(lone, F.col("quality") - c.singleton_penalty).otherwise(F.col("quality")),
        "any_eligible": F.max("eligible").over(group),
    })
    rows = trimmed(rows, c.keep_ratio, who="stays")
    rows = rows.withColumn("selected", F.col("stays") & ~F.col("trimmed"))
    named = F.max(F.when(F.col("selected"), F.struct("filename", "tier"))).over(group)
    rows = rows.withColumn("winner", named)
    kept = F.col("winner").isNotNull()
    loser = kept & ~F.col("selected")
    no_reason = F.col("reason") == ""
    cut_text = F.format_string("keep_ratio_trim (score=%.3f, cutoff=%.3f)", F.col("score"), F.col("cutoff"))
    return rows.withColumns({
        "final_status": F.when(F.col("selected"), "selected").when(~F.col("any_eligible") | (F.col("guard") != "") | F.col("trimmed"), "rejected").otherwise(F.col("status")),
        "final_reason": F.when(F.col("selected"), "")
        .when(~F.col("any_eligible"), F.when(no_reason, "no_eligible_image_in_group").otherwise(F.col("reason")))
        .when(F.col("guard") != "", F.col("guard"))
        .when(F.col("trimmed"), cut_text)
        .when(loser, F.when(no_reason, F.concat(F.lit("similar_to_selected:"), F.col("winner.filename"))).otherwise(F.concat(F.col("reason"), F.lit("; replaced by "), F.col("winner.filename"))))
        .otherwise(F.col("reason")),
        "selected_filename": F.coalesce(F.col("winner.filename"), F.lit("")),
        "selected_tier": F.coalesce(F.col("winner.tier"), F.lit("")),
        "singleton_group": F.col("group_size") == 1,
    }).drop("guard", "stays", "any_eligible", "winner", "eligible")


def counters() -> list[Column]:
    """Run counters over the rows of a decision log."""
    return [
        F.count(F.lit(1)).alias("total_listed"), F.count_if(~F.col("decode_ok")).alias("decode_failures"),
        F.count_if(F.col("decode_ok") & ~F.col("passed_resolution")).alias("rejected_resolution"),
        F.count_if(F.col("passed_resolution") & ~F.col("passed_opencv")).alias("rejected_opencv"),
        F.count_if(F.col("passed_opencv") & ~F.col("passed_clip")).alias("below_clip"), F.count_if(F.col("status") == "selected").alias("kept"),
    ]


def run_stats(log: DataFrame) -> DataFrame:
    """One row of run counters from a decision log."""
    return log.agg(*counters())


def summary_text(stats: DataFrame | dict) -> str:
    row = stats if isinstance(stats, dict) else stats.first().asDict()
    return "\n".join(f"{k.replace('_', ' ')}: {v}" for k, v in row.items())
