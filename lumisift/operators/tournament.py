"""Family quotas, batched ranking and the final list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lenient_json
from .tables import dense_place


def quota(n: Column, divisor: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(float(divisor))).cast("int"))


def family_plan(photos: DataFrame, divisor: int, family: str = "scene_family_id", name: str = "filename") -> DataFrame:
    """Adds input_count, keep_limit, place (from 1, by name) and mode: families
    within their quota are kept whole (``auto_keep``), the others ask a model."""
    w = W.partitionBy(family)
    rows = photos.withColumns({"input_count": F.count(F.lit(1)).over(w), "place": F.row_number().over(w.orderBy(name))})
    rows = rows.withColumn("keep_limit", quota(F.col("input_count"), divisor))
    return rows.withColumn("mode", F.when(F.col("input_count") <= F.col("keep_limit"), "auto_keep").otherwise("model"))


def auto_decisions(plan: DataFrame, family: str = "scene_family_id", name: str = "filename") -> DataFrame:
    """Decisions of families that need no model."""
    return plan.where("mode = 'auto_keep'").select(
        family, name, F.lit(True).alias("kept"), (F.col("place") == 1).alias("is_primary"), (F.col("input_count") > 1).alias("is_distinct"),
        F.lit("auto_keep_family_size_within_limit").alias("reason"),
    )


def model_decisions(plan: DataFrame, answers: DataFrame, family: str = "scene_family_id", name: str = "filename") -> DataFrame:
    """Decisions from model answers ``(family, keep array<string>, primary,
    photos array<struct<filename, reason>>)``.

    Names that are not in the family go, the rest is distinct in answer order
    and cut to the quota; if nothing is left the first by name is kept. The
    primary is the model's if kept, else the first kept. Of entries for one
    name the last gives the reason.
    """
    rows = plan.where("mode = 'model'")
    said = answers.select(family, F.posexplode("keep").alias("pos_", name)).groupBy(family, name).agg(F.min("pos_").alias("pos_"))
    named = said.join(rows.select(family, name, "keep_limit"), [family, name])
    order = W.partitionBy(family).orderBy("pos_")  # as long as an answer
    named = named.withColumn("nth_", F.row_number().over(order)).where(F.col("nth_") <= F.col("keep_limit")).select(family, name, "nth_")
    alone = rows.where("place = 1").join(named.select(family).distinct(), family, "left_anti").select(family, name, F.lit(1).alias("nth_"))
    kept = named.unionByName(alone)
    primary = answers.select(family, F.col("primary").alias(name), F.lit(True).alias("asked_")).where(F.col(name).isNotNull()).distinct()
    best = F.min(F.struct(F.when(F.col("asked_"), 0).otherwise(1).alias("k"), "nth_", F.col(name).alias("n")))["n"]
    ends = kept.join(primary, [family, name], "left").groupBy(family).agg(F.count(F.lit(1)).alias("kept_n_"), best.alias("first_"))
    entries = answers.select(family, F.posexplode("photos").alias("pos_", "e_")).groupBy(family, F.col("e_.filename").alias(name)).agg(F.max_by("e_.reason", "pos_").alias("why_"))
    found = rows.join(kept, [family, name], "left").join(entries, [family, name], "left").join(ends, family, "left")
    return found.select(
        family, name, F.col("nth_").isNotNull().alias("kept"), F.coalesce(F.col(name) == F.col("first_"), F.lit(False)).alias("is_primary"),
        (F.col("kept_n_") > 1).alias("is_distinct"), F.coalesce("why_", F.lit("")).alias("reason"),
    )


def survivors(decisions: DataFrame, name: str = "filename") -> DataFrame:
    """Kept photos, one per name (of equal names that of the last family)."""
    w = W.partitionBy(name).orderBy(F.desc("scene_family_id"))
    return decisions.where("kept").withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def first_families(photos: DataFrame, wanted: list | None, most: int | None, family: str = "scene_family_id") -> DataFrame:
    """Only the wanted families, and of them the first ``most`` by id."""
    if wanted:
        photos = photos.where(F.col(family).isin(wanted))
    if most:
        ids = photos.select(family).distinct().orderBy(family).limit(most)
        photos = photos.join(F.broadcast(ids), family, "left_semi")  # at most ``most`` rows
    return photos


def batches(photos: DataFrame, size: int, key: list[str] = (), name: str = "filename") -> DataFrame:
    """Adds batch (from 1) and slot (from 0) in the order of names: contiguous
    slices of ``size``, per ``key`` if one is given.

    Without a key the order is global; places then come from range partitions
    and their counts, not from one task.
    """
    if key:
        place = photos.withColumn("place_", F.row_number().over(W.partitionBy(*key).orderBy(name)) - 1)
    else:
        place = dense_place(photos, [name], "place_")
    return place.withColumns({"batch": F.expr(f"place_ div {size} + 1"), "slot": F.expr(f"place_ % {size}")}).drop("place_")


#: Fields of a photo's score besides its name and path, and what an answer that
#: lacks them gives.
SCORE_TEXTS = ("category", "reason", "image_type", "enhancement_goal")
SCORE_LISTS = ("strengths", "safe_edits", "conditional_edits", "avoid_edits", "risk_flags")
SCORE_FLAGS = ("keepable", "printworthy", "worth_enhancing")
LOWEST, HIGHEST = 1, 10


def photo_scores(batched: DataFrame, answers: DataFrame, name: str = "filename") -> DataFrame:
    """One score per photo of a batch, from the batch's answer ``(batch,
    response)``: printworthy_score, the texts, lists and flags of the entry that
    bears its name (the last of several), and top_place, its place (from 1)
    among the names that the answer calls best, invented and repeated ones
    apart.

    A photo without an entry, and all photos of an answer that cannot be read,
    have the lowest score and empty fields; scores are kept within 1 to 10.
    """
    v = lenient_json.from_free_text(F.col("response"))
    field, items = lenient_json.field, "array<variant>"
    read = answers.select("batch", field(v, "$.photos", items).alias("entries_"), field(v, "$.top_batch_filenames", "array<string>").alias("best_"))
    rows = batched.join(read, "batch", "left")
    members = F.collect_set(name).over(W.partitionBy("batch"))  # a batch is a few photos
    rows = rows.withColumn("members_", members)
    entry = F.try_element_at(F.filter("entries_", lambda e: field(e, "$.filename", "string") == F.col(name)), F.lit(-1))
    rows = rows.withColumn("entry_", entry)
    best = F.filter(F.array_distinct(F.coalesce("best_", F.array().cast("array<string>"))), lambda x: F.array_contains(F.col("members_"), x))
    place = F.nullif(F.array_position(best, F.col(name)), F.lit(0))
    score = F.coalesce(field(F.col("entry_"), "$.printworthy_score", "double"), F.lit(float(LOWEST)))
    texts = [F.coalesce(F.trim(field(F.col("entry_"), f"$.{c}", "string")), F.lit("")).alias(c) for c in SCORE_TEXTS]
    lists = [lenient_json.normalize_list(field(F.col("entry_"), f"$.{c}", "array<string>")).alias(c) for c in SCORE_LISTS]
    flags = [F.coalesce(lenient_json.coerce_bool(field(F.col("entry_"), f"$.{c}", "string"), F.lit(False)), F.lit(False)).alias(c) for c in SCORE_FLAGS]
    return rows.select(
        *batched.columns, F.least(F.lit(float(HIGHEST)), F.greatest(F.lit(float(LOWEST)), score)).alias("printworthy_score"), *texts, *lists, *flags, place.cast("int").alias("top_place")
    )


def batch_finalists(scores: DataFrame, batch_size: int, divisor: int) -> DataFrame:
    """The photos that their batches' answers call best, the first
    ``max(1, ceil(batch_size / divisor))`` of each, with rank."""
    return per_batch_top(scores.where(F.col("top_place").isNotNull()).withColumnRenamed("top_place", "rank"), batch_size, divisor)


def per_batch_top(ranked: DataFrame, batch_size: int, divisor: int, rank: str = "rank") -> DataFrame:
    """Finalists: of each batch the first ``max(1, ceil(batch_size/divisor))``
    by rank (from 1), counted from the configured size, also in a short batch."""
    return ranked.where(F.col(rank) <= max(1, -(-batch_size // divisor)))


def back_filled(scores: DataFrame, finalists: DataFrame, n: int, cap: int, name: str = "filename") -> DataFrame:
    """Finalists in their order and, only if fewer than ``n``, the best others
    by score (ties in insertion order ``ord``) up to ``cap``.

    ``finalists``: name and place; ``scores``: name, printworthy_score, ord.
    """
    count = finalists.count()
    own = finalists.select(name, F.col("place").cast("long").alias("final_place"))
    if count >= n:
        return own
    rest = scores.join(finalists.select(name), name, "left_anti").withColumn("low_", -F.col("printworthy_score"))
    placed = dense_place(rest.select(name, "low_", "ord"), ["low_", "ord"], "nth_").where(F.col("nth_") < max(0, cap - count))
    return own.unionByName(placed.select(name, (F.col("nth_") + 1 + count).cast("long").alias("final_place")))


def final_ranking(finalists: DataFrame, ranked: list[str] | Column, top: str | Column, n: int, key: list[str] = ()) -> DataFrame:
    """One row ``(ranked_filenames, top_filename)`` from a model's answer, or
    one for each value of ``key``, which then comes first.

    ``finalists`` has filename and final_place. Invented and repeated names go;
    if none is left the first ``n`` finalists stand. A top that is valid stays
    even if not ranked, else it is the first ranked. Answers are matched with
    names by hashes, so a key's work grows with its names, not their square.
    """
    def lit_list(x):
        return x if isinstance(x, Column) else F.array(*map(F.lit, x)).cast("array<string>")

    known = finalists.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("final_place", "filename"))), lambda x: x["filename"]).alias("names"))
    valid = F.slice(F.array_compact(F.array_intersect(lit_list(ranked), "names")), 1, n)  # distinct, in the answer's order
    chosen = F.when(F.size(valid) > 0, valid).otherwise(F.slice("names", 1, n))
    top_ = top if isinstance(top, Column) else F.lit(top).cast("string")
    return known.withColumn("ranked_filenames", chosen).select(
        *key, "ranked_filenames", F.when(F.array_contains("names", top_), top_).otherwise(F.get("ranked_filenames", F.lit(0))).alias("top_filename")
    )


def group_ranks(entrants: DataFrame, answers: DataFrame, limit: int) -> DataFrame:
    """Ranks (from 1) of ``entrants`` (group, filename, place) in their groups'
    answers ``(group, ranked array<string>)``.

    Invented and repeated names go, and names that an answer leaves out; a group
    of which no name is left stands in the order of its places. Of each group
    the first ``limit`` stay. No row holds more than one name.
    """
    said = answers.select("group", F.posexplode("ranked").alias("pos_", "filename")).groupBy("group", "filename").agg(F.min("pos_").alias("pos_"))
    w = W.partitionBy("group")  # as many names as a prompt holds
    found = entrants.join(said, ["group", "filename"], "left").withColumns({
        "rank": F.row_number().over(w.orderBy(F.col("pos_").asc_nulls_last(), "place")), "any_": F.max(F.col("pos_").isNotNull()).over(w),
    })
    return found.where((F.col("pos_").isNotNull() | ~F.col("any_")) & (F.col("rank") <= limit)).drop("pos_", "any_")


def group_tops(entrants: DataFrame, ranked: DataFrame, answers: DataFrame) -> DataFrame:
    """``(group, top_filename)``: the answer's ``top`` if it is in the group,
    ranked or not, else the first ranked."""
    first = ranked.where("rank = 1").select("group", F.col("filename").alias("first_"))
    asked = entrants.join(answers.select("group", F.col("top").alias("filename")), ["group", "filename"], "left_semi").select("group", F.col("filename").alias("asked_"))
    return first.join(asked, "group", "left").select("group", F.coalesce("asked_", "first_").alias("top_filename"))


def ranked_details(ranking: DataFrame, scores: DataFrame, reasons: DataFrame, name: str = "filename") -> DataFrame:
    """Ranked names of one list with their scores (inner) and final reasons (left; the last
    of repeated ones, by ``pos``)."""
    names = ranking.select(F.posexplode("ranked_filenames").alias("pos", name)).select((F.col("pos") + 1).alias("rank"), name)
    last = reasons.groupBy(name).agg(F.max_by("reason", "pos").alias("final_reason"))
    return names.join(scores, name).join(last, name, "left")


def review_ladder(images: DataFrame, max_side: int = 1600, quality: int = 84) -> DataFrame:
    """Rungs ``(step, side, quality)`` per image: sides shrink by 0.85 down to
    768 (and the image's own longest side if its shortest is under 768), at
    each side the quality falls by 6 down to 60."""
    sides, s = [], max_side
    while s >= 768:
        sides.append(s)
        s = int(s * 0.85)
    qualities = list(range(quality, 59, -6))
    fixed = F.array(*map(F.lit, sides)).cast("array<int>")
    own = F.when(F.least("width", "height") < 768, F.array(F.greatest("width", "height").cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = images.withColumn("sides_", F.concat(fixed, own)).select("*", F.posexplode("sides_").alias("si_", "side")).drop("sides_")
    rows = rows.select("*", F.posexplode(F.array(*map(F.lit, qualities))).alias("qi_", "quality"))
    return rows.withColumn("step", F.col("si_") * len(qualities) + F.col("qi_")).drop("si_", "qi_")


def first_fit(rungs: DataFrame, keys: list[str], size: str, limit: int) -> DataFrame:
    """Per image the first rung within ``limit`` bytes, else the last one."""
    best = F.min(F.when(F.col(size) <= limit, F.struct("step", "side", "quality", size)))
    last = F.max(F.struct("step", "side", "quality", size))
    return rungs.groupBy(*keys).agg(F.coalesce(best, last).alias("r")).select(*keys, "r.*")


def retry_sizes(batch_size: int) -> list[int]:
    """Smaller batch sizes to try when a ranking fails."""
    return [s for s in (6, 4) if s < batch_size] or [max(2, batch_size // 2)]
