"""Stage 2 as plans: families reduced to their quotas, survivors ranked in
batches, finalists ranked in rounds until one prompt holds them. Models are
asked through ``models.ask``; their answers are stored, so that no plan asks
twice."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lenient_json, prompts
from ..models import JsonModel, ModelError, ask, ask_once
from ..operators import tournament
from ..operators.tables import dense_place, stored


@dataclass(frozen=True)
class Stage2Config:
    family_divisor: int = 4
    portfolio_divisor: int = 4
    batch_size: int = 12
    wanted_families: tuple[int, ...] = ()
    most_families: int | None = None
    #: Most finalists of one prompt, in batches.
    final_batches: int = 4
    #: A failed call ends the stage instead of leaving its photos without scores.
    strict: bool = False
    #: A table of answers by model name: what it holds is not asked again.
    answers: str | None = None
    model: str = ""
    #: Calls a second of all tasks together, made by so many of them.
    per_second: float | None = None
    callers: int = 4

    @property
    def prompt_size(self) -> int:
        return max(2, self.batch_size * self.final_batches)


def _asked(requests: DataFrame, factory: Callable[[], JsonModel], label: str, c: Stage2Config) -> DataFrame:
    """``requests`` (with prompt) and their responses."""
    rows = requests if "images" in requests.columns else requests.withColumn("images", F.lit(None).cast("array<binary>"))
    if c.answers:
        said = ask_once(rows, factory, c.answers, c.model, per_second=c.per_second, callers=c.callers if c.per_second else None)
    else:
        said = ask(rows, factory, per_second=c.per_second, callers=c.callers)
    out = stored(said.drop("images"), label)
    if c.strict and (failed := out.where("error IS NOT NULL").select("error").first()):
        raise ModelError(f"{label}: {failed.error}")
    return out


def reduce_families(selected: DataFrame, factory: Callable[[], JsonModel], c: Stage2Config, dry_run: bool = False) -> DataFrame:
    """Decisions of every photo of ``selected`` (scene_family_id, filename): a
    family within its quota stays whole, of the others a model keeps some. A
    dry run asks no model and gives one row of counts instead."""
    photos = tournament.first_families(selected, list(c.wanted_families), c.most_families)
    plan = tournament.family_plan(photos.select("scene_family_id", "filename"), c.family_divisor)
    if dry_run:
        n = selected.agg(F.count(F.lit(1)).alias("input_selected_count"), F.count_distinct("scene_family_id").alias("family_count"))
        done = plan.agg(F.count_distinct("scene_family_id").alias("processed_family_count"), F.count_distinct(F.when(F.col("mode") == "model", F.col("scene_family_id"))).alias("model_family_count"))
        return n.crossJoin(done)  # one row each
    groups = plan.where("mode = 'model'").groupBy("scene_family_id").agg(F.sort_array(F.collect_list("filename")).alias("names"), F.max("keep_limit").alias("limit"))
    answers = _asked(groups.select("scene_family_id", prompts.family_prompt(F.col("names"), F.col("limit")).alias("prompt")), factory, "family-answers", c)
    v = lenient_json.from_free_text(F.col("response"))
    field = lenient_json.field
    answers = answers.select(
        "scene_family_id", field(v, "$.keep_filenames", "array<string>").alias("keep"), field(v, "$.primary_filename", "string").alias("primary"),
        field(v, "$.photos", "array<struct<filename:string,reason:string>>").alias("photos"),
    )
    return tournament.auto_decisions(plan).unionByName(tournament.model_decisions(plan, answers))


def rank_portfolio(survivors: DataFrame, factory: Callable[[], JsonModel], c: Stage2Config, dry_run: bool = False) -> DataFrame:
    """Ranked survivors with their scores and reasons: ``rank, filename``, the
    fields of ``photo_scores``, final_reason, print_prompt and top_filename.

    A survivor's batch scores it; the best of the batches, filled up by score
    if they are too few, are ranked by ``rank_finalists``. Raises ValueError if
    nothing survived. A dry run asks no model and gives one row of counts.
    """
    n = survivors.count()
    if not n:
        raise ValueError("no photo survived the family reduction")
    top_n, per_batch, batch_count = max(1, math.ceil(n / c.portfolio_divisor)), max(1, math.ceil(c.batch_size / c.portfolio_divisor)), math.ceil(n / c.batch_size)
    if dry_run:
        counts = {"input_survivor_count": n, "target_top_n": top_n, "top_per_batch": per_batch, "batch_count": batch_count}
        return survivors.sparkSession.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in counts.items()])
    batched = tournament.batches(survivors.select("filename"), c.batch_size)
    groups = batched.groupBy("batch").agg(F.sort_array(F.collect_list("filename")).alias("names"))
    answers = _asked(groups.select("batch", prompts.batch_prompt(F.col("names"), F.lit(per_batch)).alias("prompt")), factory, "batch-answers", c)
    scores = stored(tournament.photo_scores(batched, answers), "scores")
    best = tournament.batch_finalists(scores, c.batch_size, c.portfolio_divisor)
    placed = dense_place(best.select("filename", "batch", "rank"), ["batch", "rank"], "place").select("filename", F.col("place") + 1)
    finalists = tournament.back_filled(
        scores.select("filename", "printworthy_score", F.col("batch").cast("long") * c.batch_size + F.col("slot").alias("ord")), placed.toDF("filename", "place"), top_n, max(top_n, per_batch * batch_count)
    )
    ranking, top = rank_finalists(finalists, factory, top_n, c)
    details = ranking.join(scores.drop("batch", "slot", "top_place"), "filename")
    prompt = prompts.print_prompt(*[F.col(c) for c in ("enhancement_goal", "safe_edits", "conditional_edits", "avoid_edits", "risk_flags")])
    return details.withColumns({"print_prompt": prompt, "top_filename": F.lit(top)})


def rank_finalists(finalists: DataFrame, factory: Callable[[], JsonModel], top_n: int, c: Stage2Config) -> tuple[DataFrame, str | None]:
    """``rank, filename, final_reason`` of the first ``top_n`` of ``finalists``
    (filename, final_place), and the top file's name.

    Finalists that one prompt holds are ranked by one answer. More of them are
    ranked in groups of ``prompt_size`` by place; the first quarter of each
    group goes on, in the order of groups and ranks, until one prompt holds
    what is left. Whoever came farther ranks higher; of one round the ranks
    decide, then the groups. Names that an answer leaves out are dropped, as in
    the case of one prompt. A reason is that of a name's last answer.
    """
    size, later = c.prompt_size, []
    entrants = dense_place(finalists.select("filename", "final_place"), ["final_place"], "place").select("filename", "place")
    number, left = 0, entrants.count()
    while True:
        last = left <= size
        limit = top_n if last else size
        rows = entrants.withColumn("group", F.expr(f"place div {size}"))
        names = F.transform(F.array_sort(F.collect_list(F.struct("place", "filename"))), lambda x: x["filename"])
        groups = rows.groupBy("group").agg(names.alias("names")).select("group", prompts.final_prompt(F.col("names"), F.least(F.size("names"), F.lit(limit))).alias("prompt"))
        v, field = lenient_json.from_free_text(F.col("response")), lenient_json.field
        answers = _asked(groups, factory, f"final-answers-{number}", c).select(
            "group", F.coalesce(field(v, "$.ranked_filenames", "array<string>"), F.array().cast("array<string>")).alias("ranked"), field(v, "$.top_filename", "string").alias("top"),
            field(v, "$.reasons", "array<struct<filename:string,reason:string>>").alias("reasons"),
        )
        reasons = answers.select("group", F.posexplode("reasons").alias("pos", "r")).groupBy("group", F.col("r.filename").alias("filename")).agg(F.max_by("r.reason", "pos").alias("final_reason"))
        ranked = stored(tournament.group_ranks(rows, answers, limit).join(reasons, ["group", "filename"], "left").withColumn("back", F.lit(-number)), f"round-{number}")
        if last:
            break
        through = max(1, size // 4)
        later.append(ranked.where(F.col("rank") > through))
        entrants = dense_place(ranked.where(F.col("rank") <= through).select("filename", "group", "rank"), ["group", "rank"], "place_").select("filename", F.col("place_").alias("place"))
        number, left = number + 1, entrants.count()
    top = tournament.group_tops(rows, ranked, answers).first()  # one group
    every = ranked
    for other in later:
        every = every.unionByName(other)
    placed = dense_place(every.drop("place"), ["back", "rank", "group"], "nth")
    return placed.where(F.col("nth") < top_n).select((F.col("nth") + 1).cast("int").alias("rank"), "filename", "final_reason"), top and top.top_filename


def rank_with_smaller_batches(survivors: DataFrame, factory: Callable[[], JsonModel], c: Stage2Config) -> tuple[DataFrame, int]:
    """The ranked portfolio and the batch size that gave it: if a call of a
    ranking fails for good, smaller batches are tried. Raises what the last of
    them raised."""
    sizes = [c.batch_size, *tournament.retry_sizes(c.batch_size)]
    for size in sizes:
        try:
            return rank_portfolio(survivors, factory, replace(c, batch_size=size, strict=True)), size
        except ModelError:
            if size == sizes[-1]:
                raise


def run(selected: DataFrame, factory: Callable[[], JsonModel], c: Stage2Config = Stage2Config()) -> tuple[DataFrame, DataFrame]:
    """Family decisions and the ranked portfolio."""
    decisions = stored(reduce_families(selected, factory, c), "family-decisions")
    return decisions, rank_portfolio(tournament.survivors(decisions), factory, c)
