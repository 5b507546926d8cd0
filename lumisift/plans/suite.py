"""All models over the selected photos of albums, with every document written."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..models import JsonModel, ModelError
from ..operators import tournament
from ..operators.tables import stored
from ..sinks import outputs
from ..sources import albums
from . import stage2


def selected_photos(spark: SparkSession, logs: list[str]) -> DataFrame:
    """The selected rows of albums' logs."""
    out = None
    for log in logs:  # a path per album
        rows = albums.read_selection_log(spark, log)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no log is given")
    return out


def run_model(selected: DataFrame, factory: Callable[[], JsonModel], folder: str, c: stage2.Stage2Config) -> dict:
    """Reduce families, rank what is left, and write a model's documents to
    ``folder``: a document per family and their table and summary, the ranked
    photos and their summary, and copies of the ranked files. Smaller batches
    are tried if a ranking fails. Returns counts."""
    began = time.monotonic()
    decisions = stored(stage2.reduce_families(selected, factory, c), "family-decisions")
    known = selected.select("scene_family_id", "filename", "strict_group_id" if "strict_group_id" in selected.columns else F.col("group_id").alias("strict_group_id"), F.col("group_size").alias("strict_group_size"), F.col("source_path").alias("stage1_path"))
    plan = tournament.family_plan(selected.select("scene_family_id", "filename"), c.family_divisor).select("scene_family_id", "filename", F.col("input_count").alias("family_input_count"), F.col("keep_limit").alias("family_keep_limit"))
    full = stored(decisions.join(known, ["scene_family_id", "filename"]).join(plan, ["scene_family_id", "filename"]), "families")
    per = full.groupBy("scene_family_id").agg(F.count(F.lit(1)).alias("input_count"), F.max("family_keep_limit").alias("keep_limit"), F.array_sort(F.collect_list(F.struct("filename", "kept", "is_primary", "reason"))).alias("photos"))
    outputs.write_documents(outputs.family_documents(per), f"{folder}/families")
    outputs.write_family_csv(full.withColumnsRenamed({"kept": "kept_after_family_reduction", "is_primary": "primary_in_family"}), f"{folder}/families_csv")
    outputs.write_lines(outputs.family_summary(full), f"{folder}/family_summary")
    survivors = tournament.survivors(decisions)
    ranked, size = stage2.rank_with_smaller_batches(survivors, factory, c)
    ranked = stored(ranked, "ranked")
    outputs.write_lines(outputs.portfolio_summary(ranked, {**asdict(c), "batch_size": size}), f"{folder}/portfolio_summary")
    files = ranked.join(selected.select("filename", F.col("source_path").alias("path")).dropDuplicates(["filename"]), "filename")
    outputs.copy_files(outputs.ranked_manifest(files, f"{folder}/ranked", max(2, len(str(ranked.count())))), f"{folder}/ranked")
    top = ranked.select("top_filename").first()
    return {"families": per.count(), "survivors": survivors.count(), "ranked": ranked.count(), "top_filename": top and top.top_filename, "batch_size": size, "seconds": round(time.monotonic() - began, 3), "error": None}


def run_suite(selected: DataFrame, models: dict[str, Callable[[], JsonModel]], folder: str, c: stage2.Stage2Config = stage2.Stage2Config(), answers: str | None = None) -> DataFrame:
    """Every model in turn (a short list), each in a folder of its slug, and a
    summary of all. A model that fails is recorded and the next one runs.
    ``answers`` keeps what models said, so that a run that is begun again asks
    only what is missing. Returns one row per model."""
    spark, rows = selected.sparkSession, []
    for name, factory in models.items():
        place = f"{folder.rstrip('/')}/{spark.range(1).select(text.slug(F.lit(name))).first()[0]}"
        try:
            rows.append({"model": name, **run_model(selected, factory, place, replace(c, strict=True, answers=answers, model=name))})
        except (ModelError, ValueError) as error:
            rows.append({"model": name, "families": None, "survivors": None, "ranked": None, "top_filename": None, "batch_size": None, "seconds": None, "error": str(error)})
    runs = spark.createDataFrame(rows, "model string, families long, survivors long, ranked long, top_filename string, batch_size long, seconds double, error string")
    outputs.write_documents(outputs.suite_summary(runs, asdict(c)).select(F.lit("suite_summary.json").alias("name"), "json"), folder)
    return runs
