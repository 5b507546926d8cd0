"""Joins of the selection with companions, details and existing output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text


def raw_companions(winners: DataFrame, files: DataFrame) -> DataFrame:
    """Left join of JPEG and PNG winners with a raw file of the same folder and
    stem; ``.RAF`` is preferred to ``.raf``. Adds raw_path."""
    raws = files.where(F.col("name").rlike(r"\.(RAF|raf)$")).select(F.col("folder").alias("f_"), text.stem(F.col("name")).alias("s_"), "name", F.col("path").alias("raw_path"))
    raws = raws.groupBy("f_", "s_").agg(F.min_by("raw_path", "name").alias("raw_path"))  # upper case sorts first
    on = (winners["folder"] == raws["f_"]) & (text.stem(winners["filename"]) == raws["s_"]) & text.suffix(winners["filename"]).isin(".jpg", ".jpeg", ".png")
    return winners.join(raws, on, "left").drop("f_", "s_")


def with_details(ranked: DataFrame, details: DataFrame, name: str = "filename") -> DataFrame:
    """Ranked files with the detail of the file name behind the rank prefix; of
    repeated details the last (by ``pos``)."""
    w = W.partitionBy(name).orderBy(F.desc("pos"))
    last = details.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_", "pos").withColumnRenamed(name, "d_")
    return ranked.withColumn("k_", text.strip_rank(F.col(name))).join(last, F.col("k_") == F.col("d_"), "left").drop("k_", "d_")


def skip_existing(images: DataFrame, existing: DataFrame, overwrite: bool = False, name: str = "filename") -> DataFrame:
    """Images whose stem no output has yet, decided before any model call."""
    if overwrite:
        return images
    done = existing.select(text.stem(F.col(name)).alias("done_")).distinct()
    return images.join(done, text.stem(images[name]) == F.col("done_"), "left_anti")


def rank_slice(images: DataFrame, start_rank: int = 1, limit: int | None = None, name: str = "filename") -> DataFrame:
    """Ranked image files from a rank on, by name."""
    if start_rank < 1:
        raise ValueError("ranks start at 1")
    rows = images.where(text.suffix(F.col(name)).isin(".jpg", ".jpeg", ".png", ".webp", ".heic", ".heif")).orderBy(name).offset(start_rank - 1)
    return rows if limit is None else rows.limit(limit)


def collision_names(files: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """Adds out_name: later files of a name get a number."""
    n = F.row_number().over(W.partitionBy(name).orderBy(order))
    return files.withColumn("out_name", text.numbered_name(F.col(name), n))


def check_answer(answers: DataFrame, pick: str = "best_filename", names: str = "names") -> DataFrame:
    """Fails the query if a model picked a name that it was not given."""
    ok = F.array_contains(names, F.col(pick))
    said: Column = F.concat(F.lit("picked an unknown file: "), F.coalesce(F.col(pick), F.lit("null")))
    return answers.withColumn(pick, F.when(ok, F.col(pick)).otherwise(F.raise_error(said)))


def model_runs(families: DataFrame, models: list[str]) -> DataFrame:
    """Every family under every model of a short list, with the model's slug."""
    spec = F.array(*[F.lit(m) for m in models])
    return families.withColumn("model", F.explode(spec)).withColumn("model_slug", text.slug(F.col("model")))
