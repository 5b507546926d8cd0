"""Logs, reports and copies."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import CurationConfig
from ..functions import text
from ..operators import selection
from ..sources.albums import LOG_COLUMNS
from . import files

REMOTE_COLUMNS = ("file_id", "filename", "megapixels", "laplacian_var", "black_clip_pct", "white_clip_pct", "clip_score", "saved_path")
FAMILY_COLUMNS = ("scene_family_id", "filename", "kept_after_family_reduction", "primary_in_family", "family_input_count", "family_keep_limit", "strict_group_id", "strict_group_size", "stage1_path", "reason")
#: Decimals of the log's numbers.
DECIMALS = {c: 2 for c in ("megapixels", "laplacian_var", "black_clip_pct", "white_clip_pct")} | {c: 4 for c in ("dominant_face_ratio", "scene_penalty", "clip_score", "quality_score")}
#: Values of fields that were never set.
SENTINELS = {"string": "", "int": 0, "double": 0.0, "boolean": False}


def log_rows(log: DataFrame) -> DataFrame:
    """The 36 log columns in order, unset fields as their sentinels."""
    out = []
    for part in LOG_COLUMNS.split(", "):
        name, kind = part.split()
        value = F.col(name) if name in log.columns else F.lit(None)
        default = True if name == "passed_scene_check" else "pending" if name == "status" else SENTINELS[kind]
        out.append(F.coalesce(value.cast(kind), F.lit(default)).alias(name))
    return log.select(*out)


def csv_text(value: Column, kind: str, decimals: int | None) -> Column:
    """Booleans as ``True``, numbers without exponent or padding zeros."""
    if kind == "boolean":
        return F.initcap(value.cast("string"))
    if kind == "double":
        digits = F.bround(value, decimals) if decimals is not None else value
        plain = F.regexp_replace(F.format_string(f"%.{decimals if decimals is not None else 6}f", digits), r"0+$", "")
        return F.regexp_replace(plain, r"\.$", ".0")
    return value.cast("string")


def _csv(rows: DataFrame, path: str, order: list[str], counted: Observation | None = None) -> None:
    """One sorted file; ``counted`` counts its rows as they are written."""
    kinds = dict(rows.dtypes)
    placed = rows.orderBy(*order).coalesce(1)  # behind the sort's exchange, whose sample would count rows twice
    if counted is not None:
        placed = placed.observe(counted, *selection.counters())
    out = placed.select(*[csv_text(F.col(c), kinds[c], DECIMALS.get(c)).alias(c) for c in rows.columns])
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").option("lineSep", "\r\n").csv(path)


def write_selection_log(log: DataFrame, path: str) -> dict:
    """One album's log, every scanned image, by file name; an album without
    candidates has one too. Returns the run's counters, taken while the log is
    written."""
    counted = Observation("run")
    _csv(log_rows(log), path, ["filename"], counted)
    return counted.get


def write_remote_log(records: DataFrame, path: str) -> bool:
    """The eight columns of a remote run; nothing is written without records."""
    if records.isEmpty():
        return False
    _csv(records.select(*REMOTE_COLUMNS), path, ["filename"])
    return True


def write_family_csv(rows: DataFrame, path: str) -> None:
    _csv(rows.select(*FAMILY_COLUMNS), path, ["scene_family_id", "filename"])


def tier_dir(tier: Column, c: CurationConfig) -> Column:
    return F.when(tier == "above_8mp", c.high_dir).otherwise(c.medium_dir)


def copy_manifest(winners: DataFrame, out_root: str, c: CurationConfig) -> DataFrame:
    """``(src, dst)`` of winners by tier, and of their raw companions."""
    base = F.concat(F.lit(out_root.rstrip("/") + "/"), tier_dir(F.col("tier"), c), F.lit("/"))
    jpeg = winners.select(F.col("path").alias("src"), F.concat(base, "filename").alias("dst"))
    raw = winners.where("raw_path IS NOT NULL").select(F.col("raw_path").alias("src"), F.concat(base, F.element_at(F.split("raw_path", "/"), -1)).alias("dst"))
    return jpeg.unionByName(raw)


def ranked_manifest(ranked: DataFrame, out_root: str, width: int = 2) -> DataFrame:
    """Copies whose names begin with their padded rank."""
    return ranked.select(F.col("path").alias("src"), F.concat(F.lit(out_root.rstrip("/") + "/"), F.lpad(F.col("rank").cast("string"), width, "0"), F.lit("_"), "filename").alias("dst"))


def copy_files(manifest: DataFrame, out_root: str) -> None:
    """Copy ``src`` to ``dst`` below ``out_root``, all files or none, replacing
    what is there."""
    files.write_files(manifest, out_root, files.below(out_root, F.col("dst")), source=F.col("src"))


def write_bytes(rows: DataFrame, folder: str, name: str = "out_name", content: str = "content") -> None:
    """Downloaded or generated files under their names; rows without content
    have no file."""
    files.write_files(rows, folder, F.col(name), content=F.col(content))


def json_rows(rows: DataFrame, key: Column) -> DataFrame:
    """``(name, json)`` documents, null fields kept."""
    return rows.select(key.alias("name"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def family_documents(families: DataFrame) -> DataFrame:
    return json_rows(families, F.format_string("family_%04d.json", "scene_family_id"))


def batch_documents(batches: DataFrame) -> DataFrame:
    return json_rows(batches, F.format_string("batch_%02d.json", "batch"))


def improvement_documents(images: DataFrame) -> DataFrame:
    return json_rows(images, F.concat(text.stem(F.col("filename")), F.lit(".json")))


def document_lines(head: DataFrame, lists: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``(part, place, line)`` of one JSON document, a line at a time: the fields
    of ``head`` (one row) and, by name, lists of ``(rows, order)``, whose items
    are rows in the order of a column of whole numbers. No row holds more than
    one item, however long the lists are."""
    whole = {"ignoreNullFields": "false"}
    fields = F.to_json(F.struct("*"), whole)
    zero = F.lit(0).cast("long")
    out = head.select(fields.alias("j")).select(F.lit(0).alias("part"), zero.alias("place"), F.expr("substring(j, 1, length(j) - 1)").alias("line"))
    one = head.select(F.lit(1).alias("one_")).limit(1)
    part = 1
    for i, (name, (rows, order)) in enumerate(lists.items()):
        begin = ("" if i == 0 else "]") + ("," if head.columns or i else "") + json.dumps(name) + ":["
        out = out.unionByName(one.select(F.lit(part).alias("part"), zero.alias("place"), F.lit(begin).alias("line")))
        first = rows.agg(F.min(order).alias("first_"))
        items = rows.crossJoin(F.broadcast(first)).select(F.col(order).cast("long").alias("place"), F.concat(F.when(F.col(order) == F.col("first_"), "").otherwise(","), F.to_json(F.struct(*rows.columns), whole)).alias("line"))  # one row of one number
        out = out.unionByName(items.select(F.lit(part + 1).alias("part"), "place", "line"))
        part += 2
    return out.unionByName(one.select(F.lit(part).alias("part"), zero.alias("place"), F.lit("]}" if lists else "}").alias("line")))


def write_lines(lines: DataFrame, path: str) -> None:
    """A document of ``document_lines`` as one file, row by row."""
    lines.orderBy("part", "place").select("line").coalesce(1).write.mode("overwrite").text(path)


def family_summary(decisions: DataFrame, family: str = "scene_family_id") -> DataFrame:
    """Lines of a document of counts and the decisions of every family, one
    family a line."""
    per = decisions.groupBy(family).agg(
        F.count(F.lit(1)).alias("input_count"), F.count_if("kept").alias("kept_count"),
        F.sort_array(F.collect_set("strict_group_id")).alias("strict_group_ids"),
        F.array_sort(F.collect_list(F.struct("filename", "kept", "is_primary", "reason"))).alias("photos"),
    )
    counts = per.agg(F.count(F.lit(1)).alias("family_count"), F.coalesce(F.sum("input_count"), F.lit(0)).alias("input_count"), F.coalesce(F.sum("kept_count"), F.lit(0)).alias("survivor_count"))
    return document_lines(counts, {"families": (per, family)})


def portfolio_summary(details: DataFrame, settings: dict) -> DataFrame:
    """Lines of a document of the settings, the top file, and the ranking with
    its details, one photo a line."""
    top = details.agg(F.max("top_filename").alias("top_filename"), F.count(F.lit(1)).alias("ranked_count"))
    head = top.select(F.lit(json.dumps(settings)).alias("settings"), "*")
    return document_lines(head, {"ranked_details": (details.drop("top_filename"), "rank")})


def suite_summary(runs: DataFrame, settings: dict) -> DataFrame:
    """One JSON row over the runs of all models, a few."""
    doc = runs.agg(F.array_sort(F.collect_list(F.struct("model", *[c for c in runs.columns if c != "model"]))).alias("runs"))
    return doc.select(F.to_json(F.struct(F.lit(json.dumps(settings)).alias("settings"), F.current_timestamp().cast("string").alias("generated_at"), "runs"), {"ignoreNullFields": "false"}).alias("json"))


def improvement_summary(images: DataFrame, key: list[str] = ()) -> DataFrame:
    """Counts of a run, or of each value of ``key``; skipped images count as
    completed."""
    return images.groupBy(*key).agg(F.count_if(F.col("error").isNull()).alias("completed_count"), F.count_if(F.col("error").isNotNull()).alias("failure_count"))


def write_documents(docs: DataFrame, folder: str) -> None:
    """Documents ``(name, json)`` as files, all or none. They are dealt out by
    name, as one small part of a table may hold very many."""
    dealt = docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name")
    files.write_files(dealt, folder, F.col("name"), content=F.encode("json", "UTF-8"))


def exit_status(records: int, failures: int = 0) -> int:
    """0 if there is a record and no failure."""
    return int(records == 0 or failures > 0)
