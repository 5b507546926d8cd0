"""Albums on a file system, logs, summaries and portfolios."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions import image_files, text
from ..operators.tables import shared_folder, stored
from ..sinks.files import write_files
from .listing import list_folders
from .paths import filesystem, same_path

# Accepted suffixes and names of generated folders.
SUFFIXES = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".webp", ".heic", ".heif")
JVM_SUFFIXES = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp")
GENERATED = ("Curated_Best", "Gemma_", "Stage2_")
LOG_COLUMNS = (
    "filename string, source_path string, extension string, resolution_tier string, status string, rejection_reason string, group_id int, group_size int, "
    "scene_family_id int, scene_family_size int, selected_in_group boolean, selected_filename string, selected_tier string, selected_saved_path string, decode_ok boolean, "
    "passed_resolution boolean, passed_opencv boolean, passed_clip boolean, megapixels double, laplacian_var double, black_clip_pct double, white_clip_pct double, "
    "singleton_group boolean, singleton_penalty_applied double, face_count int, background_face_count int, dominant_face_ratio double, passed_scene_check boolean, "
    "scene_flagged boolean, scene_penalty double, scene_rejection_reason string, clip_score double, quality_score double, matching_raw_found boolean, copied_raw_path string, saved_path string"
)


def is_generated(name: str, output_name: str) -> bool:
    return name == output_name or name.startswith(GENERATED)


def album_files(spark: SparkSession, root: str, output_name: str = "Curated_Best", images_only: bool = True) -> DataFrame:
    """``folder, path, name, suffix, length, modified`` of the files of the
    root and its direct subfolders, without generated ones."""
    files = list_folders(spark, root=root, skip=GENERATED)
    named = files.where((F.col("folder") == same_path(root)) | (F.element_at(F.split("folder", "/"), -1) != output_name))
    return named.where(F.col("suffix").isin(*SUFFIXES)) if images_only else named


def list_albums(spark: SparkSession, root: str, output_name: str = "Curated_Best") -> list[str]:
    """The root if it holds images, then its direct subfolders with images, by
    name, without generated ones."""
    found = album_files(spark, root, output_name).select("folder").distinct().orderBy("folder").collect()  # a row per album
    return [r.folder for r in found]


def list_files(spark: SparkSession, folders: list[str], images_only: bool = True) -> DataFrame:
    """The same listing of the files of given albums. Names that begin with
    ``_`` or ``.`` are files like others."""
    files = list_folders(spark, folders=folders)
    return files.where(F.col("suffix").isin(*SUFFIXES)) if images_only else files


def album_filter(files: DataFrame, output_name: str = "Curated_Best", depth: int = 1) -> DataFrame:
    """The same rules over a manifest with ``root``-relative paths ``rel``:
    accepted suffix, at most one folder deep, no generated folder."""
    folder = F.regexp_extract("rel", r"(?s)^(.*)/[^/]*$", 1)
    made = (folder == output_name)
    for p in GENERATED:
        made = made | folder.startswith(p)
    deep = F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit(""))) + (folder != "").cast("int")
    return files.where(text.suffix(F.col("rel")).isin(*SUFFIXES) & ~made & (deep <= depth))


def _hidden(name: Column) -> Column:
    return name.startswith("_") | name.startswith(".")


def _content(files: DataFrame, most: int | None, head: int | None = None) -> DataFrame:
    """``files`` with the bytes of each, or its first ``head``, read where the
    row is; null for what is longer than ``most`` or cannot be read."""
    at = files.columns.index("path")

    def bytes_of(path: str) -> bytes | None:
        fs, inner, _ = filesystem(path)
        try:
            with fs.open_input_file(inner) as file:
                return None if most is not None and file.size() > most else file.read(head)
        except OSError:
            return None

    def run(batches):
        for batch in batches:
            first, data, size = 0, [], 0
            for i, path in enumerate(batch.column(at).to_pylist()):
                data.append(bytes_of(path))
                size += len(data[-1] or b"")
                if size >= HELD or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, len(data)).columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "content"])
                    first, data, size = i + 1, [], 0

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("content", BinaryType())]))


def read_images(spark: SparkSession, files: DataFrame, upright: bool = True) -> DataFrame:
    """``files`` with the decoded ``image`` struct (BGR), turned upright by the
    orientation in a JPEG's header; width is -1 if a file cannot be decoded,
    null for suffixes that the JVM has no reader for, which need a decoder of
    one's own over ``read_bytes``.

    Spark reads albums as folders. It hides names that begin with ``_`` or
    ``.``; tasks copy such files to the shared folder under other names first.
    """
    files = stored(files, "files")
    known = files.where(F.col("suffix").isin(*JVM_SUFFIXES))
    folders = [r.folder for r in known.where(~_hidden(F.col("name"))).select("folder").distinct().collect()]  # a row per album
    kinds = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in JVM_SUFFIXES)
    found = None
    if folders:
        local = F.concat(F.lit("/"), F.regexp_replace("image.origin", "^file:/+", ""))
        origin = F.when(F.col("image.origin").startswith("file:"), local).otherwise(F.col("image.origin"))
        found = spark.read.format("image").option("pathGlobFilter", f"*{{{kinds}}}").load([_plain(f) for f in folders]).select(origin.alias("path"), "image")
    hidden = known.where(_hidden(F.col("name")))
    if not hidden.isEmpty():
        staging = f"{shared_folder(spark).rstrip('/')}/hidden-{uuid.uuid4().hex}"
        other = F.concat(F.sha2("path", 256), "suffix")
        write_files(hidden, staging, other, source=F.col("path"))
        images = spark.read.format("image").load(staging).select(F.element_at(F.split("image.origin", "/"), -1).alias("link"), "image")
        copied = hidden.select("path", other.alias("link")).join(images, "link").select("path", "image")
        found = copied if found is None else found.unionByName(copied)
    if found is None:
        found = spark.createDataFrame([], "path string, image " + IMAGE)
    out = files.join(found, "path", "left")
    if not upright:
        return out
    turned = _orientations(files.where(F.col("suffix").isin(".jpg", ".jpeg")).select("path")).where("orientation > 1")
    return out.join(turned, "path", "left").withColumn("image", F.when(F.col("orientation").isNull(), F.col("image")).otherwise(image_files.upright(F.col("image"), F.col("orientation")))).drop("orientation")


IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
#: Bytes of files that a reading task holds before it hands them on.
HELD = 1 << 20
#: Bytes of a file in which the blocks before its picture are looked for.
HEAD = 256 << 10


def _plain(path: str) -> str:
    """A folder as a pattern that names it alone."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def _orientations(files: DataFrame) -> DataFrame:
    """``(path, orientation)`` from the headers of JPEG files."""
    return _content(files, None, HEAD).select("path", image_files.orientation(F.col("content")).alias("orientation"))


def read_bytes(spark: SparkSession, files: DataFrame, most: int | None = None) -> DataFrame:
    """``files`` with content and length; of files longer than ``most`` both
    are null. Files of one folder, listed by one task, are dealt out by path to
    be read."""
    kept = files.select(*[c for c in files.columns if c not in ("content", "length")])
    kept = kept.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return _content(kept, most).withColumn("length", F.octet_length("content").cast("long"))


def decode_bytes(rows: DataFrame, decoder=image_files.decode, keep: list[str] = ("path",)) -> DataFrame:
    """``keep`` plus an image struct from ``content`` by a decoder (bytes -> BGR
    array or None), for formats the JVM lacks."""
    import pandas as pd

    types = dict(rows.dtypes)
    fields = ", ".join(f"`{k}` {types[k]}" for k in keep) + ", height int, width int, nChannels int, data binary"

    def run(frames):
        for frame in frames:
            got = [decoder(c) if c is not None else None for c in frame["content"]]
            shape = [(-1, -1, -1, b"") if g is None else (*g.shape[:2], g.shape[2], g.tobytes()) for g in got]
            yield pd.concat([frame[list(keep)].reset_index(drop=True), pd.DataFrame(shape, columns=["height", "width", "nChannels", "data"])], axis=1)

    out = rows.select(*keep, "content").mapInPandas(run, fields)
    return out.select(*keep, F.struct("height", "width", "nChannels", "data").alias("image"))


def read_selection_log(spark: SparkSession, path: str, selected_only: bool = True) -> DataFrame:
    """A decision log; by default the selected rows."""
    log = spark.read.csv(path, schema=LOG_COLUMNS, header=True, escape='"', multiLine=True)
    return log.where("status = 'selected'") if selected_only else log


def read_summary(spark: SparkSession, folder: str) -> DataFrame | None:
    """A portfolio's JSON summary, or None if it has none."""
    path = Path(folder) / "portfolio_summary.json"
    return spark.read.json(str(path), multiLine=True) if path.is_file() else None


#: Names of portfolio folders.
PORTFOLIOS = ("Stage2_PortfolioTop*", "*Stage2*PortfolioTop*", "*printplans*")


def resolve_portfolio(arg: str | None = None, env: dict | None = None, cwd: str | None = None, roots: list[str] = (), variable: str = "PORTFOLIO_DIR") -> str | None:
    """A folder with a ``ranked`` subfolder: the argument (which must be one),
    the environment, the working folder; else the latest changed of the first
    of these that has any: folders with a portfolio's name in the working
    folder and its parent, subfolders of the working folder, named folders in
    the albums of ``roots``."""
    def is_one(p: Path) -> bool:
        return (p / "ranked").is_dir()

    env, here = (os.environ if env is None else env), Path(cwd or os.getcwd()).resolve()
    if arg:
        if not is_one(Path(arg)):
            raise FileNotFoundError(f"{arg} has no ranked folder")
        return str(Path(arg).resolve())
    named = env.get(variable, "").strip()
    for p in ([Path(named)] if named else []) + [here]:
        if is_one(p):
            return str(p.resolve())
    places = (
        (p for base in (here, here.parent) for pattern in PORTFOLIOS for p in base.glob(pattern)),
        here.iterdir(),
        (p for root in map(Path, roots) if root.is_dir() for p in root.glob("*/" + PORTFOLIOS[0])),
    )
    for place in places:
        if found := {p.resolve() for p in place if p.is_dir() and is_one(p)}:
            return str(max(found, key=lambda p: (p.stat().st_mtime, str(p))))
    return None


def read_ranked(spark: SparkSession, portfolio: str) -> DataFrame:
    """``filename, path`` of a portfolio's ranked images."""
    return list_files(spark, [f"{portfolio.rstrip('/')}/ranked"], images_only=False).select(F.col("name").alias("filename"), "path")
