"""Files in, files out: albums, remote listings, logs, copies, models, streams."""

import csv
import json
import struct
import zlib
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift import models
from lumisift.config import CurationConfig
from lumisift.functions import pixels
from lumisift.plans import stage1
from lumisift.sinks import outputs
from lumisift.sources import albums, remote
from lumisift.streaming import ingest

from tests import fakes


def png(path: Path, img: np.ndarray) -> None:
    """An RGB picture as a PNG file."""
    h, w, _ = img.shape
    raw = b"".join(b"\0" + img[y].tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("albums")
    rng = np.random.default_rng(3)
    for d in ("trip", "Stage2_x", "Curated_Best", "empty"):
        (top / d).mkdir()
    base = rng.integers(0, 255, (40, 50, 3), np.uint8)
    for name in ("_DSC0001.png", "_DSC0002.png", ".hid3.png"):
        png(top / "trip" / name, base)
    png(top / "trip" / "UP4.PNG", rng.integers(0, 255, (40, 50, 3), np.uint8))
    (top / "trip" / "bad5.jpg").write_bytes(b"nothing")
    (top / "trip" / "note.txt").write_text("x")
    png(top / "Stage2_x" / "a.png", base)
    png(top / "top.png", base)
    return str(top)


def test_albums_and_hidden_names(spark, root):
    found = albums.list_albums(spark, root)
    assert [Path(f).name for f in found] == [Path(root).name, "trip"]
    files = albums.list_files(spark, found)
    assert files.count() == 6
    images = {r.name: r.image for r in albums.read_images(spark, files).collect()}
    assert images["_DSC0001.png"].width == 50 and images[".hid3.png"].height == 40 and images["bad5.jpg"].width == -1
    sizes = {r.name: r.length for r in albums.read_bytes(spark, files, most=100).collect()}
    assert sizes["bad5.jpg"] == 7 and sizes["top.png"] is None


def test_stage1_from_files_to_log(spark, root, tmp_path):
    c = replace(CurationConfig(), min_megapixels=0.001, medium_min_megapixels=0.0005, singleton_min_quality=-9.0, black_clip_pct=99.0, white_clip_pct=99.0)
    files = albums.list_files(spark, [f"{root}/trip"])
    rows = albums.read_images(spark, files).withColumn("m", pixels.measure(F.col("image")))
    photos = rows.select(
        "folder", "path", F.col("name").alias("filename"), (F.col("image.width") > 0).alias("decode_ok"), F.when(F.col("image.width") > 0, F.col("image.width")).alias("width"),
        F.when(F.col("image.height") > 0, F.col("image.height")).alias("height"), "m.laplacian_var", "m.black_clip_pct", "m.white_clip_pct", "m.img_vector", "m.color_thumb", F.lit(0).cast("long").alias("hash"),
    )
    log = stage1.curate(photos, c).cache()
    by = {r.filename: r for r in log.collect()}
    assert by["bad5.jpg"].rejection_reason == "decode_failed"
    assert by["_DSC0001.png"].status == "selected" and by["_DSC0002.png"].rejection_reason == "similar_to_selected:_DSC0001.png"
    assert by["UP4.PNG"].status == "selected"
    outputs.write_selection_log(log, str(tmp_path / "log"))
    part = next((tmp_path / "log").glob("part-*.csv"))
    text = part.read_bytes().decode()
    assert text.count("\r\n") == 6
    table = list(csv.DictReader(text.splitlines()))
    assert [r["filename"] for r in table] == sorted(by) and len(table[0]) == 36 and table[0]["decode_ok"] in ("True", "False")
    again = albums.read_selection_log(spark, str(tmp_path / "log"))
    assert again.count() == log.where("status = 'selected'").count()
    stats = outputs_stats(log)
    assert stats == (5, 1, 0)


def outputs_stats(log):
    from lumisift.operators.selection import run_stats

    r = run_stats(log.withColumn("passed_resolution", F.col("decode_ok"))).first()
    return r.total_listed, r.decode_failures, r.rejected_resolution


def test_csv_numbers(spark):
    rows = spark.createDataFrame([(True, 0.0003, 2.5, 0.0)], "a boolean, b double, c double, d double")
    got = rows.select(outputs.csv_text(F.col("a"), "boolean", None), outputs.csv_text(F.col("b"), "double", 4), outputs.csv_text(F.col("c"), "double", 2), outputs.csv_text(F.col("d"), "double", 4)).first()
    assert tuple(got) == ("True", "0.0003", "2.5", "0.0")


def test_copies_and_documents(spark, root, tmp_path):
    won = spark.createDataFrame([(f"{root}/top.png", "top.png", "above_8mp", None), (f"{root}/trip/UP4.PNG", "UP4.PNG", "x", f"{root}/trip/note.txt")], "path string, filename string, tier string, raw_path string")
    outputs.copy_files(outputs.copy_manifest(won, str(tmp_path / "out"), CurationConfig()), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("*/*")) == ["UP4.PNG", "note.txt", "top.png"]
    ranked = outputs.ranked_manifest(won.withColumn("rank", F.lit(3)), str(tmp_path / "r"))
    assert {Path(r.dst).name for r in ranked.collect()} == {"03_top.png", "03_UP4.PNG"}
    decisions = spark.createDataFrame([(1, "a", True, True, "r", 7), (1, "b", False, False, "", 7)], "scene_family_id int, filename string, kept boolean, is_primary boolean, reason string, strict_group_id int")
    outputs.write_lines(outputs.family_summary(decisions), str(tmp_path / "families"))
    doc = json.loads("".join(p.read_text() for p in (tmp_path / "families").glob("part-*")))
    assert (doc["family_count"], doc["survivor_count"], doc["families"][0]["strict_group_ids"]) == (1, 1, [7])
    outputs.write_documents(outputs.family_documents(decisions.limit(1)), str(tmp_path / "docs"))
    assert json.loads((tmp_path / "docs" / "family_0001.json").read_text())["filename"] == "a"
    assert not outputs.write_remote_log(spark.createDataFrame([], "file_id string"), str(tmp_path / "no"))
    assert outputs.exit_status(0) == 1 and outputs.exit_status(3) == 0 and outputs.exit_status(3, 1) == 1


def test_remote_source(spark):
    remote.register(spark)
    load = lambda **o: spark.read.format("remote_images").options(folder_id="x", client="tests.fakes:SampleClient", page_size="4", **o).load()
    rows = {r.file_id: r for r in load(min_pixels="2000000").collect()}
    want = {f["file_id"] for f in fakes.SampleClient.files if f["mime_type"] in remote.MIME_TYPES and f["width"] and f["width"] * f["height"] >= 2_000_000}
    assert set(rows) == want and rows["id6"].megapixels == round(2800 * 2200 / 1e6, 2)
    assert load(content="true").where("file_id = 'id9'").first().content == b"id9"
    assert load().where("mime_type = 'image/gif'").count() == 0


def test_models(spark):
    rows = spark.createDataFrame([("Rank: a.jpg, b.jpg", [b"1"])], "prompt string, images array<binary>")
    got = json.loads(models.ask(rows, fakes.FakeJsonModel).first().response)
    assert set(got["ranked_filenames"]) == {"a.jpg", "b.jpg"}
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise models.ModelError("busy", 503)
        return "ok"

    waits = []
    assert models.with_retry(flaky, wait=waits.append) == "ok" and waits == [1.5, 3.0]
    with pytest.raises(models.ModelError):
        models.with_retry(lambda: (_ for _ in ()).throw(models.ModelError("no", 404)), wait=waits.append)

    def no_json(prompt, images, schema):
        if schema:
            raise models.ModelError("JSON mode is not enabled", 400)
        return "plain"

    assert models.json_call(no_json, "p", [], {"type": "object"}) == "plain"
    group = spark.createDataFrame([(1, "a", b""), (1, "b", b"")], "group_id int, filename string, content binary")
    assert models.pick_one(group, fakes.FakeJsonModel).first().best_filename in ("a", "b")
    made = models.improve(spark.createDataFrame([("p", b"x", "1:1")], "prompt string, content binary, aspect string"), fakes.FakeImageModel).first()
    assert (made.mime, bytes(made.output), made.error) == ("image/png", b"x", None)
    assert models.probe(fakes.FakeEmbedder) and not models.probe(lambda: 1 / 0)
    assert models.resolve_project("p") == "p" and models.resolve_project(env={"GCLOUD_PROJECT": "q"}) == "q" and models.resolve_project(env={}) is None
    assert models.stage2_command("s.py", "m", 4, 4, 12, 9, resume_family_dir="d")[2:4] == ["--resume-family-dir", "d"]


def test_faces_and_embeddings(spark, root):
    images = albums.read_images(spark, albums.list_files(spark, [root]))

    class Detector:
        def __call__(self, img):
            return [(0, 0, img.shape[1] // 2, img.shape[0] // 2)]

    r = models.detect_faces(images, Detector, ["path"]).first()
    assert (r.faces[0].w, r.image_h) == (25, 40)
    v = models.embed_images(images, fakes.FakeEmbedder, ["path"]).first().clip_vector
    assert abs(sum(x * x for x in v) - 1) < 1e-9


def test_portfolios(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name / "ranked").mkdir(parents=True)
    (tmp_path / "two" / "portfolio_summary.json").write_text('{"a": 1}')
    assert albums.resolve_portfolio(str(tmp_path / "one")) == str(tmp_path / "one")
    assert albums.resolve_portfolio(env={"PORTFOLIO_DIR": str(tmp_path / "two")}, cwd=str(tmp_path)) == str(tmp_path / "two")
    assert albums.resolve_portfolio(env={}, cwd=str(tmp_path)) in (str(tmp_path / "one"), str(tmp_path / "two"))
    with pytest.raises(FileNotFoundError):
        albums.resolve_portfolio(str(tmp_path))
    assert albums.read_summary(spark, str(tmp_path / "one")) is None and albums.read_summary(spark, str(tmp_path / "two")).first().a == 1
    with pytest.raises(ValueError):
        CurationConfig().check_source()


def test_stream_recomputes_touched_albums(spark, tmp_path):
    src, store, log = (str(tmp_path / n) for n in ("src", "store", "log"))
    spark.createDataFrame([("007", 1), ("12", 2)], "folder string, v int").write.parquet(src)
    curate = lambda df: df.groupBy(F.concat("folder", F.lit("")).alias("folder")).agg(F.sum("v").alias("total"))

    def go():
        stream = spark.readStream.schema("folder string, v int").parquet(src)
        ingest.curate_stream(stream, store, log, str(tmp_path / "ck"), curate).awaitTermination(120)
        return {r.folder: r.total for r in spark.read.schema("folder string, total long").parquet(log).collect()}

    assert go() == {"007": 1, "12": 2}
    spark.createDataFrame([("007", 10)], "folder string, v int").write.mode("append").parquet(src)
    assert go() == {"007": 11, "12": 2}


def test_a_listing_reads_each_row_group_once(spark, tmp_path, monkeypatch):
    """The plan keeps tokens of pages, not their files, and a page reads no more
    of the stand-in's table than the row group it lies in."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from lumisift.plans import stand_in

    (tmp_path / "part.parquet").mkdir()
    for i in range(2):
        keys = list(range(1000 * i, 1000 * i + 1000))
        pq.write_table(pa.table({"p_partkey": keys, "p_name": [f"n{k}" for k in keys], "p_size": [k % 50 for k in keys]}), tmp_path / f"part.parquet/{i}.parquet", row_group_size=300)
    reads = []
    whole = pq.ParquetFile.read_row_group
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", lambda self, i, **k: reads.append(i) or whole(self, i, **k))
    monkeypatch.setattr(pq, "read_table", None)
    given = {"folder_id": str(tmp_path), "client": "lumisift.plans.stand_in:PartListing", "page_size": "7"}
    parts = remote._Reader(given).partitions()
    assert reads == [0, 1, 2, 3] * 2
    assert len(parts) <= remote.TASKS and all(isinstance(token, str | None) and n <= 7 for p in parts for token, n in p.value)
    rows = [r for p in parts for r in remote._Reader(given).read(p)]
    want = {f"id{k}" for k in range(2000) if k % 3 and k % 50 % 5}
    assert len(rows) == len(want) and {r[0] for r in rows} == want
