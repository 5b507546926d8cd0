"""Sets of files written whole, listings as jobs, upright pixels, and a listing
as a stream."""

import json
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lumisift.functions import image_files
from lumisift.sinks import files, outputs
from lumisift.sources import albums, remote
from lumisift.sources.listing import suffix_of
from lumisift.sources.paths import filesystem, same_path


def everything(root):
    return sorted(str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file())


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(6):
        (tmp_path / "in" / f"{i}.jpg").write_bytes(b"x" * i)
    rows = spark.createDataFrame([(str(tmp_path / "in" / f"{i}.jpg"), f"{tmp_path}/out/d{i % 2}/{i}.jpg") for i in range(7)], "src string, dst string").repartition(4)
    (tmp_path / "out").mkdir()
    with pytest.raises(Exception):
        outputs.copy_files(rows, f"{tmp_path}/out")  # the seventh does not exist
    assert everything(tmp_path / "out") == [] and os.listdir(tmp_path / "out") == []
    outputs.copy_files(rows.where("src NOT LIKE '%/6.jpg'"), f"file://{tmp_path}/out/")
    assert everything(tmp_path / "out") == sorted(f"d{i % 2}/{i}.jpg" for i in range(6))
    assert (tmp_path / "out/d1/5.jpg").read_bytes() == b"xxxxx" and int((tmp_path / "out/d1/5.jpg").stat().st_mtime) == int((tmp_path / "in/5.jpg").stat().st_mtime)
    with pytest.raises(Exception, match="not below"):
        outputs.copy_files(rows.limit(1), f"{tmp_path}/elsewhere")
    outputs.write_documents(spark.createDataFrame([], "name string, json string"), f"{tmp_path}/none")
    assert not (tmp_path / "none").exists() or everything(tmp_path / "none") == []


def test_a_repeated_attempt_is_one_file(tmp_path):
    """The protocol that Spark drives: an attempt dies, its repetition and a
    twin that lost are both staged, one is committed."""
    writer = files.FileSetWriter(str(tmp_path))
    rows = [Row(target=f"a/{i}.json", source=None, content=b"new") for i in range(3)]

    def dies():
        yield from rows[:2]
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.json").write_bytes(b"old")
    first, twin, idle = writer.write(iter(rows)), writer.write(iter(rows)), writer.write(iter([]))
    assert (tmp_path / "a/1.json").read_bytes() == b"old" and first.manifest != twin.manifest
    writer.commit([first, idle, None])
    assert everything(tmp_path) == ["a/0.json", "a/1.json", "a/2.json"] and (tmp_path / "a/1.json").read_bytes() == b"new"
    other = files.FileSetWriter(str(tmp_path))
    other.write(iter(rows))
    other.abort([None])
    assert sorted(os.listdir(tmp_path)) == ["a"]
    for bad in ("../x", "/x", "", None):
        with pytest.raises(ValueError):
            other.write(iter([Row(target=bad, source=None, content=b"")]))


def test_documents_and_bytes(spark, tmp_path):
    docs = spark.range(50).select(F.format_string("f%02d.json", "id").alias("name"), F.concat(F.lit('{"ü":'), F.col("id").cast("string"), F.lit("}")).alias("json")).repartition(5)
    outputs.write_documents(docs, str(tmp_path / "d"))
    assert len(everything(tmp_path / "d")) == 50 and (tmp_path / "d/f07.json").read_text(encoding="utf-8") == '{"ü":7}'
    got = spark.createDataFrame([("a.png", b"1"), ("a.png", b"1"), ("b.png", None)], "out_name string, content binary")
    outputs.write_bytes(got, str(tmp_path / "b"))
    assert everything(tmp_path / "b") == ["a.png"]


def test_listing_as_a_job(spark, tmp_path):
    for d in ("one", "two", "Stage2_x", "Curated_Best", "empty", "odd [1] é#%20"):
        (tmp_path / d).mkdir()
        for name in ("_A.JPG", ".b.png", "c.heic", "note.txt", "noext"):
            if d != "empty":
                (tmp_path / d / name).write_bytes(b"0123")
    (tmp_path / "one" / "deep").mkdir()
    (tmp_path / "one" / "deep" / "x.jpg").write_bytes(b"")
    (tmp_path / "top.webp").write_bytes(b"1")
    rows = albums.album_files(spark, str(tmp_path)).collect()
    assert {os.path.relpath(r.path, tmp_path) for r in rows} == {"top.webp"} | {f"{d}/{n}" for d in ("one", "two", "odd [1] é#%20") for n in ("_A.JPG", ".b.png", "c.heic")}
    assert {(r.suffix, r.length) for r in rows} == {(".jpg", 4), (".png", 4), (".heic", 4), (".webp", 1)}
    assert albums.list_albums(spark, f"file://{tmp_path}") == sorted(map(str, [tmp_path, tmp_path / "odd [1] é#%20", tmp_path / "one", tmp_path / "two"]))
    every = albums.album_files(spark, str(tmp_path), images_only=False)
    assert every.rdd.getNumPartitions() == 5  # the root and each folder that is not skipped
    assert albums.list_files(spark, [str(tmp_path / "two")], images_only=False).count() == 5
    sizes = {r.name: (r.content and bytes(r.content), r.length) for r in albums.read_bytes(spark, albums.list_files(spark, [str(tmp_path)]), most=0).collect()}
    assert sizes == {"top.webp": (None, None)}
    assert (suffix_of("a.TAR.gz"), suffix_of(".hidden"), suffix_of("x."), suffix_of("x")) == (".gz", "", "", "")
    assert filesystem("file:///a/b")[1:] == ("/a/b", "") and same_path("file:/a") == "/a" and same_path("s3://x/y") == "s3://x/y"


def jpeg(spark, img, orientation=None, order=b"MM"):
    """A JPEG by the JVM, with an EXIF block."""
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(img.shape[1], img.shape[0], 1)
    for y in range(img.shape[0]):
        for x in range(img.shape[1]):
            b, g, r = map(int, img[y, x])
            picture.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(picture, "jpg", out)
    data = bytes(out.toByteArray())
    if orientation is None:
        return data
    end = "big" if order == b"MM" else "little"
    number = lambda v, n: v.to_bytes(n, end)
    tiff = order + number(42, 2) + number(8, 4) + number(1, 2) + number(0x112, 2) + number(3, 2) + number(1, 4) + number(orientation, 2) + b"\0\0" + number(0, 4)
    body = b"Exif\0\0" + tiff
    return data[:2] + b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + data[2:]


def turned(img, o):
    """Where each pixel of the upright picture comes from, one by one."""
    h, w = img.shape[:2]
    size = (w, h) if o >= 5 else (h, w)
    at = {1: lambda y, x: (y, x), 2: lambda y, x: (y, w - 1 - x), 3: lambda y, x: (h - 1 - y, w - 1 - x), 4: lambda y, x: (h - 1 - y, x), 5: lambda y, x: (x, y), 6: lambda y, x: (h - 1 - x, y), 7: lambda y, x: (h - 1 - x, w - 1 - y), 8: lambda y, x: (x, w - 1 - y)}[o]
    return np.array([[img[at(y, x)] for x in range(size[1])] for y in range(size[0])], dtype=np.uint8)


def test_all_orientations_of_a_jpeg(spark, tmp_path):
    img = np.random.default_rng(2).integers(0, 256, (6, 9, 3), dtype=np.uint8)
    (tmp_path / "plain.jpg").write_bytes(jpeg(spark, img))
    for o in range(1, 9):
        (tmp_path / f"{'_' if o % 2 else ''}turn{o}.JPG").write_bytes(jpeg(spark, img, o, b"II" if o % 3 else b"MM"))
    (tmp_path / "broken6.jpg").write_bytes(jpeg(spark, img, 6)[:60])
    found = albums.list_files(spark, [str(tmp_path)])
    images = {r.name: r.image for r in albums.read_images(spark, found).collect()}
    pixels = lambda i: np.frombuffer(i.data, np.uint8).reshape(i.height, i.width, 3)
    flat = pixels(images["plain.jpg"])
    assert flat.shape == (6, 9, 3) and abs(flat.astype(int) - img).mean() < 60
    for o in range(1, 9):
        got = images[f"{'_' if o % 2 else ''}turn{o}.JPG"]
        assert (got.height, got.width) == ((9, 6) if o >= 5 else (6, 9))
        assert (pixels(got) == turned(flat, o)).all(), o
    assert images["broken6.jpg"].width == -1
    raw = {r.name: r.image for r in albums.read_images(spark, found, upright=False).collect()}
    assert (pixels(raw["turn6.JPG"]) == flat).all()
    sizes = {r.name: r.o for r in albums.read_bytes(spark, found).select("name", image_files.orientation(F.col("content")).alias("o")).collect()}
    assert sizes["plain.jpg"] == 1 and sizes["turn8.JPG"] == 8


def grow(tmp_path, n):
    (tmp_path / "files.json").write_text(json.dumps([{"file_id": f"id{i}", "name": f"{i}.jpg", "mime_type": "image/jpeg" if i % 7 else "image/gif", "width": 100, "height": 100} for i in range(n)]))


def test_a_listing_as_a_stream_that_restarts(spark, tmp_path):
    remote.register(spark)
    seen = str(tmp_path / "seen")

    def run(fail_at=None):
        def step(batch, number):
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(seen)
            if number == fail_at:
                raise RuntimeError("lost after writing")

        stream = spark.readStream.format("remote_images").options(folder_id=str(tmp_path), client="tests.grown_listing:Client", page_size="4", pages_per_batch="2", content="true").load()
        q = stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
        try:
            if fail_at is None:
                q.processAllAvailable()
            else:
                q.awaitTermination(60)
        except Exception:
            assert fail_at is not None
        finally:
            q.stop()

    grow(tmp_path, 21)
    run(fail_at=1)  # two batches were written, the second was not committed
    run()
    grow(tmp_path, 30)  # the last page fills up and others follow
    run()
    got = [r.file_id for r in spark.read.parquet(seen).collect()]
    assert sorted(got) == sorted(f"id{i}" for i in range(30) if i % 7)
    assert spark.read.parquet(seen).where("content IS NULL").count() == 0


def test_a_commit_holds_few_names_at_once(tmp_path, monkeypatch):
    """A task's manifest is moved a part at a time, however long it is, and of
    equal targets in different parts the last is left."""
    monkeypatch.setattr(files, "MOVES", 10)
    writer = files.FileSetWriter(str(tmp_path))
    said = writer.write({"target": f"t{i % 95}", "source": None, "content": str(i).encode()} for i in range(100))
    parts = list(files._manifest_parts(*files.filesystem(f"{said.manifest}/manifest")[:2]))
    assert [len(p) for p in parts] == [10] * 10
    writer.commit([said, None])
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {f"t{i % 95}": str(i) for i in range(100)}


def test_files_of_one_folder_are_read_by_several_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"f{i}").write_bytes(b"x" * i)
    found = albums.read_bytes(spark, albums.list_files(spark, [str(tmp_path)], images_only=False))
    rows = found.select("name", "length", F.octet_length("content").alias("n"), F.spark_partition_id().alias("task")).collect()
    assert {(r.name, r.length, r.n) for r in rows} == {(f"f{i}", i, i) for i in range(40)}
    assert len({r.task for r in rows}) > 1
