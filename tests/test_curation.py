"""Edge cases of the curation rules, on hand-made rows."""

import math
import random
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumisift.config import CurationConfig
from lumisift.functions import image_files, lenient_json, pixels, prompts, scoring, text, vectors
from lumisift.operators import grouping, lookups, selection, tournament
from lumisift.operators.grouping import Limits
from lumisift.operators.tables import dense_place
from lumisift.plans import stage1, stage2
from lumisift.plans.stand_in import OrdinalModel
from lumisift.sources import albums

C = CurationConfig()


def values(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_names(spark):
    rows = [(n,) for n in ("beach.jpg", "0042.jpg", "IMG_1.JPG", "IMG_001.jpg", "a.b.tiff", ".hidden", "noext", "DSC" + "9" * 30 + ".jpg")]
    s = text.stem(F.col("n"))
    got = values(spark, rows, "n string", p=text.sequence_prefix(s), i=text.sequence_index(s), x=text.suffix(F.col("n")))
    assert got[:7] == [(None, None, ".jpg"), ("", 42, ".jpg"), ("IMG_", 1, ".jpg"), ("IMG_", 1, ".jpg"), (None, None, ".tiff"), (None, None, ""), (None, None, "")]
    assert got[7][1] is None


def test_filters_and_tiers(spark):
    rows = [(25.0, 15.0, 15.0, 8.0), (24.9, 20.0, 0.0, 1.0), (30.0, 15.1, 16.0, 0.99), (30.0, 0.0, 15.1, 7.99)]
    got = values(spark, rows, "l double, b double, w double, m double", f=scoring.filter_code(F.col("l"), F.col("b"), F.col("w"), C), t=scoring.resolution_tier(F.col("m"), C))
    assert got == [("", "above_8mp"), ("blur", "between_1mp_and_8mp"), ("underexposed", "below_1mp"), ("overexposed", "between_1mp_and_8mp")]
    said = values(spark, rows, "l double, b double, w double, m double", f=scoring.filter_reason(F.col("l"), F.col("b"), F.col("w"), C))
    assert said[1] == ("blur (Laplacian var 24.9 < 25.0)",)


def test_vectors(spark):
    rows = [([0.6, 0.8], [0.6, 0.8]), ([0.0, 0.0], [0.0, 0.0]), ([], []), ([1.0, 0.0], [0.0])]
    got = values(spark, rows, "a array<float>, b array<float>", c=vectors.cosine(F.col("a"), F.col("b")), d=vectors.mean_abs_distance(F.col("a"), F.col("b")), h=vectors.hamming(F.col("a"), F.col("b")), u=vectors.unit(F.col("a")))
    assert got[0][0] == pytest.approx(1) and got[1][0] == 0 and got[2][:3] == (0, 0, 0) and got[3][:3] == (0, 0.5, 1) and got[1][3] == [0, 0]
    bits = [[random.Random(i).randrange(2) for _ in range(64)] for i in range(3)]
    packed = values(spark, [(b,) for b in bits], "b array<int>", p=vectors.pack_bits(F.col("b")))
    assert [p & (2**64 - 1) for (p,) in packed] == [sum(x << i for i, x in enumerate(b)) for b in bits]


def test_faces_and_aspects(spark):
    rows = [([100.0, 90.0],), ([100.0, 40.0, 1.0],), ([500.0],), ([],)]
    got = values(spark, rows, "a array<double>", f=scoring.face_summary(F.col("a"), F.lit(1000.0), C))
    assert [tuple(g[0]) for g in got] == [(2, 0, 0.1, False, 0.0), (3, 1, 0.1, True, 0.25), (1, 0, 0.5, False, 0.0), (0, 0, 0.0, False, 0.0)]
    shapes = values(spark, [(0, 0), (4, 3), (1920, 1080), (7, 6)], "w int, h int", a=scoring.aspect_ratio(F.col("w"), F.col("h")))
    assert [s[0] for s in shapes] == ["1:1", "4:3", "16:9", "1:1" if abs(7 / 6 - 1) <= abs(7 / 6 - 4 / 3) else "4:3"]


def photo(i, v, lap=100.0, clip=0.6, mp=9.0, folder="a", color=0.0, name=None):
    name = name or f"IMG_{i}.jpg"
    return (folder, f"/{folder}/{name}", name, v, [color], 0, lap, 7.5, 7.5, mp, clip)


PHOTO = "folder string, path string, filename string, img_vector array<float>, color_thumb array<float>, hash long, laplacian_var double, black_clip_pct double, white_clip_pct double, mp_raw double, clip_score double"


def test_statuses_and_reasons(spark):
    e = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    rows = [
        photo(1001, e(0)), photo(1002, e(12), lap=10.0), photo(1003, e(24), lap=90.0),  # a blurred frame bridges two good ones
        photo(2001, e(0), lap=40.0), photo(3001, e(0), mp=0.5), photo(4001, e(0), lap=9.0), photo(5001, [0.0, 0.0]), photo(5002, [0.0, 0.0]),
        photo(6001, e(0), clip=0.9, lap=80.0), photo(6002, e(0), clip=0.9, lap=80.0), photo(0, e(0), name="beach.jpg"),
    ]
    log = {r.filename: r for r in stage1.curate(spark.createDataFrame(rows, PHOTO), C).collect()}
    assert len(log) == len(rows)
    assert log["IMG_1001.jpg"].status == "selected" and log["IMG_1001.jpg"].group_size == 3
    assert log["IMG_1002.jpg"].status == "rejected" and log["IMG_1002.jpg"].rejection_reason.endswith("; replaced by IMG_1001.jpg")
    assert log["IMG_1003.jpg"].status == "eligible" and log["IMG_1003.jpg"].rejection_reason == "similar_to_selected:IMG_1001.jpg"
    assert log["IMG_2001.jpg"].status == "rejected" and log["IMG_2001.jpg"].rejection_reason.startswith("singleton_blur")
    assert (log["IMG_3001.jpg"].rejection_reason, log["IMG_3001.jpg"].group_id) == ("resolution_below_1mp", 0)
    assert log["IMG_4001.jpg"].rejection_reason.startswith("blur (")
    assert log["IMG_5001.jpg"].group_size == log["IMG_5002.jpg"].group_size == 1
    assert log["IMG_6001.jpg"].status == "selected" and log["IMG_6002.jpg"].selected_filename == "IMG_6001.jpg"
    assert log["beach.jpg"].group_size == 1
    single = log["IMG_5001.jpg"]
    assert single.status == "selected" and single.singleton_penalty_applied == 0.6


def test_trim_counts_in_doubles(spark):
    rows = spark.createDataFrame([("f", i, float(i), True) for i in range(100)], "folder string, group_id int, score double, is_winner boolean")
    assert selection.trimmed(rows, 0.07).where(~F.col("trimmed")).count() == 8
    cut = selection.trimmed(rows, 0.07).where("group_id = 3").first()
    assert cut.trimmed and cut.cutoff == 92.0


def test_singleton_reasons(spark):
    got = values(spark, [(40.0, 2.0, 1), (60.0, 2.75, 1), (40.0, 2.0, 2)], "l double, q double, n int", r=selection.singleton_reason(F.col("l"), F.col("q"), F.col("n"), C))
    assert got[0][0].count("; ") == 1 and got[1][0] == "" and got[2][0] == ""


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)).filter(lambda e: e[0] < e[1]), max_size=40), st.booleans())
def test_components_against_union_find(spark, edges, rounds):
    parent = list(range(31))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([("f", "p", a, b) for a, b in edges], "folder string, prefix string, a long, b long")
    got = {r.ord: r.root for r in grouping.components(df, 0 if rounds else 10**6).collect()}
    assert got == {x: find(x) for e in edges for x in e}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=40), st.integers(0, 9))
def test_band_join_against_all_pairs(spark, indexes, window):
    rows = spark.createDataFrame([("k", i, x) for i, x in enumerate(indexes)], "k string, ord int, idx int")
    got = sorted((r.a_ord, r.b_ord) for r in grouping.band_pairs(rows, ["k"], "ord", "idx", window).collect())
    assert got == sorted((i, j) for i, x in enumerate(indexes) for j, y in enumerate(indexes) if i < j and abs(x - y) <= window)


def test_gate_off_and_two_limits_at_once(spark):
    rows = grouping.with_sequence(spark.createDataFrame([photo(i, [1.0, 0.0], name=f"{'ab'[i % 2]}{10 * i}.jpg") for i in range(4)], PHOTO))
    assert grouping.similarity_edges(rows, [Limits(4, 0.9)], gate=False).where("edge_0").count() == 6
    both = grouping.similarity_edges(rows, [Limits(20, 0.9), Limits(4, 0.9)])
    assert (both.where("edge_0").count(), both.where("edge_1").count()) == (2, 0)


def test_tournament(spark):
    sizes = [1, 2, 4, 5, 8, 9]
    rows = [(f, f"p{f}{i}") for f, n in enumerate(sizes) for i in range(n)]
    plan = tournament.family_plan(spark.createDataFrame(rows, "scene_family_id int, filename string"), 4)
    assert [r.keep_limit for r in plan.select("scene_family_id", "keep_limit").distinct().orderBy("scene_family_id").collect()] == [1, 1, 1, 2, 2, 3]
    answers = spark.createDataFrame([(1, ["nobody", "p11", "p10"], "p11", [("p11", "x"), ("p11", "y")]), (2, [], None, [])], "scene_family_id int, keep array<string>, primary string, photos array<struct<filename:string,reason:string>>")
    got = {(r.scene_family_id, r.filename): r for r in tournament.model_decisions(plan, answers).collect()}
    assert got[1, "p11"].kept and got[1, "p11"].is_primary and got[1, "p11"].reason == "y" and not got[1, "p10"].kept
    assert got[2, "p20"].kept and got[2, "p20"].is_primary
    thirteen = spark.createDataFrame([(f"{i:02d}",) for i in range(13)], "filename string")
    assert sorted((r.batch, r.slot) for r in tournament.batches(thirteen, 12).collect())[-2:] == [(1, 11), (2, 0)]
    finalists = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "filename string, final_place int")
    assert tuple(tournament.final_ranking(finalists, [], "zz", 2).first()) == (["a", "b"], "a")
    assert tuple(tournament.final_ranking(finalists, ["zz", "c", "c"], "b", 2).first()) == (["c"], "b")
    assert tournament.retry_sizes(12) == [6, 4] and tournament.retry_sizes(5) == [4] and tournament.retry_sizes(3) == [2]
    assert tournament.review_ladder(spark.createDataFrame([(4000, 3000), (500, 300)], "width int, height int")).count() == 25 + 30


def test_lenient_json(spark):
    texts = ['{"k": 1}', 'Sure: {"k": 2} ok', "none", "```json\n{\"k\": 3}\n```"]
    got = values(spark, [(t,) for t in texts], "t string", k=lenient_json.field(lenient_json.from_free_text(F.col("t")), "$.k", "int"))
    assert [g[0] for g in got] == [1, 2, None, 3]
    plans = ['```\n{"repair_mode":"edge_completion","pad_sides":["left","up"]}\n```', '{"repair_mode":"edge_completion","pad_sides":["top","bottom"]}', '{"repair_mode":"edge_completion","pad_sides":["left","right","top","bottom"]}', '{"repair_mode":"magic"}', "oops"]
    got = [g[0] for g in values(spark, [(t,) for t in plans], "t string", p=lenient_json.parse_analysis(F.col("t")))]
    assert [(g.repair_mode, g.pad_sides) for g in got] == [("edge_completion", ["left"]), ("square_and_level", []), ("square_and_level", []), ("tonal_only", []), ("tonal_only", [])]
    assert got[4].reason.startswith("Failed to parse")
    reply = '{"candidates":[{"content":{"parts":[{"text":"a"},{"inlineData":{"mimeType":"image/jpeg","data":"QQ=="}},{"text":"b"},{"inline_data":{"data":"Qg=="}}]}}],"usageMetadata":{"n":"5"}}'
    row = values(spark, [(reply,), ("{}",)], "t string", x=lenient_json.response_text(F.col("t")), i=lenient_json.response_image(F.col("t")), u=lenient_json.usage(F.col("t")))
    assert row[0][0] == "ab" and (row[0][1].mime, bytes(row[0][1].data)) == ("image/png", b"B") and row[0][2] == {"n": "5"} and row[1][:2] == (None, None)
    flags = values(spark, [("Yes",), ("0",), (None,), ("maybe",)], "t string", b=lenient_json.coerce_bool(F.col("t"), F.lit(True)))
    assert [f[0] for f in flags] == [True, False, True, True]


def test_prompts(spark):
    rows = [("a.jpg", "", ["rotate it", " crop ", "crop"], [], [""], ["r"], "edge_completion", ["left"]), ("b.jpg", "goal", [], [], [], [], "odd", [])]
    schema = "n string, g string, s array<string>, c array<string>, a array<string>, r array<string>, m string, p array<string>"
    a, b = (g[0] for g in values(spark, rows, schema, p=prompts.improvement_prompt(*[F.col(x) for x in "ngscarmp"])))
    assert "rotate" not in a and "Welcome: crop\n" in a and "Margins" in a and prompts.REPAIRS["edge_completion"].change in a and "Goal" not in a and "Never" not in a
    assert "Goal: goal" in b and "Change" not in b and "Margins" not in b
    assert all(m in prompts.analysis_prompt() for m in lenient_json.MODES)
    wishes = values(spark, [(" w ", "a"), (None, ""), ("x", None)], "c string, a string", p=prompts.writer_prompt(F.col("a"), F.col("c")), q=prompts.written_or(F.col("a"), F.col("c")))
    assert "Wish: w" in wishes[0][0] and "Analysis: a" in wishes[0][0] and wishes[1] == (None, None) and [w[1] for w in wishes] == ["a", None, "x"]
    line = values(spark, [("g", ["s", "s"], [], None, ["r"]), ("", [], [], [], [])], "g string, s array<string>, c array<string>, a array<string>, r array<string>", p=prompts.print_prompt(*[F.col(x) for x in "gscar"]))
    assert [x[0] for x in line] == ["g; do s; mind r", None]
    fixed = values(spark, [("look", "do"), (None, "do"), ("look", None), (None, None)], "a string, c string", p=prompts.quick_fix_prompt(F.col("a"), F.col("c"), "selective"))
    assert fixed[0][0].index("do") < fixed[0][0].index("look") and fixed[1][0] and fixed[2][0].startswith("look") and fixed[3][0] is None


def test_lookups(spark):
    winners = spark.createDataFrame([("f", "A1.JPG"), ("f", "A2.tif"), ("g", "A1.JPG")], "folder string, filename string")
    files = spark.createDataFrame([("f", "A1.raf", "/r"), ("f", "A1.RAF", "/R"), ("f", "A2.RAF", "/x")], "folder string, name string, path string")
    got = {(r.folder, r.filename): r.raw_path for r in lookups.raw_companions(winners, files).collect()}
    assert got == {("f", "A1.JPG"): "/R", ("f", "A2.tif"): None, ("g", "A1.JPG"): None}
    bad = spark.createDataFrame([("z", ["a", "b"])], "best_filename string, names array<string>")
    with pytest.raises(Exception, match="unknown file"):
        lookups.check_answer(bad).collect()
    with pytest.raises(ValueError):
        lookups.rank_slice(winners, 0)


def test_pixels():
    flat = np.full((40, 60, 3), 100, np.uint8)
    assert pixels.laplacian_variance(pixels.gray(flat)) == 0 and pixels.clip_percentages(pixels.gray(flat)) == (0.0, 0.0)
    assert abs(np.linalg.norm(pixels.image_vector(flat)) - 1) < 1e-5 and not pixels.image_vector(flat * 0).any()
    board = np.indices((8, 8)).sum(axis=0) % 2 * 10
    assert pixels.laplacian_variance(board) == 1600
    assert np.allclose(pixels.area_resize(np.arange(16.0).reshape(4, 4), 2, 2), [[2.5, 4.5], [10.5, 12.5]])
    ramp = np.tile(np.arange(64, dtype=np.uint8)[None, :, None] * 4, (64, 1, 3))
    assert pixels.perceptual_hash(ramp).shape == (64,) and (pixels.perceptual_hash(ramp) == pixels.perceptual_hash(ramp // 2)).mean() > 0.8
    assert pixels.fit_side(np.zeros((3000, 1500, 3), np.uint8), 1500).shape == (1500, 750, 3)
    assert pixels.pad_geometry(100, 200, ["left", "top"], 5) == (10, 0, 5, 0)
    padded = pixels.pad_blur_fade(flat, ["left"], 10)
    assert padded.shape == (40, 66, 3) and abs(padded.astype(int) - 100).max() <= 1
    assert pixels.pad_all_sides(flat, 10).shape == (48, 72, 3) and pixels.pad_blur_fade(flat, [], 10) is flat
    tall = np.zeros((2, 3, 3), np.uint8)
    assert [pixels.exif_oriented(tall, o).shape[:2] for o in (1, 3, 6, 8)] == [(2, 3), (2, 3), (3, 2), (3, 2)]


def test_image_files(spark):
    rng = np.random.default_rng(4)
    img = rng.integers(0, 256, (30, 47, 3), dtype=np.uint8)
    data = image_files.encode_png(img)
    assert image_files.image_size(data) == (47, 30) and (image_files.decode(data) == img).all()
    assert image_files.decode(b"") is None and image_files.decode(b"nonsense") is None and image_files.image_size(b"\xff\xd8\xff") is None
    # every line filter, against a plain writer
    lines = img[..., ::-1].reshape(30, -1).astype(int)
    packed = b""
    for y, line in enumerate(lines):
        up, left = lines[y - 1] if y else line * 0, np.concatenate([[0] * 3, line[:-3]])
        corner = np.concatenate([[0] * 3, up[:-3]])
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        packed += bytes([y % 5]) + bytes(((line - (line * 0, left, up, (left + up) // 2, near)[y % 5]) % 256).astype(np.uint8))
    at = data.index(b"IDAT")
    body = zlib.compress(packed)
    filtered = data[:at - 4] + len(body).to_bytes(4, "big") + b"IDAT" + body + b"\0" * 4 + data[-12:]
    assert (image_files._png_pixels(filtered) == img).all()
    exif = b"\xff\xd8\xff\xe1\x00\x22Exif\0\0MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x06\0\0\0\0\0\0\xff\xda\0\x02"
    assert image_files.exif_orientation(exif) == 6 and image_files.exif_orientation(data) == 1
    mime, small, w, h, _ = image_files.review_copy(np.zeros((900, 2000, 3), np.uint8))
    assert (w, h) == (1600, 720) and image_files.image_size(small) == (1600, 720) and mime.startswith("image/")
    tight = image_files.review_copy(img, max_bytes=10)
    assert tight[2:4] == (47, 30)
    rows = spark.createDataFrame([("a", data), ("b", b"x"), ("c", None)], "path string, content binary")
    got = {r.path: r.image for r in albums.decode_bytes(rows).collect()}
    assert bytes(got["a"].data) == img.tobytes() and got["b"].height == -1
    sizes = [tuple(r.s) for r in rows.select(image_files.dimensions(F.col("content")).alias("s")).collect()]
    review = [r.r.width for r in rows.select(image_files.for_review(F.col("content")).alias("r")).collect()]
    assert sizes == [(47, 30), (None, None), (None, None)] and review == [47, None, None]


def test_stage_2_needs_survivors(spark):
    none = spark.createDataFrame([], "filename string")
    with pytest.raises(ValueError, match="survived"):
        stage2.rank_portfolio(none, OrdinalModel, stage2.Stage2Config())


def test_places_of_names_with_a_long_common_beginning(spark):
    names = [f"{'x' * 30}{i:03d}" for i in range(300)]
    rows = spark.createDataFrame([(n,) for n in random.Random(1).sample(names, 300)], "filename string")
    placed = dense_place(rows, ["filename"], "p")
    assert sorted((r.p, r.filename) for r in placed.collect()) == list(enumerate(names))
    used = {r.n for r in placed.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(used) < 300


def test_tiles_give_all_pairs(spark):
    n = 2 * grouping.TILE + 40
    rows = spark.createDataFrame([("f", i) for i in range(1, n + 1)] + [("g", 1), ("g", 2), ("h", 1)], "folder string, ord long")
    got = grouping.tile_pairs(rows, "folder", "ord")
    assert got.count() == n * (n - 1) // 2 + 1 == got.distinct().count()
    assert got.where("a_ord >= b_ord OR a_folder <> b_folder").count() == 0


def test_no_vector_crosses_the_pair_join(spark):
    """Hashes are tested first: the join that makes pairs carries names,
    indexes and hashes; vectors are joined to what is left."""
    e = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    rows = spark.createDataFrame([photo(i, e(7 * i), color=0.1 * (i % 3)) for i in range(40)], PHOTO).withColumn("hash", F.expr("CASE WHEN length(filename) % 2 = 0 THEN 7 ELSE 255 END").cast("long"))
    limits = [Limits(20, 0.97, 0.14, 2), Limits(4, 0.9, 0.3, 8)]
    seq = grouping.with_sequence(rows)
    edges = grouping.similarity_edges(seq, limits)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join Inner" in line and "bucket" in line]
    assert len(joins) == 1
    below = plan[plan.index(joins[0]):].split("\n")
    depth = below[0].index("Join")
    inside = [below[0]]
    for line in below[1:]:
        if len(line) - len(line.lstrip(" :+-")) <= depth - 2:
            break
        inside.append(line)
    assert not any("img_vector" in x or "color_thumb" in x for x in inside if "Project" in x or "Generate" in x)
    carried = grouping.band_pairs(seq, ["folder", "prefix"], "ord", "idx", 20, ["hash", "img_vector", "color_thumb"])
    for k, x in enumerate(limits):
        gap = F.abs(F.col("a_idx") - F.col("b_idx"))
        want = {(r.a_ord, r.b_ord) for r in carried.where(grouping.similar(x) & (gap <= x.window)).collect()}
        assert want and {(r.a, r.b) for r in edges.where(f"edge_{k}").collect()} == want


def test_places_in_one_large_album(spark):
    """A million names of one album, each with a vector: only names are sorted."""
    n = 1_000_000
    rows = spark.range(n).select(
        F.lit("a").alias("folder"), F.format_string("/a/IMG_%07d.jpg", F.pmod(F.col("id") * 7919, F.lit(n))).alias("path"), F.array_repeat(F.col("id").cast("float"), 8).alias("img_vector"),
    ).withColumn("filename", F.element_at(F.split("path", "/"), -1))
    placed = grouping.with_sequence(rows)
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):]
    assert "img_vector" not in window.split("\n")[0] and "img_vector" not in window.split("\n")[1]
    got = placed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ord") != F.col("idx") + 1).alias("wrong"), F.sum("ord").alias("s")).first()
    assert (got.n, got.wrong, got.s) == (n, 0, n * (n + 1) // 2)


def test_a_long_answer_is_matched_by_hashes(spark):
    """Names of a key times names of its answer would be 3,600,000,000 looks."""
    rows = spark.range(60_000).select(F.concat(F.lit("a long name of a photo "), F.col("id").cast("string")).alias("filename"), F.col("id").alias("final_place"))
    rows = rows.unionByName(spark.createDataFrame([(None, 60_000)], "filename string, final_place long"))
    began = time.monotonic()
    got = tournament.final_ranking(rows, F.concat(F.array(F.lit("nobody"), F.get("names", F.lit(4))), F.reverse("names")), "nobody", 3).first()
    assert time.monotonic() - began < 30
    name = "a long name of a photo {}".format
    assert tuple(got) == ([name(4), name(59_999), name(59_998)], name(4))


def test_pictures_of_embeddings_are_made_in_their_rows(spark):
    """No pixel is a row of an exchange."""
    from lumisift.plans import catalog, catalog_io  # noqa: F401

    for name in ("grey_vector", "colour_thumb", "shrunk_pictures", "hosted_models", "perceptual_hash"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Aggregate" not in plan, name
    rows = [(1, [-1.0] * 64), (2, None), (3, [0.0, None] * 32), (4, [0.5])]
    data = [None if x is None else bytes(x) for x in catalog.color_bytes(spark.createDataFrame(rows, "vec_id int, e array<float>").orderBy("vec_id").toPandas()["e"])]
    assert data[1:] == [None] * 3
    assert list(data[0][:6]) == [200] * 6 and list(data[0][6:9]) == [10, 41, 72] and len(data[0]) == 4800


def test_pixels_are_made_where_they_are_looked_at(monkeypatch):
    """A stack at a time, of rows that have pixels."""
    monkeypatch.setattr(pixels, "STACK", 24)
    asked = []

    def decode(codes):
        asked.append(len(codes))
        return pd.Series([None if x < 0 else bytes([x] * 12) for x in codes], dtype=object)

    n = pd.Series([2] * 6)
    got = [(p, x.shape, x[:, 0, 0, 0].tolist()) for p, x in pixels.stacks(n, n, n + 1, pd.Series([5, None, 7, -1, 9, -1], dtype=object), decode)]
    assert got == [([0, 2], (2, 2, 2, 3), [5, 7]), ([4], (1, 2, 2, 3), [9])] and asked == [2, 2, 1]


def test_measures_are_given_out_in_pieces():
    """A batch of small rows makes 12 KB of numbers a row; rows keep their order."""
    n = 1000
    size, data = pd.Series([2] * n), pd.Series([None if i % 7 == 3 else i % 251 for i in range(n)], dtype=object)
    decode = lambda codes: pd.Series([bytes([int(x)] * 12) for x in codes], dtype=object)
    pieces = [x["color_thumb"] for x in pixels.measured(iter([(size, size, size + 1, data)] * 2), ("color_thumb",), decode)]
    assert max(sum(v.nbytes for v in x if v is not None) for x in pieces) <= pixels.STACK
    got = [None if v is None else round(float(v[0]) * 255) for x in pieces for v in x]
    assert got == [None if i % 7 == 3 else i % 251 for i in range(n)] * 2


def test_thumbs_are_made_in_one_worker(spark):
    """No pixel goes to a worker or back."""
    from lumisift.plans import catalog

    plan = catalog.colour_thumb(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "color_bytes" not in plan


def test_pictures_are_shrunk_in_one_worker(spark):
    """Two evaluations would send every picture out of a worker and into the next."""
    from lumisift.plans import catalog, catalog_io  # noqa: F401

    plan = catalog.QUERIES["shrunk_pictures"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    rows = [(1, [0.5] * 64), (2, None), (3, [0.5]), (4, [0.25] * 64)]
    e = F.col("e")
    image = F.struct(F.lit(40).alias("height"), F.lit(40).alias("width"), F.lit(3).alias("nChannels"), e.alias("data"))
    small = spark.createDataFrame(rows, "k int, e array<float>").select("k", pixels.shrunk(image, 32, catalog.color_bytes).alias("s")).orderBy("k").collect()
    assert [(r.s.height, r.s.data is None) for r in small] == [(32, False), (40, True), (40, True), (32, False)]
    whole = catalog.color_bytes(pd.Series([rows[0][1]]))[0]
    assert bytes(small[0].s.data) == pixels.fit_side(np.frombuffer(whole, np.uint8).reshape(40, 40, 3), 32).tobytes()


def test_hosted_models_look_once(spark, tmp_path):
    """Nothing is joined or exchanged; a repeated id and a null picture keep their rows."""
    from lumisift.plans import catalog, catalog_io  # noqa: F401

    rows = [(1, [0.5] * 64), (1, [0.25] * 64), (2, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalog.QUERIES["hosted_models"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("MapInPandas") == 1
    got = got.collect()
    assert sorted((r.vec_id, r.image_h, r.face_w) for r in got if r.vec_id == 1) == [(1, 40, 20)] * 2
    assert len({r.blue for r in got if r.vec_id == 1}) == 2
    assert [(r.image_h, r.face_w, r.blue) for r in got if r.vec_id == 2] == [(None, None, None)]


def test_pictures_are_hashed_in_one_worker(spark):
    """Two evaluations would send every picture out of a worker and into the next."""
    from lumisift.plans import catalog

    plan = catalog.QUERIES["perceptual_hash"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    rows = [(1, [0.5, -0.25] * 32), (2, None), (3, [0.5])]
    image = F.struct(F.lit(40).alias("height"), F.lit(40).alias("width"), F.lit(3).alias("nChannels"), F.col("e").alias("data"))
    got = [r.m.phash for r in spark.createDataFrame(rows, "k int, e array<float>").select("k", pixels.measure(image, ["phash"], catalog.color_bytes).alias("m")).orderBy("k").collect()]
    whole = np.frombuffer(catalog.color_bytes(pd.Series([rows[0][1]]))[0], np.uint8).reshape(40, 40, 3)
    assert got == [pixels.perceptual_hash(whole).tolist(), None, None]
