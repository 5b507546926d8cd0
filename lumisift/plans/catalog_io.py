"""Registered queries that write, read back, list, prompt and ask, each beside
its SQL. They join ``catalog.QUERIES``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import models
from ..functions import lenient_json, pixels, prompts
from ..operators.tables import shared_folder
from ..sinks import files, outputs
from ..sources import albums, remote
from .catalog import coded_pictures, color_bytes, query, table, BANDS_SQL, COLOR_SQL
from .stand_in import MeanEmbedder, NoSchemaModel, PickingModel, QuarterDetector, TurningModel


def fresh(spark, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


# -- prompts

NAMES_SQL = "SELECT p_brand, count(*) AS n, string_agg(lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '.jpg', ', ' ORDER BY p_partkey) AS names FROM part GROUP BY p_brand"


@query(f"""SELECT p_brand, 'These photographs show one scene. Keep at most ' || n || ' and answer in JSON with keep_filenames, primary_filename and photos: ' || names AS family,
  'Score each photograph from 1 to 10 for print and name the best ' || n || ' in JSON: ' || names AS batch, 'Rank the best ' || n || ' of these finalists in JSON with ranked_filenames, top_filename and reasons: ' || names AS final FROM ({NAMES_SQL})""")
def list_prompts(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.format_string("%09d.jpg", "p_partkey"))).alias("names"))
    return rows.select("p_brand", *[f(F.col("names"), F.col("n")).alias(c) for c, f in (("family", prompts.family_prompt), ("batch", prompts.batch_prompt), ("final", prompts.final_prompt))])


@query("""SELECT p_partkey, concat_ws(chr(10), 'Prepare ' || p_name || ' for print. It stays the same photograph: people, buildings, lettering and light are given.',
  CASE WHEN p_size % 3 = 0 THEN 'Margins were added on these sides and must read as the same scene: left, top.' END,
  CASE p_size % 4 WHEN 0 THEN 'Change the soft margin, which is still to be painted. Leave all inside the sharp frame as it is.' WHEN 1 THEN 'Change the softness of that person. Leave who they are, how they stand and look as it is.' END,
  CASE WHEN p_size % 2 = 0 THEN 'Goal: ' || p_type END, 'Welcome: ' || p_brand, CASE WHEN p_size % 5 = 0 THEN 'Beware: ' || p_type || '; ' || p_brand END) AS prompt FROM part""")
def image_prompts(spark, d):
    empty = F.array().cast("array<string>")
    mode = F.get(F.array(*map(F.lit, ("edge_completion", "subject_deblur", "tonal_only", "unheard"))), F.col("p_size") % 4)
    goal = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_type")).otherwise("")
    risks = F.when(F.col("p_size") % 5 == 0, F.array("p_type", F.lit(" "), "p_brand", "p_type")).otherwise(empty)
    sides = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("left"), F.lit("top"))).otherwise(empty)
    said = prompts.improvement_prompt(F.col("p_name"), goal, F.array(F.lit("rotate it"), "p_brand"), F.array(F.lit("flip")), F.array(F.lit(" ")), risks, mode, sides)
    return table(spark, d, "part").select("p_partkey", said.alias("prompt"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS wish, CASE WHEN event_id % 2 = 0 THEN props END AS analysis FROM events),
w AS (SELECT *, nullif(concat_ws(chr(10), 'Wish: ' || wish, 'Analysis: ' || analysis), '') AS parts,
  analysis || ' Do not alter the main subject''s face, and remove people in the background who are not the subject.' AS guard FROM e)
SELECT event_id, 'Write one prompt for an image editor, at most five sentences, from this.' || chr(10) || parts AS asked, CASE WHEN event_id % 4 = 0 THEN 'written' ELSE event_id || ' local' END AS used,
  coalesce('Edit only the background; the subject (the dog) stays exactly as it is. Task: ' || wish || chr(10) || chr(10) || '---' || chr(10) || '## Analysis (apply what agrees with the above):' || chr(10) || guard,
    'Edit only the background; the subject (the dog) stays exactly as it is. Task: ' || wish, guard) AS fixed FROM w""")
def edit_prompts(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    wish, analysis = F.when(k % 3 != 0, F.concat(F.lit(" "), "event_type")), F.when(k % 2 == 0, F.col("props"))
    written = F.when(k % 4 == 0, F.lit(" written ")).when(k % 4 == 1, F.lit(" "))
    return e.select(
        "event_id", prompts.writer_prompt(analysis, wish).alias("asked"), prompts.written_or(written, F.concat(k.cast("string"), F.lit(" local"))).alias("used"),
        prompts.quick_fix_prompt(analysis, wish, "selective", "the dog").alias("fixed"),
    )


# -- files written and read back

@query("""SELECT 'p_' || p_partkey || '.json' AS name, '.json' AS suffix, length('{"k":' || p_partkey || ',"b":"' || p_brand || '"}') AS length, '{"k":' || p_partkey || ',"b":"' || p_brand || '"}' AS body FROM part""")
def written_files(spark, d):
    """Documents as a set of files, listed and read by tasks."""
    rows = table(spark, d, "part").select(F.format_string("p_%d.json", "p_partkey").alias("name"), F.to_json(F.struct(F.col("p_partkey").alias("k"), F.col("p_brand").alias("b"))).alias("json"))
    place = fresh(spark, "documents")
    outputs.write_documents(rows, place)
    return albums.read_bytes(spark, albums.list_files(spark, [place], images_only=False)).select("name", "suffix", "length", F.decode("content", "UTF-8").alias("body"))


@query("""SELECT lpad(CAST(s_suppkey AS VARCHAR), 4, '0') || '_s' || s_suppkey || '.jpg' AS name, s_name AS body, CASE WHEN s_acctbal >= 3000 THEN 'Above_8MP' ELSE 'Between_1MP_and_8MP' END AS tier FROM supplier""")
def copied_files(spark, d):
    """Files copied under their ranks, and again by tier."""
    from .catalog import C

    s = table(spark, d, "supplier")
    first, second, third = (fresh(spark, x) for x in ("in", "ranked", "tiers"))
    files.write_files(s, first, F.format_string("s%d.jpg", "s_suppkey"), content=F.encode("s_name", "UTF-8"))
    path = albums.list_files(spark, [first]).select("path", F.col("name").alias("filename"))
    key = F.regexp_extract("filename", "([0-9]+)", 1).cast("long")
    photos = path.join(s.select(F.col("s_suppkey").alias("rank"), F.when(F.col("s_acctbal") >= 3000, "above_8mp").otherwise("x").alias("tier")), key == F.col("rank"))
    outputs.copy_files(outputs.ranked_manifest(photos, second, 4), second)
    outputs.copy_files(outputs.copy_manifest(photos.withColumn("raw_path", F.lit(None).cast("string")), third, C), third)
    ranked = albums.read_bytes(spark, albums.list_files(spark, [second])).select("name", F.decode("content", "UTF-8").alias("body"))
    tiers = albums.list_files(spark, [f"{third}/{C.high_dir}", f"{third}/{C.medium_dir}"]).select(F.col("name").alias("plain"), F.element_at(F.split("folder", "/"), -1).alias("tier"))
    return ranked.join(tiers, F.substring("name", 6, 99) == F.col("plain")).select("name", "body", "tier")


LOG_SQL = """SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '.jpg' AS filename, CASE WHEN o_orderstatus = 'O' THEN 'selected' ELSE 'rejected' END AS status, 'x, "' || o_orderpriority || '"' AS rejection_reason, CAST(o_custkey AS INT) AS group_id,
  o_orderkey % 3 > 0 AS decode_ok, round_even(o_totalprice / 7919, 2) AS megapixels, round_even(o_totalprice / 1e7, 4) AS clip_score, o_orderkey % 3 > 1 AS passed_opencv FROM orders"""


@query(f"SELECT filename, status, rejection_reason, group_id, 0 AS group_size, decode_ok, megapixels, 0.0::DOUBLE AS laplacian_var, clip_score, true AS passed_scene_check FROM ({LOG_SQL}) WHERE status = 'selected'")
def written_log(spark, d):
    """A selection log as written, read for its selected photos."""
    log, place = _log(spark, d), fresh(spark, "log")
    outputs.write_selection_log(log, place)
    return albums.read_selection_log(spark, place).select("filename", "status", "rejection_reason", "group_id", "group_size", "decode_ok", "megapixels", "laplacian_var", "clip_score", "passed_scene_check")


@query(f"""SELECT count(*) AS total_listed, count(*) FILTER (WHERE NOT decode_ok) AS decode_failures, 0 AS rejected_resolution, count(*) FILTER (WHERE decode_ok AND NOT passed_opencv) AS rejected_opencv,
  count(*) FILTER (WHERE decode_ok AND passed_opencv) AS below_clip, count(*) FILTER (WHERE status = 'selected') AS kept FROM ({LOG_SQL})""")
def counted_log(spark, d):
    """Counters that were taken while the log was written."""
    counted = outputs.write_selection_log(_log(spark, d), fresh(spark, "log"))
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in counted.items()])


def _log(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    return o.select(
        F.format_string("%09d.jpg", k).alias("filename"), F.when(F.col("o_orderstatus") == "O", "selected").otherwise("rejected").alias("status"), F.concat(F.lit('x, "'), "o_orderpriority", F.lit('"')).alias("rejection_reason"),
        F.col("o_custkey").cast("int").alias("group_id"), (k % 3 > 0).alias("decode_ok"), (k % 3 > 0).alias("passed_resolution"), (k % 3 > 1).alias("passed_opencv"), F.lit(False).alias("passed_clip"),
        (F.col("o_totalprice") / 7919).alias("megapixels"), (F.col("o_totalprice") / 1e7).alias("clip_score"),
    )


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS scene_family_id, 's' || s_suppkey AS filename, CASE WHEN s_suppkey % 2 = 0 THEN 'True' ELSE 'False' END AS kept_after_family_reduction, CAST(s_suppkey % 9 AS VARCHAR) AS family_input_count, 'a "b", c' AS reason FROM supplier""")
def written_family_table(spark, d):
    s = table(spark, d, "supplier")
    number = lambda c: F.col(c).cast("int")
    rows = s.select(
        number("s_nationkey").alias("scene_family_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("filename"), (F.col("s_suppkey") % 2 == 0).alias("kept_after_family_reduction"), F.lit(True).alias("primary_in_family"),
        (F.col("s_suppkey") % 9).alias("family_input_count"), F.lit(1).alias("family_keep_limit"), F.lit(1).alias("strict_group_id"), F.lit(1).alias("strict_group_size"), F.lit("/x").alias("stage1_path"), F.lit('a "b", c').alias("reason"),
    )
    place = fresh(spark, "families")
    outputs.write_family_csv(rows, place)
    return spark.read.csv(place, header=True, escape='"').select("scene_family_id", "filename", "kept_after_family_reduction", "family_input_count", "reason")


@query("""SELECT 'id' || p_partkey AS file_id, p_name AS filename, CAST(p_size AS DOUBLE) AS megapixels, round_even(p_size / 791.9::DOUBLE, 4) AS clip_score, 'x/' || p_name AS saved_path FROM part""")
def written_remote_log(spark, d):
    rows = table(spark, d, "part").select(
        F.format_string("id%d", "p_partkey").alias("file_id"), F.col("p_name").alias("filename"), F.col("p_size").cast("double").alias("megapixels"), F.lit(1.0).alias("laplacian_var"), F.lit(0.0).alias("black_clip_pct"),
        F.lit(0.0).alias("white_clip_pct"), (F.col("p_size") / 791.9).alias("clip_score"), F.concat(F.lit("x/"), "p_name").alias("saved_path"),
    )
    place = fresh(spark, "remote")
    outputs.write_remote_log(rows, place)
    kinds = "file_id string, filename string, megapixels double, laplacian_var double, black_clip_pct double, white_clip_pct double, clip_score double, saved_path string"
    return spark.read.csv(place, schema=kinds, header=True, escape='"').select("file_id", "filename", "megapixels", "clip_score", "saved_path")


@query("""WITH r AS (SELECT c_name, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) SELECT CAST(rank AS BIGINT) AS rank, c_name AS filename, CAST(c_acctbal AS DOUBLE) AS score, (SELECT count(*) FROM r) AS ranked_count,
  (SELECT max(c_name) FROM r WHERE rank = 1) AS top_filename FROM r""")
def written_portfolio(spark, d):
    """A portfolio's summary, written a line at a time and read as one document."""
    from ..operators.tables import dense_place

    c = table(spark, d, "customer").select(F.col("c_name").alias("filename"), F.col("c_acctbal").cast("double").alias("score"), (-F.col("c_acctbal")).alias("low"), "c_custkey")
    ranked = dense_place(c, ["low", "c_custkey"], "place").select((F.col("place") + 1).cast("int").alias("rank"), "filename", "score")
    top = ranked.where("rank = 1").first().filename
    place = fresh(spark, "portfolio")
    outputs.write_lines(outputs.portfolio_summary(ranked.withColumn("top_filename", F.lit(top)), {"batch_size": 12}), f"{place}/portfolio")
    text = spark.read.text(f"{place}/portfolio", wholetext=True)
    doc = text.select(F.from_json("value", "top_filename string, ranked_count long, ranked_details array<struct<rank:long,filename:string,score:double>>").alias("v"))
    return doc.select("v.top_filename", "v.ranked_count", F.explode("v.ranked_details").alias("r")).select("r.*", "ranked_count", "top_filename")


@query("""SELECT format('batch_{:02d}.json', p_size) AS name, to_json({'batch': p_size, 'n': count(*), 'best': min(p_name)}) AS json FROM part GROUP BY p_size""")
def batch_json(spark, d):
    rows = table(spark, d, "part").groupBy(F.col("p_size").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("p_name").alias("best"))
    return outputs.batch_documents(rows)


# -- remote listing

@query("""SELECT 'id' || p_partkey AS file_id, p_name || '.jpg' AS name, CAST(100 * p_size + 1 AS INT) AS width, CAST(1001 + 2 * (p_partkey % 350) AS INT) AS height, round_even((100 * p_size + 1) * (1001 + 2 * (p_partkey % 350)) / 1e6::DOUBLE, 2) AS megapixels, p_partkey % 50 AS bytes
FROM part WHERE p_partkey % 3 <> 0 AND p_size % 5 <> 0 AND (100 * p_size + 1) * (1001 + 2 * (p_partkey % 350)) >= 2000000""")
def remote_listing(spark, d):
    """A paginated listing over the parts, with limits pushed down and bytes
    fetched by the tasks that list."""
    remote.register(spark)
    rows = spark.read.format("remote_images").options(folder_id=d, client="lumisift.plans.stand_in:PartListing", page_size="500", min_pixels="2000000", content="true").load()
    return rows.where("mime_type = 'image/png'").select("file_id", "name", "width", "height", "megapixels", F.length("content").cast("long").alias("bytes"))


# -- models

@query("""WITH o AS (SELECT o_custkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '.jpg' AS name, 1 + o_orderkey % 10 AS score, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, name AS best_filename, 'by number' AS reason FROM o WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, name) = 1""")
def best_of_groups(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.format_string("%09d.jpg", "o_orderkey").alias("filename"), F.lit(b"x").alias("content"))
    many = o.groupBy("o_custkey").count().where("count > 1").select("o_custkey")
    return models.pick_one(o.join(many, "o_custkey"), PickingModel, "o_custkey")


@query("""SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN 'image/4x3' END AS mime, CASE WHEN p_size % 7 <> 0 THEN reverse(p_name) END AS output, CASE WHEN p_size % 7 = 0 THEN 'refused' END AS error FROM part""")
def improved_images(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 7 == 0, "refuse").otherwise("p").alias("prompt"), F.encode("p_name", "UTF-8").alias("content"), F.lit("4:3").alias("aspect"))
    return models.improve(rows, TurningModel).select("p_partkey", "mime", F.decode("output", "UTF-8").alias("output"), "error")


@query("""SELECT p_partkey, 'plain: ' || p_name || ', 2 images of ' || (length(p_brand) + 1) || ' bytes' AS response FROM part""")
def refused_schema(spark, d):
    """Asked in JSON mode, a model that has none is asked again without."""
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("prompt"), F.array(F.encode("p_brand", "UTF-8"), F.lit(b"x")).alias("images"))
    return models.ask(rows, NoSchemaModel, {"type": "object"}).select("p_partkey", "response")


@query("""SELECT o_custkey % 100 AS k, count(*) AS n, min('plain: ' || (o_custkey % 100) || ', 0 images of 0 bytes') AS response FROM orders GROUP BY 1""")
def kept_answers(spark, d):
    """Many equal requests: each is asked once, and a second run asks nothing."""
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("k")).select("k", F.col("k").cast("string").alias("prompt"), F.lit(None).cast("array<binary>").alias("images"))
    store = fresh(spark, "answers")
    models.ask_once(rows, NoSchemaModel, store, "m").count()

    def none():
        raise AssertionError("asked again")

    return models.ask_once(rows, none, store, "m").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("response").alias("response"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'edge_completion' WHEN 1 THEN 'square_and_level' ELSE 'tonal_only' END AS repair_mode, CASE event_id % 4 WHEN 0 THEN 'left,top' ELSE '' END AS pad_sides,
  CASE event_id % 4 WHEN 3 THEN 'Failed to parse: sorry, ' || event_type ELSE event_type END AS reason FROM events""")
def repair_plans(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id") % 4
    said = lambda mode, sides: F.concat(F.lit(f'```json\n{{"repair_mode":"{mode}","pad_sides":{sides},"reason":"'), "event_type", F.lit('"}\n```'))
    text = F.when(k == 0, said("edge_completion", '["left","up","top"]')).when(k == 1, said("edge_completion", '["bottom"]')).when(k == 2, said("magic", "null")).otherwise(F.concat(F.lit("sorry, "), "event_type"))
    plan = lenient_json.parse_analysis(text)
    return e.select("event_id", plan["repair_mode"].alias("repair_mode"), F.array_join(plan["pad_sides"], ",").alias("pad_sides"), plan["reason"].alias("reason"))


# -- pictures

@query(f"""WITH p AS ({COLOR_SQL}), b AS ({BANDS_SQL}), r AS (SELECT vec_id, i AS y, x, c, sum(w * v) AS v FROM p JOIN b ON y = j GROUP BY vec_id, i, x, c),
s AS (SELECT vec_id, y, i AS x, c, CAST(round_even(sum(w * v), 0) AS INT) AS v FROM r JOIN b ON x = j GROUP BY vec_id, y, i, c)
SELECT vec_id, 32 AS height, 32 AS width, string_agg(printf('%02X', v), '' ORDER BY y, x, c) AS data FROM s GROUP BY vec_id""")
def shrunk_pictures(spark, d):
    small = pixels.shrunk(F.col("image"), 32, color_bytes)
    return coded_pictures(spark, d).select("vec_id", small.alias("s")).select("vec_id", "s.height", "s.width", F.hex("s.data").alias("data"))


@query(f"""SELECT vec_id, 40 AS image_h, 40 AS image_w, 20 AS face_w, 20 AS face_h, CAST(floor(avg(v) FILTER (WHERE c = 0) * 100 + 0.5) AS BIGINT) AS blue, CAST(floor(avg(v) FILTER (WHERE c = 2) * 100 + 0.5) AS BIGINT) AS red FROM ({COLOR_SQL}) GROUP BY vec_id""")
def hosted_models(spark, d):
    """Detector and encoder over pictures, each made once per task."""
    seen = models.detect_and_embed(coded_pictures(spark, d), QuarterDetector, MeanEmbedder, ["vec_id"], decode=color_bytes)
    mean = lambda i: F.floor(F.col("clip_vector")[i] * 100 + 0.5)
    return seen.select("vec_id", "image_h", "image_w", F.col("faces")[0]["w"].alias("face_w"), F.col("faces")[0]["h"].alias("face_h"), mean(0).alias("blue"), mean(2).alias("red"))


@query("""WITH p AS (SELECT p_partkey, greatest(1, CAST(floor((300 + p_size) * 7 / 100) AS INT)) AS x, greatest(1, CAST(floor((5 + p_partkey % 400) * 7 / 100) AS INT)) AS y, p_size % 4 AS k FROM part)
SELECT p_partkey, CASE WHEN k IN (0, 3) THEN x ELSE 0 END AS l, CASE WHEN k = 3 THEN x ELSE 0 END AS r, CASE WHEN k IN (1, 3) THEN y ELSE 0 END AS t, CASE WHEN k = 3 THEN y ELSE 0 END AS b FROM p""")
def padded_sides(spark, d):
    names = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    k = F.col("p_size") % 4
    sides = F.when(k == 0, names("left")).when(k == 1, names("top", "up")).when(k == 3, names("left", "right", "top", "bottom"))
    pad = pixels.padding(F.lit(5) + F.col("p_partkey") % 400, F.lit(300) + F.col("p_size"), sides, 7)
    return table(spark, d, "part").select("p_partkey", pad.alias("p")).select("p_partkey", F.col("p.left").alias("l"), F.col("p.right").alias("r"), F.col("p.top").alias("t"), F.col("p.bottom").alias("b"))
