"""Calls of models: one rate for all tasks, and no prompt answered twice."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift import models
from lumisift.config import CurationConfig
from lumisift.plans import stage1
from lumisift.sinks import outputs

from tests import fakes


def counting(log, die_at=None, fail=()):
    """A model that writes down its calls; the process that makes call
    ``die_at`` dies once."""

    class Model:
        def __call__(self, prompt, images, schema=None):
            import os
            import time

            with open(log, "a") as out:
                out.write(f"{time.time()}\t{prompt}\n")
            if prompt in fail:
                raise models.ModelError("refused", 404)
            if die_at is not None and len(open(log).read().splitlines()) == die_at and not os.path.exists(log + ".died"):
                open(log + ".died", "w").close()
                raise RuntimeError("killed")
            return f"answer to {prompt}"

    return Model


def calls(log):
    return [line.split("\t") for line in Path(log).read_text().splitlines()] if Path(log).exists() else []


def requests(spark, n, parts=4):
    return spark.range(n).repartition(parts).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"), F.lit(None).cast("array<binary>").alias("images"))


def test_one_rate_for_all_tasks(spark, tmp_path):
    log = str(tmp_path / "log")
    models.ask(requests(spark, 48), counting(log), per_second=16, callers=4).collect()
    times = sorted(float(t) for t, _ in calls(log))
    assert len(times) == 48
    most = max(sum(t <= x < t + 1 for x in times) for t in times)
    assert most <= 16 + 4  # even steps of four tasks that begin within a moment of each other
    assert times[-1] - times[0] > 2


def test_pace_of_a_task():
    now = [0.0]
    waits = []

    def wait(s):
        waits.append(round(s, 3))
        now[0] += s

    pace = models.Pace(10, 5, 7, clock=lambda: now[0], wait=wait)
    for _ in range(3):
        pace()
    now[0] += 9
    pace()
    assert waits == [0.2, 0.5, 0.5]
    free = models.Pace(None, 5, 1, wait=waits.append)
    free()
    assert len(waits) == 3


def test_no_answered_prompt_is_asked_again(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "answers")
    rows = requests(spark, 40).unionByName(requests(spark, 10))  # ten prompts come twice
    with pytest.raises(Exception, match="killed"):
        models.ask_once(rows, counting(log, die_at=30), store, "m", every=1, callers=2).count()
    before = [p for _, p in calls(log)]
    assert len(before) == len(set(before)) >= 30
    kept = {r.key for r in spark.read.parquet(store).collect()}
    out = models.ask_once(rows, counting(log), store, "m", callers=2).collect()
    again = [p for _, p in calls(log)][len(before):]
    assert len(out) == 50 and all(r.response == f"answer to {r.prompt}" and r.error is None for r in out)
    assert len(kept) >= 28 and len(again) == 40 - len(kept) and len(set(again)) == len(again)
    models.ask_once(rows, counting(log), store, "m").collect()
    assert len(calls(log)) == len(before) + len(again)
    models.ask_once(rows.limit(3), counting(log), store, "another").collect()  # another model is asked anew
    assert len(calls(log)) > len(before) + len(again)


def test_failures_and_images_of_answers(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "answers")
    rows = spark.createDataFrame([("a", [b"1"]), ("a", [b"2"]), ("a", None), ("b", [None])], "prompt string, images array<binary>")
    for n in (4, 5):  # the failed one is asked again, the others are known
        out = models.ask_once(rows, counting(log, fail=("b",)), store, "m").collect()
        assert len(calls(log)) == n and sorted((r.prompt, r.response, r.error) for r in out if r.prompt == "b") == [("b", None, "refused")]
    assert models.ask_once(rows.limit(0), counting(log), store, "m").count() == 0


def test_a_retried_task_goes_on(tmp_path):
    """Shelves as a second attempt of a task finds them."""
    store = str(tmp_path)
    models._put(store, 3, [("k1", "a", 0.1), ("k2", "b", 0.2)])
    models._put(store, 3, [("k3", "c", 0.3)])
    (tmp_path / "shelf=3" / ".half").write_bytes(b"cut")
    assert models._known(store, 3) == {"k1": ("a", 0.1), "k2": ("b", 0.2), "k3": ("c", 0.3)} and models._known(store, 4) == {}


def test_counters_are_taken_while_the_log_is_written(spark, tmp_path):
    from lumisift.operators.selection import run_stats, summary_text

    rows = [(f"{i:03d}.jpg", i % 5 > 0, i % 5 > 1, i % 5 > 2, i % 5 > 3, "selected" if i % 7 == 0 else "rejected") for i in range(200)]
    log = spark.createDataFrame(rows, "filename string, decode_ok boolean, passed_resolution boolean, passed_opencv boolean, passed_clip boolean, status string").repartition(6)
    counted = outputs.write_selection_log(log, str(tmp_path / "log"))
    assert counted == run_stats(outputs.log_rows(log)).first().asDict() and counted["total_listed"] == 200
    assert "kept: 29" in summary_text(counted)
    assert len(list((tmp_path / "log").glob("part-*.csv"))) == 1


def test_a_missing_scorer_is_found_once(spark):
    FakeEmbedder = fakes.FakeEmbedder
    img = np.zeros((4, 5, 3), np.uint8)
    images = spark.createDataFrame([("/a", (4, 5, 3, bytearray(img.tobytes()))), ("/b", (-1, -1, -1, bytearray()))], "path string, image struct<height:int,width:int,nChannels:int,data:binary>")
    photos = spark.createDataFrame([("/a",), ("/b",), ("/c",)], "path string")
    prompts = spark.createDataFrame([(FakeEmbedder().text("good").tolist(), FakeEmbedder().text("bad").tolist())], "pos array<double>, neg array<double>")
    scored, there = stage1.with_scores(photos, images, FakeEmbedder, prompts)
    got = {r.path: r.clip_score for r in scored.collect()}
    assert there and 0 < got["/a"] < 1 and got["/b"] == got["/c"] == 0
    tries = []

    def broken():
        tries.append(1)
        raise OSError("no weights")

    scored, there = stage1.with_scores(photos, images, broken, prompts)
    assert not there and {r.clip_score for r in scored.collect()} == {0.0} and len(tries) == 1
    assert CurationConfig().clip_threshold > 0
