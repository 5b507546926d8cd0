"""Groups that grow with a stream equal those of all files at once."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumisift.operators import grouping
from lumisift.operators.grouping import Limits
from lumisift.streaming import groups

SCHEMA = "folder string, path string, filename string, img_vector array<float>, color_thumb array<float>, hash long"
LIMITS = [Limits(20, 0.9, 0.5, 8), Limits(4, 0.8)]


def frame(folder, i, degrees, color=0.0, hash_=0, name=None):
    name = name or f"IMG_{i:04d}.jpg"
    return (folder, f"/{folder}/{name}", name, [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))], [color], hash_)


def run(spark, tmp_path, batches):
    """Each batch is one file; the query ends after all and starts anew."""
    source = str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        groups.group_stream(stream, LIMITS, str(tmp_path / "changes"), str(tmp_path / "check")).awaitTermination()
    return [{(r.folder, r.path): (r.group_id, r.group_size) for r in groups.current_groups(spark, str(tmp_path / "changes"), k).collect()} for k in (0, 1)]


def at_once(spark, rows):
    seq = grouping.with_sequence(spark.createDataFrame(rows, SCHEMA))
    edges = grouping.linked(seq, LIMITS)
    out = []
    for k in (0, 1):
        found = grouping.numbered_groups(seq, grouping.components(edges.where(f"edge_{k}")), "g", "n")
        out.append({(r.folder, r.path): (r.g, r.n) for r in found.collect()})
    return out


def test_late_files_bridge_groups(spark, tmp_path):
    first = [frame("a", 1, 0), frame("a", 3, 40), frame("a", 60, 0), frame("a", 0, 0, name="beach.jpg"), frame("b", 2, 20)]
    second = [frame("a", 4, 44), frame("a", 61, 1, hash_=2**63 - 1)]
    late = [frame("a", 2, 20), frame("a", 1, 0), frame("a", 62, 90)]  # 20 degrees from both, a repeated file, one apart
    got = run(spark, tmp_path, [first, second, late])
    rows = list(dict.fromkeys(map(repr, first + second + late)))
    assert got == at_once(spark, [eval(r) for r in rows])
    assert got[0]["a", "/a/IMG_0001.jpg"] == got[0]["a", "/a/IMG_0004.jpg"] == (1, 4)
    assert spark.conf.get(groups.PROVIDER) != groups.ROCKS


def test_any_order_of_files(spark, tmp_path):
    rng = random.Random(4)
    rows = [frame(rng.choice("ab"), i, rng.choice((0, 15, 30, 45, 90)), rng.choice((0.0, 0.4, 0.8)), rng.choice((0, 15, -1))) for i in range(60)]
    want = at_once(spark, rows)
    rng.shuffle(rows)
    assert run(spark, tmp_path, [rows[:25], rows[25:50], rows[50:]]) == want


def test_what_is_known_is_not_compared_again(monkeypatch):
    """A later batch compares its own frames with their neighbours alone."""
    import pandas as pd

    class Map(dict):
        getValue, containsKey, updateValue, removeKey = dict.get, dict.__contains__, dict.__setitem__, dict.pop

    class Handle:
        def getMapState(self, *a):
            return Map()

    calls = []
    real = groups.close
    monkeypatch.setattr(groups, "close", lambda a, b, c: calls.append((a.path, b.path)) or real(a, b, c))
    forest = groups.FrameForest([Limits(4, 0.9)])
    forest.init(Handle())

    def feed(numbers):
        rows = pd.DataFrame({"path": [f"/{i:04d}" for i in numbers], "idx": numbers, "img_vector": [[1.0, 0.0]] * len(numbers), "color_thumb": [[]] * len(numbers), "hash": [0] * len(numbers)})
        calls.clear()
        return [f for f in forest.handleInputRows(("a", "p"), iter([rows]), None)]

    feed(list(range(0, 2000, 2)))
    changes = feed([501])
    assert len(calls) <= 3 * 5 and all(a == "/0501" for a, _ in calls)
    assert len(changes[0].query("path.notna()")) == 1  # only the new frame moved
