import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift.llm import hard_negatives as hn
from lumisift.llm.queries import op13_hard_negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, anchor):
    """Compares every anchor with every row in exact integers."""
    by = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        by[i] = min(by[i], (label, v)) if i in by else (label, v)
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in by.items()}
    out = []
    for a in filter(anchor, whole):
        label, v = whole[a]
        cap = lambda s: max(-hn.LIMIT, min(hn.LIMIT, s))
        scores = sorted((-cap(sum(x * y for x, y in zip(v, w))), i) for i, (_, w) in whole.items() if i != a)
        for s, p in [(-s, i) for s, i in scores if whole[i][0] == label][:5]:
            fits = [(-t, i) for t, i in scores if whole[i][0] != label and 50 * s <= -100 * t <= 95 * s][:3]
            out += [(a, p, k, i, s, t) for k, (t, i) in enumerate(fits, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def test_query_matches_brute_force_and_sql(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    moved = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in rows]
    want = brute(moved, lambda i: i % 50 == 0)
    assert want and got(op13_hard_negatives(spark, small)) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{os.path.join(small, 'embeddings.parquet')}'")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({hn.ORACLE})").fetchall()) == want


@pytest.mark.parametrize("group_rows, block, cells", [(7, 2, 5), (1000, 1000, 1 << 20)])
def test_tiles_do_not_show(spark, monkeypatch, group_rows, block, cells):
    """Small and large tiles give the same; scores are few, so most tie."""
    rng = np.random.default_rng(5)
    rows = [(int(i), int(rng.integers(0, 3)), [float(x) / 256 for x in rng.integers(0, 4, 3)]) for i in range(90)]
    for name, value in (("GROUP_ROWS", group_rows), ("BLOCK_ANCHORS", block), ("CELLS", cells)):
        monkeypatch.setattr(hn, name, value)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(hn.hard_negatives(df, F.col("vec_id") % 9 == 0)) == brute(rows, lambda i: i % 9 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 1, [0.9, 0.5]), (3, 2, [0.8, 0.4]), (4, 2, [0.8, 0.4]), (5, 2, [0.7]), (6, 3, []), (7, 2, [-1.0, -1.0]), (8, None, [1.0, 1.0]), (9, 2, None),
        (10, 1, [nan, 1.0]), (11, 2, [inf, 1.0]), (12, 2, [None, 1.0]), (None, 2, [0.8, 0.4]), (3, 2, [0.8, 0.4]), (13, 2, [0.8, 0.4, 5.0]), (14, 1, [0.8, 0.4, 1.0]), (14, 0, [0.6, 0.4, 1.0]), (-50, 2, [0.9, 0.9]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "g", "s", "anchor", "score", "rank", "positives", "vector")})
    assert got(hn.hard_negatives(df, F.col("vec_id") >= -50)) == brute(rows, lambda i: True)
    assert got(hn.hard_negatives(df, F.col("vec_id") == 999)) == []
    assert got(hn.hard_negatives(df.limit(0), F.col("vec_id") == 0)) == []
    assert hn.hard_negatives(df, F.lit(True)).dtypes[2] == ("rank", "int")


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(8)
    for scale in (2.0**17, 2.0**23, 1e30):  # doubles, places beside scores, scores beyond a long
        rows = [(int(i), int(rng.integers(0, 2)), [float(x) * scale for x in rng.random(4)]) for i in range(40)]
        df = spark.createDataFrame(rows, SCHEMA)
        assert got(hn.hard_negatives(df, F.col("vec_id") % 5 == 0)) == brute(rows, lambda i: i % 5 == 0)
