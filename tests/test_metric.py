import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumisift.operators import grouping, metric
from lumisift.operators.grouping import Limits

SCHEMA = "folder string, ord long, v array<double>"


def rows_of(kind, n=160, dim=5):
    rng = np.random.default_rng(3)
    if kind == "clusters":
        x = rng.normal(size=(8, dim))[rng.integers(0, 8, n)] + rng.normal(scale=0.08, size=(n, dim))
    else:
        x = rng.normal(size=(n, dim))
    if kind != "norms":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "copies":
        x[: n // 2] = x[0]
    return [(f"f{i % 2}", i, [float(c) for c in x[i]]) for i in range(n)] + [("f0", n, [0.0] * dim), ("f0", n + 1, []), ("f0", n + 2, None), (None, n + 3, [1.0] * dim)]


@pytest.mark.parametrize("kind", ["clusters", "spread", "norms", "copies"])
@pytest.mark.parametrize("limit", [0.2, 0.9, 0.999999, 1.0])
def test_every_pair_within_the_limit_once(spark, kind, limit):
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("cell", "ring", "norm_x")})
    pairs = metric.metric_pairs(df, "folder", "ord", "v", limit, pivots=6, tile=7)
    got = [(r.a_ord, r.b_ord) for r in pairs.select("a_ord", "b_ord").collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    want = {(a, b) for f, a, v in rows for g, b, w in rows if f == g and f and a < b and v and w and sum(x * y for x, y in zip(v, w)) >= limit}
    assert want <= set(got)


def test_fewer_pairs_are_made(spark):
    n, dim = 3000, 6
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, dim))[rng.integers(0, 60, n)] + rng.normal(scale=0.02, size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([("f", i, x[i].tolist()) for i in range(n)], SCHEMA)
    pairs = metric.metric_pairs(df, "folder", "ord", "v", 0.99)
    made, close = pairs.count(), int((np.triu(x @ x.T >= 0.99, 1)).sum())
    assert close <= made < 0.12 * n * (n - 1) / 2


def test_only_pairs_near_the_limit_leave_a_tile(spark):
    """Others would each be tested in a row of a join."""
    n, dim = 2000, 4
    x = np.random.default_rng(5).normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([("f", i, x[i].tolist()) for i in range(n)], SCHEMA)
    made = metric.metric_pairs(df, "folder", "ord", "v", 0.97).count()
    close = np.triu(x @ x.T, 1)
    assert int((close >= 0.97).sum()) <= made <= int((close >= 0.97 - 1e-9).sum())


def test_a_tile_of_copies_leaves_in_pieces(monkeypatch):
    monkeypatch.setattr(metric, "PIECE", 4096)
    n = 60
    rows = {"r_ord": [*range(n)] * 2, "r_v": [[1.0, 0.0, 0.0][: 2 + i % 2] for i in range(2 * n)], "lives": [True] * n + [False] * n, "home_": [3] * 2 * n, "cell": [3] * 2 * n}
    pieces = list(metric.tile_product(pa.table(rows), ["ord", "v"], "ord", "v", 1.0, 1.0))
    assert len(pieces) > 10 and max(p.nbytes for p in pieces) < 2 * 4096
    assert sorted((a, b) for p in pieces for a, b in zip(p["l_ord"].to_pylist(), p["v_ord"].to_pylist())) == [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_odd_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert metric.metric_pairs(empty, "folder", "ord", "v", 0.5).count() == 0
    short = spark.createDataFrame([("f", 0, [0.1]), ("f", 1, [0.1])], SCHEMA)
    assert metric.metric_pairs(short, "folder", "ord", "v", 0.5).count() == 0  # no product of these can reach it
    with pytest.raises(ValueError):
        metric.metric_pairs(empty, "folder", "ord", "v", 0.0)


def test_no_angle_rules_out_a_limit_below_zero(spark):
    rows = spark.createDataFrame([("a", f"/{i}", f"x{i}.jpg", [1.0, 0.0] if i else [0.0, 1.0]) for i in range(4)], "folder string, path string, filename string, img_vector array<float>")
    edges = grouping.similarity_edges(grouping.with_sequence(rows), [Limits(0, 0.0), Limits(0, 0.9)], gate=False)
    assert (edges.where("edge_0").count(), edges.where("edge_1").count()) == (6, 3)


def test_edges_bring_their_ids(spark):
    """The edges, which may be many more than the frames, are joined with none."""
    from lumisift.plans import catalog

    plan = catalog.metric_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    tables = [line for line in plan.splitlines() if "Relation" in line]
    assert not any("embedding" in line for line in tables), plan  # only what the pair join stored is read
