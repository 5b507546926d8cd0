"""Hard negatives by a full sort of each anchor's scores.

Rows are dealt into groups by a hash of their id and anchors into blocks, so a
tile of one group and one block fits a task however many rows there are. In a
tile an anchor's integer scores against all rows of the group are sorted by
score and id; each positive's upper limit is found by binary search, and the
next rows of other labels down to the lower limit are read off. A tile hands on
no more than the few rows that can be among an anchor's answer, and the best of
all its tiles are the answer, exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored

#: Vectors are compared as integers, in units of one part of so many.
SCALE = 256
#: Positives of an anchor and negatives of a positive.
POSITIVES, NEGATIVES = 5, 3
#: A negative scores between LEAST and MOST hundredths of its positive.
LEAST, MOST = 50, 95
#: Most rows of a group and anchors of a block; least rows worth a group.
GROUP_ROWS, BLOCK_ANCHORS, LEAST_ROWS = 1 << 16, 1 << 14, 256
#: Scores that are sorted at once.
CELLS = 1 << 21
#: Scores beyond this count as this.
LIMIT = 1 << 62
_NONE = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    """Whether a vector has neither nulls nor components without a value."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Whole numbers of the vectors as doubles, shorter ones ended by zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def integer_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact, held within ``LIMIT``."""
    top = [float(np.abs(x).max()) if x.size else 0.0 for x in (anchors, rows)]
    if top[0] * top[1] * max(1, anchors.shape[1]) < 1 << 53:
        return (anchors @ rows.T).astype(np.int64)
    a, b = ([[int(v) for v in r] for r in x] for x in (anchors, rows))
    return np.array([[max(-LIMIT, min(LIMIT, sum(map(int.__mul__, x, y)))) for y in b] for x in a], dtype=np.int64).reshape(len(a), len(b))


class _Tile:
    """The rows of a group, by id, and the anchors of a block."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        rows = rows.sort_by("id")
        width = max([0, *(int(np.diff(t.column("vector").combine_chunks().offsets.to_numpy()).max()) for t in (anchors, rows) if t.num_rows)])
        self.ids, self.labels = (rows.column(c).to_numpy() for c in ("id", "label"))
        self.anchor_ids, self.anchor_labels = (anchors.column(c).to_numpy() for c in ("id", "label"))
        self.rows, self.anchors = (_matrix(t.column("vector").combine_chunks(), width) for t in (rows, anchors))

    def sorted_keys(self, same: bool):
        """Per block of anchors: its first place and, per anchor, the keys of
        the rows of the same label (itself apart) or of the others, sorted by
        score, highest first, and id. ``divmod(key, rows)`` is the negated score
        and the row; ``_NONE`` fills up."""
        n = len(self.ids)
        step = max(1, CELLS // max(1, n))
        for at in range(0, len(self.anchor_ids), step):
            scores = integer_scores(self.anchors[at:at + step], self.rows)
            wanted = (self.labels == self.anchor_labels[at:at + step, None]) == same
            if same:
                wanted &= self.ids != self.anchor_ids[at:at + step, None]
            if not scores.size or np.abs(scores).max() < LIMIT // n:
                keys = np.where(wanted, -scores * n + np.arange(n), _NONE)
                keys.sort(axis=1)
                yield at, keys, lambda k: (-(k // n), k % n), lambda score: -score * n
            else:  # too large for one key: places in the sorted order, with the scores beside them
                order = np.argsort(np.where(wanted, -scores, _NONE), axis=1, kind="stable")
                yield at, (order, np.take_along_axis(scores, order, 1), wanted.sum(axis=1)), None, None


def _best_same(tile: _Tile, k: int) -> list[tuple]:
    out = []
    for at, keys, split, _ in tile.sorted_keys(True):
        if split:
            top = keys[:, :k]
            a, j = np.nonzero(top != _NONE)
            score, row = split(top[a, j])
        else:
            order, scores, count = keys
            a, j = np.nonzero(np.arange(min(k, order.shape[1])) < count[:, None])
            score, row = scores[a, j], order[a, j]
        out.append((tile.anchor_ids[at + a], score, tile.ids[row]))
    return out


def _best_other(tile: _Tile, positives: list, k: int) -> list[tuple]:
    out = []
    for at, keys, split, key in tile.sorted_keys(False):
        for i in range(len(keys) if split else len(keys[0])):
            for p in positives[at + i]:
                high, low = MOST * p["score"] // 100, -(-LEAST * p["score"] // 100)
                if high < low:
                    continue
                if split:
                    start = np.searchsorted(keys[i], key(high))
                    found = keys[i][start:start + k]
                    score, row = split(found[found != _NONE])
                else:
                    order, scores, count = keys[0][i], keys[1][i], keys[2][i]
                    start = np.searchsorted(-scores[:count], -high)
                    score, row = scores[start:min(count, start + k)], order[start:min(count, start + k)]
                fits = score >= low
                m = int(fits.sum())
                out.append((np.full(m, tile.anchor_ids[at + i]), np.full(m, p["id"]), np.full(m, p["score"]), tile.ids[row[fits]], score[fits]))
    return out


def _table(parts: list[tuple], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.table([pa.array(c) for c in columns], names=names)


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: for the rows of ``vectors`` that ``is_anchor`` names, each
    of their first ``positives`` other rows of the same label, and its first
    ``negatives`` rows of other labels whose score is within the limits.

    Higher scores come first, ties by the smaller id. Rows with a null id,
    label or vector, or a component that is null, infinite or not a number take
    no part. Rows that share an id count as one, the one with the least label
    and then the least vector. Shorter vectors count as ended by zeros; scores
    beyond 2**62 count as that. Other columns are not looked at. Without
    anchors, and for an empty table, the result is empty.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    rows = stored(rows.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r")).select("id", "r.*"), "vectors")
    n, anchor_count = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    groups = max(1, -(-n // GROUP_ROWS), min(4 * shuffle_partitions(spark), n // LEAST_ROWS))
    blocks = max(1, -(-anchor_count // BLOCK_ANCHORS))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def dealt(seed: int, count: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count)).cast("int")

    side = rows.select("id", "label", "vector", dealt(1, groups).alias("g"), every(blocks).alias("s"))
    chosen = rows.where("anchor").select("id", "label", "vector", dealt(2, blocks).alias("s"))
    names = ["anchor_id", "score", "id"]

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        return _table(_best_same(_Tile(left, right), positives) if left.num_rows and right.num_rows else [], names)

    def tiles(anchors: DataFrame, run, schema: str) -> DataFrame:
        return anchors.withColumn("g", every(groups)).groupBy("g", "s").cogroup(side.groupBy("g", "s")).applyInArrow(run, schema)

    first = W.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    near = tiles(chosen, nearest, "anchor_id long, score long, id long").withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives)
    pairs = near.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))  # a few of each
    asked = stored(chosen.join(pairs, F.col("id") == F.col("anchor_id")).select("id", "label", "vector", "s", "positives"), "positives")
    columns = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def mined(left: pa.Table, right: pa.Table) -> pa.Table:
        return _table(_best_other(_Tile(left, right), left.column("positives").to_pylist(), negatives) if left.num_rows and right.num_rows else [], columns)

    best = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = tiles(asked, mined, ", ".join(f"{c} long" for c in columns)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same from all scores of all anchors.
ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (SELECT a.vec_id AS anchor, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS INT) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3
"""
