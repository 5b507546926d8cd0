"""Filter interaction audit: what every order of a chain of filters keeps.

Each document becomes a mask of the filters that it fails. Masks are counted
per part of the corpus, and of the good and the toxic documents: a histogram of
32 numbers each. What a step of an order keeps, removes, finds removed before
or fails alone depends on the mask only, so the outcomes of all orders and steps
are four fixed integer matrices of 32 by 600, and the audit is the product of
the stacked histograms with them. Texts are looked at once.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored, trimmed_split

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
BREAKS = r"[\x20\x09-\x0D]+"
MIN_WORDS = 200
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
OUTPUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_failures(text: Column) -> Column:
    """The bits of the filters that look at one text alone, A to D."""
    def test(words: Column) -> Column:
        n = F.size(words)
        few = n < MIN_WORDS
        repetitive = 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long")
        loud = 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 3 * F.length(text).cast("long")
        marked = text.rlike(r"[#$%&*|]")
        return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate((few, repetitive, loud, marked))), F.lit(0))

    return let(trimmed_split(text, BREAKS), test)


@lru_cache(maxsize=1)
def outcomes() -> dict[str, np.ndarray]:
    """Matrices of ``MASKS`` by ``STEPS``: 1 where a document of a mask has the
    outcome at a step of an order."""
    masks = np.arange(MASKS)
    kept, removed, redundant, unique = (np.zeros((MASKS, STEPS), dtype=np.int64) for _ in range(4))
    at = 0
    for order in ORDERS:
        before = 0
        for letter in order:
            bit = 1 << FILTERS.index(letter)
            alive, fails = (masks & before) == 0, (masks & bit) != 0
            kept[:, at], removed[:, at] = alive & ~fails, alive & fails
            redundant[:, at], unique[:, at] = ~alive & fails, masks == bit
            before |= bit
            at += 1
    return {"kept": kept, "removed": removed, "redundant": redundant, "unique_fails": unique}


@lru_cache(maxsize=1)
def _steps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, step and filter number of each column of the matrices."""
    order = np.repeat(np.array(ORDERS), len(FILTERS))
    step = np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS))
    filters = np.array([FILTERS.index(c) for o in ORDERS for c in o])
    return order, step, filters


def audited(histograms: np.ndarray) -> dict[str, np.ndarray]:
    """Outcomes of ``histograms`` (parts by all, good, toxic by masks), parts by
    steps."""
    m = outcomes()
    parts = len(histograms)
    rows = histograms.reshape(parts * 3, MASKS)
    lost = (rows @ m["removed"]).reshape(parts, 3, STEPS)
    whole = histograms[:, 0]
    filters = _steps()[2]
    per_filter = np.stack([lost[:, 0][:, filters == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    return {
        "kept": whole @ m["kept"], "removed": lost[:, 0], "redundant": whole @ m["redundant"], "unique_fails": whole @ m["unique_fails"],
        "good_lost": lost[:, 1], "toxic_lost": lost[:, 2], "shapley": per_filter[:, filters],
    }


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents per part and mask of failed
    filters.

    A text is read once and replaced by its digest and own failures. E needs the
    smallest id of each digest only; copies are counted before they are
    exchanged, by part, label and id, so a text that a third of all rows share
    is a few rows wherever it goes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), own_failures(text).alias("own"))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.join(said, F.col("id") == F.col("label_id"), "left").select("id", "part", "digest", "own", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    kinds = ["digest", "part", "own", "good", "toxic"]
    once = known.groupBy("id", *kinds).agg(F.count(F.lit(1)).alias("n"))
    # per kind of copies: how many rows, and of the smallest id how many
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "n"))
    nameless = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
    copies = stored(once.groupBy(*kinds).agg(F.sum("n").alias("n"), first.alias("first"), nameless.alias("nameless")).select(*kinds, "n", "nameless", F.col("first.id").alias("id"), F.col("first.n").alias("of_id")), "copies")
    least = copies.groupBy(F.col("digest").alias("of")).agg(F.min("id").alias("least"))
    split = copies.join(least, F.col("digest") == F.col("of"))
    stays = F.col("nameless") + F.when(F.col("id") == F.col("least"), F.col("of_id")).otherwise(0)
    bit = 1 << FILTERS.index("E")
    states = F.explode(F.array(F.struct(F.col("own").alias("mask"), stays.alias("n")), F.struct((F.col("own") + bit).alias("mask"), (F.col("n") - stays).alias("n"))))
    each = split.select("part", "good", "toxic", states.alias("s")).select("part", "good", "toxic", "s.*").where("n > 0")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step, as in ``OUTPUT``.

    A null text counts as empty: it fails A alone, and E if a smaller id is
    empty too. A null part is the empty one. A null id is never larger than
    another, so such a row passes E; rows that repeat an id and its text share
    their verdicts. A document is good or toxic if any of its labels says so;
    labels of null ids are dropped. A very long text is looked at whole. Other
    columns are not looked at. An empty table gives an empty result.
    """
    counts = mask_counts(docs, labels, id_col, text_col, part_col)
    cells = [F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for c in ("n", "good", "toxic") for m in range(MASKS)]
    parts = counts.groupBy("part").agg(F.array(*cells).alias("cells"))

    def run(batches):
        order, step, _ = _steps()
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            out = audited(values.reshape(batch.num_rows, 3, MASKS))
            n = batch.num_rows
            part = batch.column(0).take(pa.array(np.repeat(np.arange(n), STEPS)))
            columns = [part, pa.array(np.tile(order, n)), pa.array(np.tile(step, n), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(v.ravel()) for v in out.values()], names=["part", "filter_order", "step", *out])

    return parts.mapInArrow(run, OUTPUT)


#: The same from single documents, without masks or matrices.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
least AS (SELECT coalesce(text, '') AS text, min(doc_id) AS least FROM documents GROUP BY 1),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(words.text, '[^A-Z]', '', 'g')) > 3 * length(words.text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(words.text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN words.doc_id > least THEN 'E' ELSE '' END AS fails
  FROM words JOIN least ON words.text = least.text LEFT JOIN l ON words.doc_id = l.doc_id
), c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, step, substr(o, step, 1) AS filter, substr(o, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, o, step, filter, sum(CASE WHEN translate(fails, before, '') = fails AND NOT contains(fails, filter) THEN n ELSE 0 END) AS kept, sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, filter) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN translate(fails, before, '') <> fails AND contains(fails, filter) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, filter) THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, filter) THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, o, step, filter
)
SELECT part, o AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
"""
