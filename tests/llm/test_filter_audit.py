import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lumisift.llm import filter_audit as fa
from lumisift.llm.queries import op12_filter_audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """Applies every order to every document."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    failing = []
    for i, text, lang in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and text in least and least[text] < i,
        }
        failing.append((lang or "", "".join(f for f in "ABCDE" if fails[f]), i in good, i in toxic))
    out = []
    for part in {f[0] for f in failing}:
        rows, shapley = [], Counter()
        for order in permutations("ABCDE"):
            alive = [f for f in failing if f[0] == part]
            every = alive
            for step, letter in enumerate(order, 1):
                gone = [f for f in alive if letter in f[1]]
                alive = [f for f in alive if letter not in f[1]]
                redundant = sum(letter in f[1] and not f[1].isdisjoint(order[:step - 1]) if isinstance(f[1], set) else letter in f[1] and any(x in f[1] for x in order[:step - 1]) for f in every)
                shapley[letter] += len(gone)
                rows.append((part, "".join(order), step, len(alive), len(gone), redundant, sum(f[1] == letter for f in every), sum(f[2] for f in gone), sum(f[3] for f in gone), letter))
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def test_query_matches_brute_force_and_sql(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    want = brute(docs, labels)
    assert got(op12_filter_audit(spark, small)) == want
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({fa.ORACLE})").fetchall()) == want


def test_odd_rows(spark, odd, empty):
    more = [(20 + i, "Same text " * 3, lang, "a", 1) for i, lang in enumerate(["en", "fr", None, "", "en"])] + [(None, "Same text " * 3, "en", "a", 1), (21, "Same text " * 3, "fr", "a", 1), (20, "Same text " * 3, "de", "a", 1)]
    rows = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    rows = rows.withColumns({c: F.lit("clash") for c in ("digest", "own", "part", "mask", "n", "good", "id", "cells")})
    said = [(1, 1, 0), (20, 0, 1), (20, 1, None), (None, 1, 1), (21, None, 1), (8, 1, 1), (8, 1, 1)]
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    assert got(fa.audit_filters(rows, labels)) == brute([tuple(r) for r in rows.select("doc_id", "text", "lang").collect()], said)
    assert fa.audit_filters(empty, labels).count() == 0
    assert fa.audit_filters(odd, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_matrices_state_each_outcome_once():
    m = fa.outcomes()
    assert all(x.shape == (32, 600) and x.dtype == np.int64 for x in m.values())
    # a document is kept, or removed at one step of an order
    assert (m["removed"].reshape(32, 120, 5).sum(axis=2) + m["kept"][:, 4::5] == 1).all()


def test_copies_are_counted_before_they_meet(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    r = fa.audit_filters(docs, labels).where("filter_order = 'EABCD' AND step = 1").first()
    assert (r.kept, r.removed, r.good_lost) == (20_000 - 6666, 6666, 1)
