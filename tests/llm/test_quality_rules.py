import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumisift.llm import quality_rules as qr
from lumisift.llm.queries import op1_quality_rules


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    twice = {x for x, n in Counter(windows).items() if n > 1}
    hit = {j for i, x in enumerate(windows) if x in twice for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))


def got(df):
    return sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in df.collect())


def want(rows):
    return sorted(repr((i, *base(t))) for i, t in rows)


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = op1_quality_rules(spark, sf).cache()
    assert got(out) == want(rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    verdicts = {r.doc_id: r.kept for r in out.collect() if not r.base_failed}
    good = [verdicts[i] for i, q in labels.items() if q == 1 and i in verdicts]
    low = [verdicts[i] for i, q in labels.items() if q == 0 and i in verdicts]
    assert sum(good) >= 0.98 * len(good) and sum(low) <= 0.3 * len(low)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 0), (5, None)], "doc_id long, quality int")
    out = qr.judge(odd, labels)
    assert got(out) == want([tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert qr.judge(empty, labels).count() == 0
    assert qr.judge(odd, labels.limit(0)).count() == odd.count()
    kept = qr.rule_filtered(odd, labels)
    assert kept.columns == odd.columns and kept.count() == out.where("kept").count()


def test_rules_recover_planted_thresholds_and_generalise(spark):
    rows = [(i, "word " * 30 + " ".join(f"w{i}x{j}" for j in range(60)) + (" $$" * (12 if i % 5 == 0 else i % 3)), 0 if i % 5 == 0 else 1) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").where("doc_id >= 0")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 400], "doc_id long, quality int")
    statistics = qr.text_statistics(docs).withColumn("base_failed", F.lit(False))
    rules = qr.learn_rules(statistics, labels)
    assert 1 <= len(rules.rules) <= 2 and "reject if" in str(rules)
    held = statistics.where("doc_id >= 400").select("doc_id", rules.rule().isNotNull().alias("low")).collect()
    assert all(r.low == (r.doc_id % 5 == 0) for r in held)


def test_rules_come_from_the_whole_table(spark):
    rows = [(i, "word " * 5 + " ".join(f"w{i}x{j}" for j in range(60)) + (" $$" * (12 if i % 5 == 0 else i % 3))) for i in range(600)]
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1) for i in range(400)], "doc_id long, quality int")
    left = whole.where("doc_id >= 400 or doc_id % 5 <> 0")  # an earlier stage took the labelled low ones
    assert qr.rule_filtered(left, labels).count() == left.count()
    assert {r.doc_id for r in qr.rule_filtered(left, labels, whole).collect()} == {i for i in range(600) if i % 5}


def test_only_builtin_functions(spark, small):
    plan = op1_quality_rules(spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rules_join_conditions(spark):
    """Low rows lie in a corner that no single threshold cuts out."""
    rows = [(i, float(i % 10), float(i // 10 % 10)) for i in range(1500)]
    features = [F.when(F.lit(k) == 2, F.col("a")).when(F.lit(k) == 5, F.col("b")).otherwise(0.0) for k in range(len(qr.FEATURES))]
    statistics = spark.createDataFrame(rows, "doc_id long, a double, b double").select("doc_id", F.lit(False).alias("base_failed"), F.array(*features).alias("features"))
    labels = spark.createDataFrame([(i, 0 if a > 5 and b > 6 else 1) for i, a, b in rows if i < 1000], "doc_id long, quality int")
    rules = qr.learn_rules(statistics, labels)
    assert any(len(rule) > 1 for rule in rules.rules)
    low = {r.doc_id for r in statistics.where(rules.rule().isNotNull()).select("doc_id").collect()}
    assert low == {i for i, a, b in rows if a > 5 and b > 6}


def test_verdicts_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = qr.judge(docs, labels.where("doc_id % 2 = 0"))
    held = out.where("NOT base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept"), F.count(F.lit(1)).alias("n")).collect()
    kept = {r.quality: r.kept for r in held}
    assert kept[1] >= 0.99 and kept[0] <= 0.05


def covering(rows, edges):
    """The decision list by plain search over all thresholds, of ``(features,
    bad, fold)`` rows."""
    def gain(p, n, p0, n0):
        return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0

    def holds(c, x):
        return x[c[0]] > c[2] if c[1] else x[c[0]] <= c[2]

    found = []
    while True:
        left = [r for r in rows if not any(all(holds(c, r[0]) for c in rule) for rule in found)]
        grow, check, rule = [r for r in left if r[2] < 2], [r for r in left if r[2] == 2], []
        while True:
            p0, n0 = (sum(r[1] == k for r in grow) for k in (1, 0))
            best, top = None, 1e-9
            for f, cuts in enumerate(edges):
                for e in cuts:
                    for above in (False, True):
                        some = [r for r in grow if (r[0][f] > e) == above]
                        p = sum(r[1] for r in some)
                        n = len(some) - p
                        if n < n0 and (g := gain(p, n, p0, n0)) > top:
                            best, top = (f, above, e), g
            if best is None:
                break
            rule.append(best)
            grow = [r for r in grow if holds(best, r[0])]
        if not rule:
            return found
        worth = []
        for size in range(1, len(rule) + 1):
            some = [r for r in check if all(holds(c, r[0]) for c in rule[:size])]
            p = sum(r[1] for r in some)
            worth.append((p, len(some) - p))
        score = [(p - n) / max(1, p + n) for p, n in worth]
        size = score.index(max(score)) + 1
        p, n = worth[size - 1]
        if p < 5 or p < 0.95 * (p + n):
            return found
        found.append(rule[:size])


def test_verdicts_match_brute_force(spark):
    """The learned list, and so ``kept``, against plain covering."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: int(r.quality == 0) for r in labels.collect() if r.quality is not None}
    statistics = {r.doc_id: r for r in qr.text_statistics(docs).collect()}
    fold = {r.doc_id: r.fold for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)).alias("fold")).collect()}
    rows = [(list(s.features), known[i], fold[i]) for i, s in statistics.items() if i in known and not s.base_failed]
    share = [k / 24 for k in range(1, 24)] + [0.005, 0.01, 0.02, 0.98, 0.99, 0.995]
    edges = []
    for f in range(len(qr.FEATURES)):
        seen = set()
        for bad in (0, 1):
            values = sorted(r[0][f] for r in rows if r[1] == bad)
            seen |= {values[max(0, math.ceil(q * len(values)) - 1)] for q in share}
        seen = sorted(seen)
        edges.append([(a + b) / 2 for a, b in zip(seen, seen[1:])])
    rules = covering(rows, edges)
    learned = qr.learn_rules(qr.text_statistics(docs), labels)
    assert [[(c.feature, c.above, c.edge) for c in r] for r in learned.rules] == [[(f, a, pytest.approx(e)) for f, a, e in r] for r in rules] and rules
    out = {r.doc_id: r.kept for r in op1_quality_rules(spark, sf).collect()}
    for i, s in statistics.items():
        rejected = any(all(s.features[f] > e if above else s.features[f] <= e for f, above, e in rule) for rule in rules)
        assert out[i] == (not s.base_failed and not rejected)
