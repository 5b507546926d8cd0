import math
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumisift.llm import quality_classifier as qc
from lumisift.llm.queries import op3_quality_classifier

def shares(spark, sf, known, judged):
    """Share rejected by (quality, toxic)."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = qc.classify(docs, labels.where(known)).join(labels.where(judged), "doc_id")
    return {(r.quality, r.toxic): r.bad for r in out.groupBy("quality", "toxic").agg(F.avg((~F.col("kept")).cast("double")).alias("bad")).collect()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_labelled_rows(spark, sf):
    got = shares(spark, sf, F.lit(True), F.lit(True))
    assert got[1, 0] < 0.02 and got[0, 0] > 0.9 and got[1, 1] > 0.95


def test_held_out_accuracy(spark):
    held = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(4)) == 0
    got = shares(spark, "sf0.1", ~held, held)
    assert got[1, 0] < 0.02 and got[0, 0] > 0.9 and got[1, 1] > 0.95


def test_query_covers_all(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = op3_quality_classifier(spark, small)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, None, None), (None, 0, 1), (6, None, 1)], "doc_id long, quality int, toxic int")
    out = qc.classify(odd, labels)
    assert out.columns == ["doc_id", "site_low", "p_low", "site_toxic", "p_toxic", "p_bad", "kept"]
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, (r.doc_id for r in odd.collect())))
    assert all(0 <= r.p_bad <= 1 and r.kept == (r.p_bad < 0.5) for r in out.collect())
    assert qc.classify(odd, labels.limit(0)).where("kept").count() == odd.count()
    assert qc.classify(empty, labels).count() == 0
    assert qc.classifier_filtered(odd, labels).columns == odd.columns


def test_sites_shrink_toward_their_parents(spark):
    rows = [(i, "h1" if i < 400 else "h2", "p" if i % 2 else "q") for i in range(800)] + [(900, "h3", "p"), (901, "h1", "rare")]
    labels = [(i, int(i < 200), 0) for i, _, _ in rows[:-2]] + [(900, 1, 0), (901, 1, 0)]
    sites, overall = qc.site_rates(spark.createDataFrame(rows, "doc_id long, host string, path string"), spark.createDataFrame(labels, "label_id long, low int, toxic int"))
    rate = {(r.host, r.path): r.low_rate for r in sites.collect()}
    assert abs(overall["low"] - 203 / 822) < 1e-9
    assert 0.45 < rate["h1", "p"] < 0.55 and rate["h2", "q"] < 0.05  # plenty of labels
    assert rate["h3", "p"] < 0.9 and rate["h1", "rare"] < 0.9  # one label moves little


def test_counts_and_weights_against_brute_force(spark):
    sample = [("idiot one two", 0, 0, 1), ("idiot three", 1, 0, 1), ("one two three", 2, 0, 0), ("two four", 0, 1, 0), (None, 1, 0, 0), ("### ###", 2, 1, 1)] * 4
    rows = spark.createDataFrame(sample, "text string, fold int, low int, toxic int")
    counts = qc.bucket_counts(rows)
    want = {}
    for text, fold, *bad in sample:
        words = (text or "").lower().split()
        for b in {b for w in words for b in qc.word_buckets(w)} | set(qc.statistic_buckets(text or "", words, len(set(words)))):
            row = want.setdefault(b, [0] * 6)
            for k, hit in enumerate((1, *bad)):
                row[k] += hit * (fold < 2)
                row[k + 3] += hit
    for some in (counts, qc.bucket_counts(rows, small=True)):
        assert {r[0]: list(r[1:]) for r in some.collect()} == want
    sizes = {"n": 24, "low": 8, "toxic": 12, "n_a": 16, "low_a": 4, "toxic_a": 8}
    got = {r.bucket: r for r in qc.bucket_weights(counts, sizes).collect()}
    for column, at, h, rate in (("for_toxic", 3, 2, 12 / 24), ("against_low", 3, 1, 8 / 24), ("for_low_a", 0, 1, 4 / 16)):
        def gain(n, k):
            return sum(x * math.log(x / n / p) for x, p in ((k, rate), (n - k, 1 - rate)) if x) - math.log(n + 1) / 2

        pairs, share = [(v[at], v[at + h]) for v in want.values() if v[at]], 0.01
        for _ in range(qc.ROUNDS):
            share = min(0.5, max(1e-5, sum(1 / (1 + (1 - share) / share * math.exp(-gain(n, k))) for n, k in pairs) / len(pairs)))
        for b, v in want.items():
            n, k = v[at], v[at + h]
            value = 0.0
            if n:
                q = (k + qc.SHRINK * rate) / (n + qc.SHRINK)
                odds = (math.log(q / (1 - q)) - math.log(rate / (1 - rate))) * (1 if column.startswith("for") else -1)
                if odds > 0:
                    value = (math.exp(min(9, odds)) - 1) / (1 + (1 - share) / share * math.exp(-gain(n, k)))
            assert got[b][column] == pytest.approx(value, rel=1e-4, abs=1e-6)


def test_regression_keeps_signs():
    rng = np.random.default_rng(5)
    x = np.column_stack([np.ones(400), rng.normal(size=(400, 3))])
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [-1, 2, 1.5, 0])))).astype(float)
    b = qc.regression(x, y)
    assert b[1] > 1 and b[2] == 0  # what speaks against may not speak for
    assert qc.regression(x, np.zeros(400))[1] >= 0


def spark_hash(*parts):
    """Spark's xxhash64 of longs and, as a last part, an int."""
    seed = 42
    for k, x in enumerate(parts):
        seed = xxhash.xxh64_intdigest(struct.pack("<q" if k == 0 else "<i", x), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def logistic(x, y, ridge=0.1):
    """Log odds against the common ones, by plain Newton steps, with wrong signs
    set to zero."""
    used, signs = [0, 1, 2, 3], (0, 1, -1, 0)
    while True:
        b = np.zeros(4)
        for _ in range(200):
            p = 1 / (1 + np.exp(-(x @ b)))
            z, penalty = x[:, used], np.array([0.0 if k == 0 else ridge for k in used])
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * b[used])
            b[used] += np.clip(step, -1, 1)
        wrong = [k for k in used if signs[k] * b[k] < 0]
        if not wrong:
            rate = (y.sum() + 0.5) / (len(y) + 1)
            b[0] -= math.log(rate / (1 - rate))
            return b
        used = [k for k in used if k not in wrong]


def strength(groups, rates):
    """Pseudo-rows of a Beta prior by the method of moments, of (n, bad) and
    the parents' rates."""
    n = sum(g[0] for g in groups)
    noise = sum(g[0] * p * (1 - p) for g, p in zip(groups, rates)) / n
    between = sum(g[0] * (g[1] / g[0] - p) ** 2 for g, p in zip(groups, rates)) / n - noise * len(groups) / n
    return min(10_000.0, max(1.0, noise / max(between, 1e-9) - 1))


def brute(docs, labels):
    """``{doc_id: (p_low, p_toxic)}`` from dictionaries of buckets."""
    known = {}
    for i, quality, toxic in labels:
        if i is not None and (quality is not None or toxic is not None):
            low, bad = known.get(i, (0, 0))
            known[i] = (max(low, int(quality == 0)), max(bad, int(toxic == 1)))

    def parts(text):
        words = (text or "").lower().split()
        return qc.statistic_buckets(text or "", words, len(set(words))), [qc.word_buckets(w) for w in set(words)], len(words)

    sample = [(parts(text), spark_hash(i, 3) % 3, known[i]) for i, text, _, _ in docs if i in known]
    weights = {}
    for part in ("a", "all"):
        rows = [s for s in sample if part == "all" or s[1] < 2]
        counts = {}
        for (own, words, _), _, bad in rows:
            for b in {*own, *(x for w in words for x in w)}:
                row = counts.setdefault(b, [0, 0, 0])
                row[0] += 1
                row[1] += bad[0]
                row[2] += bad[1]
        for h in (0, 1):
            rate = min(0.99, max(0.01, sum(s[2][h] for s in rows) / max(1, len(rows))))
            gain = lambda n, k: sum(x * math.log(x / n / p) for x, p in ((k, rate), (n - k, 1 - rate)) if x) - math.log(n + 1) / 2  # noqa: E731, B023
            share = 0.01
            for _ in range(qc.ROUNDS):
                share = min(0.5, max(1e-5, sum(1 / (1 + (1 - share) / share * math.exp(-min(700, gain(c[0], c[1 + h])))) for c in counts.values()) / len(counts)))
            for b, c in counts.items():
                q = (c[1 + h] + qc.SHRINK * rate) / (c[0] + qc.SHRINK)
                odds = math.log(q / (1 - q)) - math.log(rate / (1 - rate))
                own = 1 / (1 + (1 - share) / share * math.exp(-min(700, gain(c[0], c[1 + h]))))
                weights[part, h, b] = tuple(float(np.float16(np.float32(own * (math.exp(min(9, s)) - 1) if s > 0 else 0))) for s in (odds, -odds))

    def features(part, h, own, words, n):
        said = [sum(weights.get((part, h, b), (0, 0))[k] for b in [*own, *(x for w in words for x in w)]) for k in (0, 1)]
        return [1, math.log(said[0] + 1e-3), math.log(said[1] + 1e-3), math.log1p(n)]

    held = [s for s in sample if s[1] == 2]
    fits = [logistic(np.array([features("a", h, *s[0]) for s in held]), np.array([s[2][h] for s in held], dtype=float)) for h in (0, 1)]
    site = lambda r: (r[2] or "", r[3] or "")
    paths, hosts = {}, {}
    for r in docs:
        if r[0] in known:
            for table, key in ((paths, site(r)), (hosts, site(r)[0])):
                row = table.setdefault(key, [0, 0, 0])
                for k, x in enumerate((1, *known[r[0]])):
                    row[k] += x
    out = {}
    for h in (0, 1):
        n = sum(v[0] for v in hosts.values())
        overall = (sum(v[1 + h] for v in hosts.values()) + 1) / (n + 20)
        m = strength([(v[0], v[1 + h]) for v in hosts.values()], [overall] * len(hosts))
        host = {k: (v[1 + h] + m * overall) / (v[0] + m) for k, v in hosts.items()}
        m = strength([(v[0], v[1 + h]) for v in paths.values()], [host[k[0]] for k in paths])
        path = {k: (v[1 + h] + m * host[k[0]]) / (v[0] + m) for k, v in paths.items()}
        for r in docs:
            prior = path.get(site(r), host.get(site(r)[0], overall))
            odds = math.log(prior / (1 - prior)) + float(np.dot(fits[h], features("all", h, *parts(r[1]))))
            out.setdefault(r[0], []).append(1 / (1 + math.exp(-max(-700, min(700, odds)))))
    return out


def test_query_matches_brute_force(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    want = brute(docs, labels)
    out = op3_quality_classifier(spark, small).collect()
    assert len(out) == len(want)
    for r in out:
        low, toxic = want[r.doc_id]
        assert (r.p_low, r.p_toxic) == (pytest.approx(low, abs=2e-3), pytest.approx(toxic, abs=2e-3)), r.doc_id
        assert r.kept == (1 - (1 - low) * (1 - toxic) < 0.5)
    assert 0 < sum(not r.kept for r in out) < len(out)
