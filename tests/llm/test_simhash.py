import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lumisift.llm import simhash
from lumisift.llm.queries import op9_simhash
from lumisift.llm.simhash import fingerprint_links, near_copies_removed, near_copy_groups, simhash_groups
from lumisift.llm.common import connected_components


def fp(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < 3 else [" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, radius):
    """Component label (smallest value) of each distinct value, by all pairs."""
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    vs = sorted(parent)
    for i, a in enumerate(vs):
        for b in vs[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in vs}


def brute(rows, radius=2):
    fps = [(i, fp(t)) for i, t in rows]
    label = groups({f for _, f in fps}, radius)
    least = {}
    for i, f in fps:
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    return sorted(repr((i, f"{f:016x}", least.get(label[f]))) for i, f in fps)


def got(df):
    return sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in df.collect())


def test_query_matches_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op9_simhash(spark, small)) == brute(rows)


def test_odd_rows(spark, odd, empty):
    assert got(simhash_groups(odd)) == brute([tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert simhash_groups(empty).count() == 0


def test_links_connect_all_within_radius(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(25):
            base ^= 1 << rng.randrange(64)
            values.add(base)
            values.add(base ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for radius in (1, 2, 3):
        links = fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius)
        found = {r.node: r.component for r in connected_components(links).collect()}
        assert {v: found.get(v, v) for v in signed} == groups(signed, radius)


def test_one_of_each_group_stays(spark, odd):
    kept = near_copies_removed(odd, edited=False)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 7, 8, 9, 10]


def test_components_of_chain_star_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(7, 7), (None, 3), (2, 1)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 180)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def wide(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_edited_copies_go(spark):
    rng = random.Random(3)
    words = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(40)]
    rows = []
    for i, w in enumerate(words):
        rows.append((i, " ".join(w)))
        rows.append((100 + i, " ".join(w[:60] + ["edited"] + w[61:])))  # Jaccard 111 / 121
        rows.append((200 + i, " ".join(w[:60] + ["edited"] * (1 + i % 3) + w[61:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in near_copies_removed(docs).collect()}
    assert kept == set(range(40))
    assert len(near_copies_removed(docs, edited=False).collect()) > 60  # two bits do not find them


def test_no_pair_at_the_similarity_stays(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    label = {r.doc_id: r.label for r in near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [(i, wide(t)) for i, t in rows]
    index = {}
    n = 0
    for k, (i, s) in enumerate(sets):
        for j in {j for x in s for j in index.get(x, ())}:
            both = len(s & sets[j][1])
            if 5 * both >= 4 * (len(s) + len(sets[j][1]) - both):
                n += 1
                assert label[i] == label[sets[j][0]]
        for x in s:
            index.setdefault(x, []).append(k)
    assert n > 50


def test_one_row_stays_whatever_the_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (1, a), (2, b), (3, a), (3, c), (2, c), (None, a), (None, d), (None, d), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, a), (2, b), (2, c), (None, d)]
    assert sorted(map(repr, map(tuple, near_copies_removed(docs).collect()))) == sorted(map(repr, want))
    assert sorted(map(repr, map(tuple, near_copies_removed(docs, edited=False).collect()))) == sorted(map(repr, want))


def crowd(pairs, seed=7, length=300):
    """Pairs of texts at a similarity over 0.8 that share one template, by which
    texts of different pairs come to about 0.7."""
    rng = random.Random(seed)
    template = [f"w{i}" for i in range(length)]

    def edited(words, n, tag):
        out = list(words)
        for k in rng.sample(range(length), n):
            out[k] = f"{tag}x{k}"
        return out

    rows = []
    for p in range(pairs):
        base = edited(template, 3, f"p{p}")
        rows += [(2 * p + k, " ".join(edited(base, 2, f"p{p}s{k}"))) for k in range(2)]
    return rows


def test_no_pair_of_a_crowd_is_lost(spark):
    rows = crowd(1500)
    sets = [wide(t) for _, t in rows]
    close = [len(sets[2 * p] & sets[2 * p + 1]) / len(sets[2 * p] | sets[2 * p + 1]) for p in range(1500)]
    apart = [len(sets[2 * p] & sets[2 * p + 2]) / len(sets[2 * p] | sets[2 * p + 2]) for p in range(0, 1400, 50)]
    assert sum(c >= 0.8 for c in close) > 1400 and 0.6 < sum(apart) / len(apart) < 0.8
    label = {r.doc_id: r.label for r in near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = sum(c >= 0.8 and label[2 * p] != label[2 * p + 1] for p, c in enumerate(close))
    assert lost <= 0.001 * len(close)  # a pair at 0.8 shares no band with 0.0004
    assert len(set(label.values())) > 100  # and what is apart is not all joined


def test_groups_of_a_crowd_equal_all_pairs(spark, monkeypatch):
    rows = crowd(120, seed=9) + [(1000 + i, " ".join(f"w{k}" for k in range(i, 300))) for i in range(60)]
    sets = [(i, wide(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if 5 * len(x & y) >= 4 * len(x | y):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    for tile in (5, 256):
        monkeypatch.setattr(simhash.crowd_links, "__defaults__", (tile,))
        label = {r.doc_id: r.label for r in near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert all((label[i] == label[j]) == (root(i) == root(j)) for i in parent for j in parent)


def test_overlaps_count_common_members(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 7)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(-50, 50, n)) for n in (0, 1, 30, 60, 200)]
    assert (simhash.overlaps(sets, sets[1:]) == [[len(np.intersect1d(x, y)) for y in sets[1:]] for x in sets]).all()


def test_a_large_group_of_near_copies_makes_few_pairs(spark):
    """All share bands and one group: stars join them, no tile compares them."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:40 + i % 100] + [f"e{i}"] + words[40 + i % 100:])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = simhash.sketches(docs).groupBy("same").agg(F.min(F.struct("text_hash", "fp", "bands")).alias("r")).select("r.*")
    members = simhash.band_members(classes)
    assert simhash.star_pairs(members).count() < 3 * simhash.BANDS * 3000
    assert near_copies_removed(docs).count() == 1
