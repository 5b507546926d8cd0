import math
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumisift.llm import token_counts as tc
from lumisift.llm.queries import op2_token_counts

PIECES = tc.pieces_of()
NUMBERS = {p: i for i, p in enumerate(PIECES)}
MACHINE = tc.automaton(tc.VOCABULARY)


def plain(word, numbers, scores, reach=200):
    """Pieces of the best segmentation by a table over all substrings."""
    low = float(scores.min()) - tc.UNKNOWN
    text = b" " + word.encode("utf-8", "surrogatepass")
    best = [(0.0, 0, None)] + [None] * len(text)
    for i in range(1, len(text) + 1):
        found = []
        for j in range(max(0, i - reach), i):
            number = numbers.get(text[j:i])
            if number is not None or i - j == 1:
                found.append((-(best[j][0] + (low if number is None else scores[number])), best[j][1] + 1, j, number))
        s, n, j, number = min(found, key=lambda f: f[:3])
        best[i] = (-s, n, (j, number))
    out, i = [], len(text)
    while i:
        i, number = best[i][2]
        out.append(number)
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), min_size=1, max_size=12), max_size=12))
def test_shared_scores_against_plain_viterbi(found):
    scores = tc.prior_scores(PIECES)
    want = [len(plain(w, NUMBERS, scores)) for w in found]
    assert list(tc.segmented(found, MACHINE, scores)) == want
    order = sorted(range(len(found)), key=found.__getitem__)
    assert list(tc.segmented([found[i] for i in order], MACHINE, scores)) == [want[i] for i in order]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=9), max_size=30))
def test_pieces_are_counted(found):
    """A vocabulary that lacks bytes, and equal scores."""
    pieces = [p.encode() for p in (" ", "a", "b", "ab", "ba", " a", "aab", "bb")]
    scores, counts, want = np.log(np.array([0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.2, 0.1])), np.zeros(8, np.int64), np.zeros(8, np.int64)
    got = list(tc.segmented(found, tc.Automaton(pieces), scores, range(len(found)), counts))
    for i, w in enumerate(found):
        used = plain(w, {p: i for i, p in enumerate(pieces)}, scores)
        assert got[i] == len(used)
        for number in used:
            if number is not None:
                want[number] += i
    # of equally good segmentations with as many pieces either may be counted
    assert sum(counts * [len(p) for p in pieces]) == sum(want * [len(p) for p in pieces])


def brute(rows):
    totals = {}
    for _, text in rows:
        for w in words(text):
            totals[w] = totals.get(w, 0) + 1
    counts, prior = np.zeros(len(PIECES)), tc.prior_scores(PIECES)
    for w, n in totals.items():
        for number in plain(w, NUMBERS, prior):
            counts[number] += n
    scores = np.log(counts + tc.SMOOTH) - math.log(counts.sum() + tc.SMOOTH * len(counts))
    size = {w: len(plain(w, NUMBERS, scores)) for w in totals}
    return sorted(repr((i, len(words(t)), sum(size[w] for w in words(t)))) for i, t in rows)


def test_query_matches_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(repr(tuple(r)) for r in op2_token_counts(spark, small).collect()) == brute(rows)


def test_odd_rows(spark, odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    want = brute(rows)
    for common in (0, 3, 10**6):  # all words, some and none meet their counts in the join
        assert sorted(repr(tuple(r)) for r in tc.token_counts(odd, common=common).collect()) == want
    assert tc.token_counts(empty).count() == 0


def test_a_shared_prefix_is_scored_once_a_range(spark, small, monkeypatch):
    """Batches of a few words: the nodes that are made are those of one trie per
    file of words."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = tc.distinct_words(docs)
    files = {}
    for r in found.select("word", F.input_file_name().alias("file")).collect():
        files.setdefault(r.file, []).append(b" " + r.word.encode())
    assert len(files) > 1 and all(f == sorted(f) for f in files.values())
    ranges = sorted((f[0], f[-1]) for f in files.values())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    nodes = sum(len({w[:i] for w in f for i in range(1, len(w) + 1)}) for f in files.values())

    def run(batches):
        path = tc.Path()
        for batch in batches:
            for _ in tc.segmented(batch.column(0).to_pylist(), MACHINE, tc.prior_scores(PIECES), path=path):
                pass
        yield pa.RecordBatch.from_pydict({"scored": [path.scored]})

    scored = sum(run_one([pa.RecordBatch.from_pydict({"w": [w[1:].decode() for w in f[i:i + 7]]}) for i in range(0, len(f), 7)], run) for f in files.values())
    assert scored == nodes < sum(len(w) for f in files.values() for w in f)


def run_one(batches, run):
    return next(run(batches)).column(0)[0].as_py()
