import pytest

import corpus_pipeline
from lumisift.llm.quality_classifier import classify
from lumisift.llm.quality_rules import judge
from lumisift.llm.simhash import fingerprint

from test_decontamination import brute as contaminated
from test_quality_rules import base
from test_simhash import wide
from test_tokens import check_packing

SF = "/root/testdata/sf0.01"


def near_copies(rows):
    """Smallest ids of the groups joined by two differing bits or by a Jaccard
    similarity of 0.8, from all pairs."""
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    prints = [(i, fingerprint((t or "").encode()), wide(t)) for i, t in rows]
    for k, (i, f, s) in enumerate(prints):
        for j, g, t in prints[:k]:
            both = len(s & t)
            if (f ^ g).bit_count() <= 2 or (both and 5 * both >= 4 * (len(s) + len(t) - both)):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i for i in parent if root(i) == i}


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        seen.append((docs, rows, out.columns))
        docs = spark.createDataFrame(rows, out.schema)
    return seen


def test_stages_against_brute_force(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = [[(r.doc_id, r.text) for r in docs.collect()] for docs, _, _ in stages]
    ids = [{r.doc_id for r in rows} for _, rows, _ in stages]
    for docs, rows, columns in stages[:-1]:
        assert columns == docs.columns and len(rows) == len({r.doc_id for r in rows})
        assert set(map(tuple, rows)) <= set(map(tuple, docs.collect()))
    assert ids[0] == {r.doc_id for r in classify(stages[0][0], labels).where("kept").collect()}
    listed = {r.doc_id for r in judge(stages[0][0], labels).where("kept").collect()}
    assert ids[1] == {i for i, t in texts[1] if i in listed and not base(t)[-1]}
    assert ids[2] == near_copies(texts[2])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids[3] == {int(x[1:].split(",")[0]) for x in contaminated(texts[3], items) if x.endswith("False)")}
    used, least = check_packing(texts[4], stages[4][1])
    assert used <= 1.02 * least + 1
    assert len(texts[0]) > len(ids[0]) > len(ids[1]) and len(ids[2]) > len(ids[3]) > 0.3 * len(texts[0])


def test_clean_documents_stay(spark, stages):
    """Good labelled documents go for no reason but being a copy, contaminated
    or repetitive."""
    labels = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
    before, after = {r.doc_id for r in stages[0][0].collect()}, {r.doc_id for r in stages[0][1]}
    assert len(labels & after) >= 0.98 * len(labels & before)
    left = {r.doc_id for r in stages[1][1]}
    fails = {r.doc_id for r in stages[1][0].collect() if base(r.text)[-1]}
    assert len(labels & left) >= 0.99 * len((labels & after) - fails)


def test_run_is_its_stages(spark, stages):
    key = lambda rows: sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(stages[-1][1])


def test_odd_and_empty_documents(spark, odd, empty, small):
    """Null ids and texts, repeated rows and clashing columns pass; what has no
    word fails the base test."""
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, small)
            rows = out.collect()
            assert out.columns == docs.columns
            assert set(map(str, rows)) <= set(map(str, docs.collect()))
            if name == "quality_rules":
                assert all(not base(r.text)[-1] for r in rows)
            if name == "simhash_near_dedup":
                assert len(rows) == len(set(map(str, rows)))
            docs = spark.createDataFrame(rows, out.schema)
        assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()} == {r.doc_id for r in docs.collect()}
