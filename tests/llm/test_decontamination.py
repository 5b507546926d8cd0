import hashlib
import re

from pyspark.sql import functions as F

from lumisift.llm import decontamination as dc
from lumisift.llm.queries import op7_decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item_id, text in items:
        w = words(text)
        n = min(13, len(w))
        for s in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[s:s + n]), set()).add(item_id)
    lengths = {len(x) for x in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[s:s + n])):
                    hit.update(range(s, s + n))
                    found |= {str(i) for i in ids if i is not None}
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in df.collect())


def test_query_matches_brute_force(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    df = op7_decontamination(spark, small)
    assert got(df) == brute(docs, items)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


ITEMS = [
    (1, "the quick brown fox jumps over the lazy dog"), (2, "Brown-Fox"), (3, ""), (4, None), (None, "long word long"), (10, "ÉTÉ naïve"), (11, "ÉtÉ Naïve"),
    (20, " ".join(f"t{i}" for i in range(20))), (21, " ".join(f"t{i}" for i in range(5, 19))), (21, "t0 t1 absent"), (22, "a a a a a a a a a a a a a a a"),
]


def test_odd_rows(spark, odd, empty):
    more = [(30, "x " + " ".join(f"T{i}" for i in range(16)) + " gap " + " ".join(f"t{i}" for i in range(20)), "en", "s", 0), (31, "a " * 40, "en", "s", 0), (32, "a " * 12, "en", "s", 0), (33, " ".join(f"t{i}" for i in range(12)), "en", "s", 0)]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("item", "words", "pos", "s")})
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(dc.contamination(docs, items)) == brute(rows, ITEMS)
    assert got(dc.contamination(docs, items.limit(0))) == brute(rows, [])
    assert dc.contamination(empty, items).count() == 0
    kept = dc.decontaminated(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({5, 6, 30, 31})


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "rare one and two then scarce"), (2, "rare then scarce"), (3, "scarce " + "x " * 40 + "rare")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "rare then scarce")], "item_id long, text string")
    index, pairs, items, n = dc.prepare(docs, bench)
    found = {r.doc_id for r in dc.proximity_matches(index, pairs, items, n, slop=4).collect()}
    assert 2 in found and 3 not in found
    assert {r.doc_id for r in dc.phrase_matches(index, pairs, items, n).collect()} == {2}
