"""Benchmark decontamination with a distributed positional inverted index.

1. One pass counts the corpus frequency of every benchmark word.
2. Each benchmark window (13 words, or a shorter item whole) picks its two
   rarest words. One pass stores the postings of just those words, with the
   words around them, dealt out by word and document and sorted.
3. Posting lists, shifted by the word's place in the item, are intersected;
   what both lists agree on is compared with the whole window.

Built-in DataFrame functions only. The index holds rare words, so neither the
corpus text nor frequent words are shuffled; a frequent word is stored only if
a window has none rarer, and then spreads over partitions by document.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, fresh_path, let, shuffle_partitions, small_side, stored, trimmed_split

WINDOW = 13
#: What separates words, before A-Z are lowered.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(word: Column) -> Column:
    """A-Z lowered, other letters as they are."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    return trimmed_split(text, BREAKS)


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, item_id, item_words)`` of every item that has a word."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.transform(words_of(F.col(text_col)), lowered).alias("item_words"))
    rows = rows.where(F.size("item_words") > 0).distinct()
    return cut(rows.select(F.xxhash64(F.col("item_id").isNull(), "item_id", "item_words").alias("item"), "item_id", "item_words"))


def corpus_words(docs: DataFrame, id_col: str, text_col: str, *keep: Column) -> DataFrame:
    """One row per word of the corpus: pos, word and ``keep``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    return rows.select(*keep, F.posexplode("words").alias("pos", "raw")).withColumn("word", lowered(F.col("raw"))).drop("raw")


def rarest_pairs(items: DataFrame, frequency: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item, p1, w1, p2, w2, starts)``: places and words of the two rarest
    words of the windows that begin at ``starts``. Windows with a word that the
    corpus lacks are left out: they occur nowhere."""
    places = items.select("item", F.posexplode("item_words").alias("p", "word")).join(frequency, "word", "left")
    ranked = places.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("p", F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("places"))
    length = F.least(F.size("places"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(0), F.size("places") - length)).alias("s")
    rows = ranked.select("item", "places", length.alias("len"), starts)
    best = F.array_sort(F.transform(F.slice("places", F.col("s") + 1, F.col("len")), lambda x: F.struct(x["n"], x["p"], x["word"])))
    rows = rows.select("item", "s", best.alias("best")).where(F.col("best")[0]["n"] > 0)
    second = F.coalesce(F.get("best", F.lit(1)), F.col("best")[0])
    return rows.select("item", "s", F.col("best")[0].alias("a"), second.alias("b")).groupBy(
        "item", F.col("a.p").alias("p1"), F.col("a.word").alias("w1"), F.col("b.p").alias("p2"), F.col("b.word").alias("w2")
    ).agg(F.collect_list("s").alias("starts"))


def build_index(docs: DataFrame, terms: DataFrame, n_terms: int, context: int = WINDOW - 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store and return postings ``(word, doc_id, text_hash, pos, before,
    around)`` of ``terms.word``. ``around`` holds up to ``context`` words to
    either side, ``before`` of them on the left, for ``terms.verify`` words."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    # the word array is read in place: only matching rows take a slice of it
    at = rows.select("doc_id", "text_hash", "words", F.posexplode("words").alias("pos", "raw")).withColumn("word", lowered(F.col("raw")))
    before = F.least(F.col("pos"), F.lit(context))
    hits = at.join(small_side(terms, n_terms), "word").select(
        "word", "doc_id", "text_hash", "pos", before.alias("before"),
        F.when(F.col("verify"), F.slice("words", F.col("pos") - before + 1, before + context + 1)).alias("around"),
    )
    path = fresh_path(spark, "postings")
    hits.repartition(shuffle_partitions(spark), "word", "doc_id").sortWithinPartitions("word", "doc_id", "pos").write.parquet(path)
    return spark.read.parquet(path)


def _adjusted(index: DataFrame, pairs: DataFrame, n_pairs: int, which: str, *more: str) -> DataFrame:
    """Postings of the pairs' first or second words, shifted to where the item
    would begin."""
    anchors = pairs.select(F.col(f"w{which}").alias("word"), "item", "p1", "p2")
    return index.join(small_side(anchors, n_pairs), "word").select(
        "doc_id", "text_hash", "item", "p1", "p2", (F.col("pos") - F.col(f"p{which}")).alias("begin"), *more
    )


def phrase_matches(index: DataFrame, pairs: DataFrame, items: DataFrame, n_pairs: int, window: int = WINDOW) -> DataFrame:
    """``(doc_id, text_hash, item_id, start, len)`` of every occurrence of a
    window: intersects the two shifted lists and compares the whole window."""
    first = _adjusted(index, pairs, n_pairs, "1", "pos", "before", "around").alias("a")
    second = _adjusted(index, pairs, n_pairs, "2").distinct().alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    for c in ("text_hash", "item", "p1", "p2", "begin"):
        same &= F.col(f"a.{c}") == F.col(f"b.{c}")
    both = first.join(second, same, "left_semi")
    windows = pairs.join(items, "item").select("item", "item_id", "p1", "p2", "item_words", F.explode("starts").alias("s"))
    found = both.join(small_side(windows, n_pairs * window), ["item", "p1", "p2"]).select(
        "doc_id", "text_hash", "item_id", (F.col("begin") + F.col("s")).alias("start"), F.least(F.size("item_words"), F.lit(window)).alias("len"),
        "around", (F.col("begin") + F.col("s") - F.col("pos") + F.col("before")).alias("skip"), "item_words", "s",
    ).where("skip >= 0")
    text = F.transform(F.slice("around", F.col("skip") + 1, F.col("len")), lowered)
    return found.where(text == F.slice("item_words", F.col("s") + 1, F.col("len"))).select("doc_id", "text_hash", "item_id", "start", "len").distinct()


def proximity_matches(index: DataFrame, pairs: DataFrame, items: DataFrame, n_pairs: int, slop: int = 5) -> DataFrame:
    """``(doc_id, item_id, p1, p2, pos1, pos2)`` where the two rarest words of a
    window are at most ``slop`` words off their distance in the item.

    Shifted lists meet in buckets ``slop`` + 1 wide and in the neighbouring
    ones, so a document's lists are never compared all with all.
    """
    width = slop + 1
    a = _adjusted(index, pairs, n_pairs, "1", F.col("pos").alias("pos1")).withColumn("bucket", F.floor(F.col("begin") / width))
    b = _adjusted(index, pairs, n_pairs, "2", F.col("pos").alias("pos2")).withColumnRenamed("begin", "begin2")
    b = b.withColumn("near", F.floor(F.col("begin2") / width)).withColumn("bucket", F.explode(F.array(F.col("near") - 1, F.col("near"), F.col("near") + 1))).drop("near")
    met = a.join(b, ["doc_id", "text_hash", "item", "p1", "p2", "bucket"]).where(F.abs(F.col("begin") - F.col("begin2")) <= slop)
    return met.join(items.select("item", "item_id"), "item").select("doc_id", "item_id", "p1", "p2", "pos1", "pos2").distinct()


def prepare(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """``(index, pairs, items, number of pairs)`` for a corpus and a benchmark."""
    items = benchmark_items(benchmark)
    vocabulary = cut(items.select(F.explode("item_words").alias("word")).distinct())
    n_words = vocabulary.count()
    frequency = cut(
        corpus_words(docs, "doc_id", "text").join(small_side(vocabulary, n_words), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = cut(rarest_pairs(items, frequency, window))
    n_pairs = pairs.count()
    terms = pairs.select(F.col("w1").alias("word"), F.lit(True).alias("verify")).unionByName(pairs.select(F.col("w2").alias("word"), F.lit(False).alias("verify")))
    terms = cut(terms.groupBy("word").agg(F.max("verify").alias("verify")))
    return build_index(docs, terms, terms.count(), window - 1), pairs, items, n_pairs


def document_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(hit_id, hit_hash, hit, items)`` of documents with hits: how many of
    their words are hit, and the ids of the items that hit them."""
    index, pairs, items, n_pairs = prepare(docs, benchmark, window)
    found = phrase_matches(index, pairs, items, n_pairs, window).groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = x["start"] + x["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"]))).alias("n"))

    return found.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), F.aggregate("spans", zero, step, lambda a: a["n"]).alias("hit"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and
    contaminated (at least a twentieth of its words is hit).

    A null, empty or wordless text has no words and is clean; a very long one
    is searched whole. Items without a word are skipped, equal items count
    each, an item without id hits but is not counted in n_items. Repeated rows
    give repeated rows; null ids are kept. Other columns are not looked at.
    Empty tables give no rows or no hits.
    """
    found = stored(document_hits(docs, benchmark, window), "hits")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return rows.join(small_side(found), same, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents; odd rows as in
    ``contamination``. Only documents with hits have their words counted, and
    what joins is the table of hits: texts move only if it is too large to be
    broadcast."""
    hits = stored(document_hits(docs, benchmark).select("hit_id", "hit_hash", F.col("hit").cast("long").alias("hit")), "hits")
    named = {c: free_name(docs, c) for c in hits.columns}
    hits = hits.withColumnsRenamed(named)
    n_hit = F.col(named["hit"])
    same = F.col("doc_id").eqNullSafe(F.col(named["hit_id"])) & (F.xxhash64("text") == F.col(named["hit_hash"]))
    dirty = n_hit.isNotNull() & F.when(n_hit.isNotNull(), 20 * n_hit >= F.size(words_of(F.col("text")))).otherwise(False)
    return docs.join(small_side(hits), same, "left").where(~dirty).select(*[F.col(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS l, array_to_string(w[s + 1 : s + least(13, len(w))], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)
), starts AS (
  SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS s FROM d, (SELECT DISTINCT l FROM windows) WHERE len(w) >= l
), hits AS (
  SELECT doc_id, item_id, s, g.l AS l FROM (SELECT doc_id, s, l, array_to_string(w[s + 1 : s + l], ' ') AS t FROM starts) g JOIN windows v ON g.l = v.l AND g.t = v.t
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
