"""Quality classifier by hierarchical empirical Bayes.

Document evidence and site evidence are fitted apart and added as log odds.

* Evidence: words, word beginnings and binned text statistics are hashed into
  buckets and counted over a bounded labelled sample. A bucket either follows
  the common rate or has a rate of its own; the odds of that come from its
  counts and from the share of such buckets, which is estimated from all of
  them (a two-groups prior). What a bucket says for or against a label is
  weighed by them, so thousands of words that say nothing add up to nothing,
  and no bucket or word has to be left out. A document sums up all that its
  buckets say for and, apart, against a label. A small regression on documents
  that the weights have not seen turns the sums into log likelihood ratios; the
  weights are then taken from the whole sample.
* Sites: grouped sums of all labels give a host's rate, shrunk toward the
  global rate, and a path's rate, shrunk toward its host's. How strongly is
  estimated from the spread between sites (method of moments), so a sparse
  site follows its parent.

There is one head for low quality and one for toxicity; a document is rejected
if it is more likely than not to be either. The weights are a table in the
shared folder that every worker reads for itself.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, filesystem, free_name, held, small_side, stored, table_path, tidy

#: Most labelled documents that evidence is fitted on, by a hash of the id.
TRAIN_ROWS = 40_000
BUCKETS = 1 << 22
#: Pseudo-documents of a bucket's prior.
SHRINK = 0.5
#: Rounds that estimate the share of buckets with a rate of their own.
ROUNDS = 6
HEADS = ("low", "toxic")
_EDGE = re.compile(r"^\W+|\W+$")
_MEMO = 200_000
#: Words whose buckets are remembered while buckets are counted.
_COUNT_MEMO = 60_000


def _bucket(name: str, kind: int) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), kind) % BUCKETS


def word_buckets(word: str) -> tuple[int, ...]:
    """Buckets of a lowered word: itself without marks, how it begins, and its
    marks if it has any."""
    core = word if word.isalnum() else _EDGE.sub("", word)
    out = (_bucket(core, 1),) if core else ()
    if len(core) > 5:
        out += (_bucket(core[:4], 2), _bucket(core[:5], 2), _bucket(core[:6], 2))
    if len(word) - len(core) > 1 or not core:
        out += (_bucket(word.replace(core, "_") if core else word, 3),)
    return out


#: Most buckets of a word.
WIDEST = 5


def statistic_buckets(text: str, words: list[str], distinct: int) -> list[int]:
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = text.encode("utf-8", "surrogatepass")
    upper = chars - sum(map(len, re.split("[A-ZÀ-ÖØ-Þ]", text)))
    symbols = sum(letters.count(c) for c in b"#*$%&|<>!")
    values = {
        "upper": 20 * upper / chars, "symbols": 10 * symbols / n, "distinct": 20 * distinct / n, "length": 2 * chars / n,
        "lines": 10 * (len(lines) - len(set(lines))) / max(1, len(lines)), "size": math.log2(n),
    }
    found = [f"{k}:{min(40, int(v))}" for k, v in values.items()]
    return [_bucket(x, 4) for x in (*found, f"{found[2]},{int(math.log2(n))}")]


class _Buckets(dict):
    """Buckets by word, made when missing; full, it starts anew."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _COUNT_MEMO:
            self.clear()
        self[word] = got = word_buckets(word)
        return got


def document_buckets(text: str | None, known: _Buckets) -> np.ndarray:
    """The distinct buckets of a text."""
    text = text or ""
    words = text.lower().split()
    kinds = set(words)
    found = set(statistic_buckets(text, words, len(kinds))).union(*map(known.__getitem__, kinds))
    return np.fromiter(found, dtype=np.int64, count=len(found))


#: What a bucket says: for and against each label.
SAYS = tuple(f"{side}_{h}" for h in HEADS for side in ("for", "against"))


@dataclass
class Evidence:
    """Where the weights are, and the regression of each head on the sums."""

    path: str = ""
    suffix: str = ""
    regressions: tuple[tuple[float, ...], ...] = ()

    def scorer(self):
        """A function from a text to a log likelihood ratio per head."""
        said, by = Said(_weights(self.path, self.suffix)), np.array(self.regressions)
        return lambda text: (by * said.features(text)).sum(axis=1)


def _weights(path: str, suffix: str) -> np.ndarray:
    """The table of weights as a dense array, once per worker."""
    return held("weights", (path, suffix), lambda: _read_weights(path, suffix))


def _read_weights(path: str, suffix: str) -> np.ndarray:
    fs, base = filesystem(path)
    out = np.zeros((BUCKETS + 1, len(SAYS)), dtype=np.float16)  # the last row stands for no bucket
    for file in fs.get_file_info(pafs.FileSelector(base)):
        if file.base_name.endswith(".parquet"):
            with fs.open_input_file(file.path) as source:
                part = pq.ParquetFile(source).read(["bucket", *(c + suffix for c in SAYS)])
            out[part["bucket"].to_numpy()] = np.stack([part[c + suffix].to_numpy() for c in SAYS], axis=1)
    return out


class Said(dict):
    """What a text's distinct words and its statistics say: places of words in
    a table of what they say. Full, it starts anew."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights
        self.table = np.zeros((_MEMO, len(SAYS)), dtype=np.float32)

    def learn(self, words: list[str]) -> None:
        first = len(self)
        buckets = np.full((len(words), WIDEST), BUCKETS, dtype=np.int64)
        for i, word in enumerate(words):
            got = word_buckets(word)
            buckets[i, :len(got)] = got
        self.table[first:first + len(words)] = self.weights[buckets].sum(axis=1, dtype=np.float32)
        self.update(zip(words, range(first, first + len(words))))

    def features(self, text: str | None) -> np.ndarray:
        """Per head: one, the logs of all that is said for and against it, and
        the log of the number of words."""
        text = text or ""
        words = text.lower().split()
        kinds = set(words)
        total = self.weights[statistic_buckets(text, words, len(kinds))].sum(axis=0, dtype=np.float64)
        # words go in turns, each of which the table can hold
        for some in [kinds] if len(kinds) <= _MEMO // 2 else _turns(kinds, _MEMO // 2):
            if len(self) + len(some) > _MEMO:
                self.clear()
            if new := [w for w in some if w not in self]:
                self.learn(new)
            total += self.table[np.fromiter(map(self.__getitem__, some), dtype=np.int64, count=len(some))].sum(axis=0, dtype=np.float64)
        said = np.log(total + 1e-3).reshape(len(HEADS), 2)
        return np.column_stack([np.ones(len(HEADS)), said, np.full(len(HEADS), math.log1p(len(words)))])


def _turns(words: set[str], most: int):
    rest = iter(words)
    while some := list(islice(rest, most)):
        yield some


def _newton(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    b, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    b[0], penalty[0] = math.log(rate / (1 - rate)), 0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.clip(np.linalg.solve(hessian, x.T @ (y - p) - penalty * b), -5, 5)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression on ``features``; its log odds against the common
    ones of ``y``. What speaks for a label never counts against it and the
    other way round: a coefficient of the wrong sign is set to zero."""
    if not len(y):
        return np.array([-20.0, 0, 0, 0])
    signs, used = np.array([0, 1, -1, 0]), np.ones(4, dtype=bool)
    while True:
        b = np.zeros(4)
        b[used] = _newton(x[:, used], y, ridge)
        wrong = used & (signs * b < 0)
        if not wrong.any():
            break
        used &= ~wrong
    rate = (y.sum() + 0.5) / (len(y) + 1)
    b[0] -= math.log(rate / (1 - rate))
    return b


def _site_columns(url_or_source: Column, path: Column) -> list[Column]:
    return [F.coalesce(url_or_source.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path")]


def known_labels(labels: DataFrame) -> DataFrame:
    """``(label_id, low, toxic)``, one row per id; an id that any row calls low
    or toxic is. Null labels count as good."""
    bad = [F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0).cast("int")).alias("low"), F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias("toxic")]
    return labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())).groupBy(F.col("doc_id").alias("label_id")).agg(*bad)


def bucket_counts(sample: DataFrame, small: bool = False) -> DataFrame:
    """Per bucket the documents that have it (``n``), those of each head, and
    the same of folds 0 and 1 alone (``n_a`` and so on). ``small``: there are
    fewer than 65,536 documents."""
    names = ["bucket", *(c + a for a in ("_a", "_b") for c in ("n", *HEADS))]

    def count(batches):
        totals, known = np.zeros((6, BUCKETS), dtype=np.uint16 if small else np.int32), held("words", 0, _Buckets)
        for batch in batches:
            for text, fold, *bad in zip(*(c.to_pylist() for c in batch.columns)):
                seen = document_buckets(text, known)
                for k, counts in enumerate((True, *bad)):
                    if counts:
                        totals[k + 3 * (fold == 2), seen] += 1
        used = np.flatnonzero(totals[0] + totals[3])
        for at in range(0, len(used), 100_000):
            part = used[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(t[part].astype(np.int32)) for t in totals)], names=names)

    rows = sample.select("text", "fold", *HEADS).mapInArrow(tidy(count), ", ".join(c + " int" for c in names))
    sums = rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names[1:]])
    return sums.select("bucket", *(F.col(c + "_a") for c in ("n", *HEADS)), *((F.col(c + "_a") + F.col(c + "_b")).alias(c) for c in ("n", *HEADS)))


def _own_rate(n: Column, k: Column, rate: float) -> Column:
    """Log of how much likelier the counts are under a rate of their own than
    under ``rate``, less the price of fitting it."""
    def part(x: Column, p: float) -> Column:
        return F.when(x > 0, x * (F.log(x / n) - math.log(p))).otherwise(0.0)

    return part(k, rate) + part(n - k, 1 - rate) - F.log(n + 1.0) / 2


def bucket_weights(counts: DataFrame, sizes: dict[str, float]) -> DataFrame:
    """``bucket`` and what it says for and against each head, from all the
    sample and (``_a``) from its folds 0 and 1. ``sizes``: documents, and those
    of each head, by the columns' names."""
    columns = []
    for a in ("_a", ""):
        n = F.col("n" + a).cast("double")
        for h in HEADS:
            rate = min(0.99, max(0.01, sizes[h + a] / max(1, sizes["n" + a])))
            k = F.col(h + a).cast("double")
            spread = counts.where(n > 0).groupBy("n" + a, h + a).agg(F.count(F.lit(1)).alias("buckets"))
            table = [(_own(r[0], r[1], rate), r[2]) for r in spread.collect()]  # a row per pair of counts, not per bucket
            share = 0.01
            for _ in range(ROUNDS):
                total = sum(m for _, m in table) or 1
                share = min(0.5, max(1e-5, sum(m / (1 + (1 - share) / share * math.exp(-min(g, 700))) for g, m in table) / total))
            own = 1 / (1 + (1 - share) / share * F.exp(-F.least(_own_rate(n, k, rate), F.lit(700.0))))
            shrunk = (k + SHRINK * rate) / (n + SHRINK)
            odds = F.log(shrunk / (1 - shrunk)) - math.log(rate / (1 - rate))
            for side, says in (("for", odds), ("against", -odds)):
                columns.append(F.when((n > 0) & (says > 0), own * (F.exp(F.least(says, F.lit(9.0))) - 1)).otherwise(0.0).cast("float").alias(f"{side}_{h}{a}"))
    return counts.select("bucket", *columns)


def _own(n: int, k: int, rate: float) -> float:
    """As ``_own_rate``, of plain numbers."""
    def part(x: int, p: float) -> float:
        return x * math.log(x / n / p) if x else 0.0

    return part(k, rate) + part(n - k, 1 - rate) - math.log(n + 1) / 2


def fit_evidence(rows: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Evidence:
    total = labels.count()
    share = min(1.0, train_rows / max(1, total))
    picked = labels.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # about train_rows at most, whatever the corpus
    sample = rows.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))
    sample = stored(sample.select("text", *HEADS, F.pmod(F.xxhash64("label_id", F.lit(3)), F.lit(3)).alias("fold")), "sample")
    every = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(h) for h in HEADS], F.count_if(F.col("fold") < 2).alias("n_a"), *[F.sum(F.when(F.col("fold") < 2, F.col(h)).otherwise(0)).alias(h + "_a") for h in HEADS])
    sizes = {k: v or 0 for k, v in every.first().asDict().items()}
    if not sizes["n_a"] or sizes["n_a"] == sizes["n"]:
        return Evidence()
    weights = stored(bucket_weights(stored(bucket_counts(sample, sizes["n"] < 1 << 16), "buckets"), sizes), "weights")
    path = table_path(weights)

    def sums(batches):
        said = Said(_weights(path, "_a"))
        for batch in batches:
            got = [said.features(x.as_py()).ravel().tolist() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), *batch.columns[1:]], names=["x", *HEADS])

    bounded_batches(rows.sparkSession)
    held_out = sample.where("fold = 2").select("text", *HEADS).mapInArrow(tidy(sums), "x array<double>, low int, toxic int").collect()  # about a third of train_rows, four numbers a head
    x = np.array([r["x"] for r in held_out]).reshape(len(held_out), len(HEADS), -1)
    fits = [regression(x[:, i], np.array([r[h] for r in held_out], dtype=float)) for i, h in enumerate(HEADS)]
    return Evidence(path, "", tuple(tuple(f.tolist()) for f in fits))


def _strength(groups: DataFrame, parent: Column, k: str) -> float:
    """Pseudo-rows of a Beta prior over the rates of ``groups`` (n, and bad
    ``k``) around ``parent``: method of moments."""
    r = groups.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"),
        F.sum(F.col("n") * F.pow(F.col(k) / F.col("n") - parent, 2)).alias("spread"), F.sum(F.col("n") * parent * (1 - parent)).alias("noise"),
    ).first()
    if not r["n"] or not r["noise"]:
        return 100.0
    noise = r["noise"] / r["n"]
    between = r["spread"] / r["n"] - noise * r["g"] / r["n"]
    return min(10_000.0, max(1.0, noise / max(between, 1e-9) - 1))


def site_rates(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """``(host, path, low_rate, toxic_rate, host_low, host_toxic)`` of labelled
    sites, shrunk, and the global rates. All labels count."""
    known = rows.select("doc_id", "host", "path").join(labels, F.col("doc_id") == F.col("label_id"))
    paths = stored(known.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(h).cast("double").alias(h) for h in HEADS]), "sites")
    top = paths.agg(F.sum("n").alias("n"), *[F.sum(h).alias(h) for h in HEADS]).first()
    overall = {h: ((top[h] or 0) + 1) / ((top["n"] or 0) + 20) for h in HEADS}
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", *HEADS)])
    rates = []
    for h in HEADS:
        m = _strength(hosts, F.lit(overall[h]), h)
        rates.append(((F.col(h) + m * overall[h]) / (F.col("n") + m)).alias("host_" + h))
    hosts = hosts.select("host", *rates)
    both = stored(paths.join(hosts, "host"), "sites")
    out = []
    for h in HEADS:
        m = _strength(both, F.col("host_" + h), h)
        out.append(((F.col(h) + m * F.col("host_" + h)) / (F.col("n") + m)).alias(h + "_rate"))
    return stored(both.select("host", "path", *out, *["host_" + h for h in HEADS]), "sites"), overall


def _judged(docs: DataFrame, labels: DataFrame, train_rows: int, host_col: str, path_col: str, keep: list[str]) -> tuple[DataFrame, str]:
    """``keep`` columns of ``docs`` and a struct column, whose name comes too,
    of site_low, site_toxic, p_low, p_toxic, p_bad and kept. A text stays in its
    row all the way."""
    s = free_name(docs, "judged")
    site = F.struct(*_site_columns(F.col(host_col), F.col(path_col)))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *_site_columns(F.col(host_col), F.col(path_col)))
    labels = stored(known_labels(labels), "labels")
    model = fit_evidence(rows, labels, train_rows)
    sites, overall = site_rates(rows, labels)
    n_sites = sites.count()
    hosts = sites.groupBy("host").agg(*[F.max("host_" + h).alias("host_" + h) for h in HEADS])
    bounded_batches(docs.sparkSession)
    at = 1 + keep.index("text") if "text" in keep else 1 + len(keep)
    source = docs.select(site.alias("s"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *([] if "text" in keep else [F.col("text")]))
    names = ["host", "path", *(f"k{i}" for i in range(len(keep))), *("r_" + h for h in HEADS)]

    def run(batches):
        score = model.scorer() if model.path else lambda text: np.full(len(HEADS), -20.0)
        for batch in batches:
            got = np.array([score(x.as_py()) for x in batch.column(at)]).reshape(-1, len(HEADS))
            site = batch.column(0)
            yield pa.RecordBatch.from_arrays([site.field(0), site.field(1), *batch.columns[1:1 + len(keep)], *(pa.array(got[:, i]) for i in range(len(HEADS)))], names=names)

    types = [f"k{i} {t}" for i, (_, t) in enumerate(docs.select(*keep).dtypes)]
    scored = source.mapInArrow(tidy(run), ", ".join(["host string", "path string", *types, *(f"r_{h} double" for h in HEADS)]))
    placed = scored.join(small_side(sites.drop(*["host_" + h for h in HEADS]), n_sites), ["host", "path"], "left").join(small_side(hosts, n_sites), "host", "left")
    out = []
    for h in HEADS:
        placed = placed.withColumn("site_" + h, F.coalesce(F.col(h + "_rate"), F.col("host_" + h), F.lit(overall[h])))
        odds = F.log(F.col("site_" + h)) - F.log(1 - F.col("site_" + h)) + F.col("r_" + h)
        placed = placed.withColumn("p_" + h, 1 / (1 + F.exp(-odds)))
        out += ["site_" + h, "p_" + h]
    bad = 1 - (1 - F.col("p_low")) * (1 - F.col("p_toxic"))
    verdict = F.struct(*out, bad.alias("p_bad"), (bad < 0.5).alias("kept"))
    return placed.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], verdict.alias(s)), s


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """Per row: doc_id, site_low, site_toxic (priors from the site), p_low,
    p_toxic, p_bad and kept.

    A null or empty text has no words; a very long one is scored whole. A null
    host or path is the site ''. A path without labels takes its host's rate, a
    host without labels the global one. Without labels no document is
    rejected. Repeated rows and null ids are scored like others; a null id has
    no label, and an id labelled twice is bad if either label says so. Extra
    columns are ignored. An empty table gives an empty result.
    """
    rows, s = _judged(docs, labels, train_rows, host_col, path_col, ["doc_id"])
    return rows.select("doc_id", f"{s}.*")


def classifier_filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier rejects; odd rows as in
    ``classify``."""
    rows, s = _judged(docs, labels, TRAIN_ROWS, "source", "lang", docs.columns)
    return rows.where(F.col(s)["kept"]).select(*docs.columns)
