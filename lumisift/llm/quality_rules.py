"""Quality rules: text statistics and a learned decision list.

Sequential covering learns conjunctions of thresholds that pick low-quality
documents: a rule grows by the condition with the best information gain on two
thirds of the labelled rows, is pruned on the other third, and the rows it
covers are set aside before the next. Every step is one grouped count over
binned statistics; only counts per statistic and bin reach the driver. The list
is emitted as one ordered conditional expression.

Built-in DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, small_side, stored, trimmed_split

BREAKS = r"[\x20\x09-\x0D]+"
SHINGLE = 8
#: Most labelled rows that rules are learned from, chosen by a hash of the id.
TRAIN_ROWS = 200_000
FEATURES = ("words", "mean_length", "symbol_rate", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_rate", "distinct_share")


def _repeated(words: Column) -> Column:
    """How many words lie in an 8-word window that the text has twice or more.

    Windows are compared by 64-bit hashes; places are looked at only in texts
    in which two hashes agree.
    """
    def places(sorted_: Column) -> Column:
        twin = F.transform(sorted_, lambda x, i: F.when((F.get(sorted_, i - 1)["h"] == x["h"]) | (F.get(sorted_, i + 1)["h"] == x["h"]), x["i"]))
        return F.sort_array(F.filter(twin, lambda i: i.isNotNull()))

    def covered(acc: Column, i: Column) -> Column:
        end = i + SHINGLE
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], i)).alias("n"))

    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(F.aggregate(let(pairs, places), zero, covered, lambda a: a["n"]))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
    return F.when(F.size(words) > SHINGLE, let(hashes, count)).otherwise(0)


#: Names of the base statistics, in the order of the contract.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _statistics(text: Column) -> Column:
    """A struct of BASE, base_failed and the learner's ``features``. Word and
    line arrays live only while their row is evaluated."""
    def rates(x: Column) -> Column:
        n, chars, lines = (F.greatest(F.lit(1.0), x[c].cast("double")) for c in ("n_words", "word_chars", "n_lines"))
        values = {
            "words": x["n_words"], "mean_length": x["word_chars"] / n, "symbol_rate": x["n_symbols"] / n, "dup_line_share": x["n_dup_lines"] / lines,
            "repeat_share": x["n_repeat_words"] / n, "upper_share": x["n_upper"] / chars, "digit_share": x["n_digits"] / chars,
            "mark_rate": x["n_marks"] / n, "distinct_share": x["n_distinct"] / n,
        }
        failed = (x["n_words"] < 20) | (100 * x["n_repeat_words"] > 30 * x["n_words"])
        return F.struct(*[x[c].alias(c) for c in BASE], failed.alias("base_failed"), F.array(*[values[f].cast("double") for f in FEATURES]).alias("features"))

    def counts(w: Column, lines: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeated(w).cast("long").alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_upper"), F.regexp_count(text, F.lit("[0-9]")).alias("n_digits"),
            F.regexp_count(text, F.lit(r"\p{P}")).alias("n_marks"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(let(trimmed_split(text, BREAKS), lambda w: let(lines, lambda x: counts(w, x))), rates)


def with_statistics(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct column ``name`` of its texts' statistics. A
    generator makes it, so that tests of its fields are never pushed below it
    and evaluated anew."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select("*", F.explode(F.array(_statistics(text))).alias(name))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed and the learner's statistics ``features``."""
    rows = with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "s")
    return rows.select("doc_id", "s.*")


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    edge: float
    bin: int

    def on_bins(self) -> Column:
        b = F.col("bins")[self.feature]
        return b > self.bin if self.above else b <= self.bin

    def on_features(self, features: Column) -> Column:
        x = features[self.feature]
        return x > self.edge if self.above else x <= self.edge

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.edge:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; a document that a rule covers is rejected by the first."""

    rules: list[list[Condition]] = field(default_factory=list)

    def _first(self, test) -> Column:
        out = None
        for i, rule in enumerate(self.rules):
            cond = test(rule[0])
            for c in rule[1:]:
                cond &= test(c)
            out = F.when(cond, i) if out is None else out.when(cond, i)
        return F.lit(None).cast("int") if out is None else out

    def rule(self, features: Column | None = None) -> Column:
        """The number of the first rule that covers a row of statistics."""
        values = F.col("features") if features is None else features
        return self._first(lambda c: c.on_features(values))

    def covered_bins(self) -> Column:
        return self._first(Condition.on_bins).isNotNull()

    def __str__(self) -> str:
        return "\n".join(f"{i}: reject if " + " and ".join(map(str, r)) for i, r in enumerate(self.rules)) or "(no rule)"


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best(counts: list, edges: list[list[float]]) -> Condition | None:
    """The condition with the best gain, from counts per statistic and bin."""
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r["f"], {})[r["b"]] = (r["bad"], r["good"])
    best, top = None, 1e-9
    for f, bins in sorted(by.items()):
        p0, n0 = (sum(x[k] for x in bins.values()) for k in (0, 1))
        p = n = 0
        for k, edge in enumerate(edges[f]):
            p, n = p + bins.get(k, (0, 0))[0], n + bins.get(k, (0, 0))[1]
            for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                if (gain := _gain(a, b, p0, n0)) > top and b < n0:
                    best, top = Condition(f, above, edge, k), gain
    return best


def learn_rules(
    statistics: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS,
    precision: float = 0.95, min_cover: int = 5, id_col: str = "doc_id", label_col: str = "quality",
) -> DecisionList:
    """Learn from ``statistics`` joined with ``labels`` (1 good, 0 low); rows
    without a label, with a null one, or that fail the base test are not used.

    A rule joins the list if, on the pruning third, it covers at least
    ``min_cover`` low-quality rows and ``precision`` of what it covers is low.
    Without labelled rows of both kinds the list is empty. Growing ends when no
    condition gains, covering when a rule is not worth adding.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("label_id"), (F.col(label_col) == 0).cast("int").alias("bad"))
    total = known.count()
    if total > train_rows:
        known = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 31)) < int(train_rows / total * (1 << 31)))
    rows = stored(statistics.where(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("label_id")).select("features", "bad", F.pmod(F.xxhash64("label_id", F.lit(7)), F.lit(3)).alias("fold")), "labelled")
    # candidate thresholds: midway between quantiles of the low and the good rows
    share = [k / 24 for k in range(1, 24)] + [0.005, 0.01, 0.02, 0.98, 0.99, 0.995]
    quantiles = rows.groupBy("bad").agg(*[F.percentile_approx(F.col("features")[i], share, 2000).alias(f"q{i}") for i in range(len(FEATURES))]).collect()
    if len(quantiles) < 2:
        return DecisionList()
    seen = [sorted({v for q in quantiles for v in q[f"q{i}"]}) for i in range(len(FEATURES))]
    edges = [[(a + b) / 2 for a, b in zip(v, v[1:])] for v in seen]

    def binned(i: int) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, edges[i])), lambda v: v < F.col("features")[i])) if edges[i] else F.lit(0)

    bins = F.array(*[binned(i) for i in range(len(FEATURES))])
    rows = stored(rows.select(bins.alias("bins"), "bad", "fold"), "binned")
    grow, prune = rows.where("fold < 2"), rows.where("fold = 2")
    found = DecisionList()
    while True:
        rule: list[Condition] = []
        left, check = grow.where(~found.covered_bins()), prune.where(~found.covered_bins())
        while True:
            counts = left.select(F.posexplode("bins").alias("f", "b"), "bad").groupBy("f", "b").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect()
            best = _best(counts, edges)
            if best is None:
                break
            rule.append(best)
            left = left.where(best.on_bins())
        if not rule:
            break
        cond, parts = F.lit(True), []
        for i, c in enumerate(rule):
            cond &= c.on_bins()
            parts += [F.count_if(cond & (F.col("bad") == 1)).alias(f"p{i}"), F.count_if(cond & (F.col("bad") == 0)).alias(f"n{i}")]
        got = check.agg(*parts).first()
        worth = [((got[f"p{i}"] - got[f"n{i}"]) / max(1, got[f"p{i}"] + got[f"n{i}"]), -i) for i in range(len(rule))]
        size = -max(worth)[1] + 1
        p, n = got[f"p{size - 1}"], got[f"n{size - 1}"]
        if p < min_cover or p < precision * (p + n):
            break
        found.rules.append(rule[:size])
    return found


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that have a label."""
    known = stored(labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("label_id")).distinct(), "labels")
    return docs.join(small_side(known, known.count()), F.col("doc_id") == F.col("label_id"), "left_semi")


def judge(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, and rule (the first that covers it).

    ``kept`` is false if the base test fails, else the list's verdict. A null,
    empty or wordless text has zeros and fails the base test. A very long text
    is judged whole: what a row needs grows with its own length alone.
    Repeated rows and null ids are judged like others; ids that are labelled
    twice count twice. Other columns are not looked at. An empty table gives
    an empty result, and empty labels an empty list.
    """
    statistics = stored(text_statistics(docs), "statistics")
    rule = learn_rules(statistics, labels, train_rows).rule()
    return statistics.withColumn("rule", F.when(~F.col("base_failed"), rule)).select(
        "doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule",
    )


def rule_filtered(docs: DataFrame, labels: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """``docs`` without those that the base test or the rules reject. The list
    is learned from the labelled rows of ``whole``, the table that ``docs`` was
    filtered from, or of ``docs``.

    Texts are read once and stay in their rows. Nulls, ties, repeated rows,
    very long texts and empty tables: as in ``judge``.
    """
    rules = learn_rules(text_statistics(labelled_rows(docs if whole is None else whole, labels)), labels)
    s = free_name(docs, "statistics")
    rows = with_statistics(docs, s)
    covered = rules.rule(F.col(s)["features"]).isNotNull()
    return rows.where(~F.col(s)["base_failed"] & ~covered).select(*docs.columns)
