"""URL filter: rules of host and path, and boosted trees on lexical features.

A rule decides the URLs of its host and all subdomains whose path begins with
the rule's; the longest wins. What no rule decides, gradient-boosted trees do.
They are fitted to labelled URLs by logistic loss: features are cut into bins,
equal rows of bins are counted once, and each level of a tree takes one grouped
sum of gradients per node, feature and bin. Only these sums, whose number does
not grow with the input, reach the driver. The ensemble is emitted as a sum of
conditional expressions.

Built-in DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, small_side, stored

# The rules of the query, (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words between dots, hyphens and digits of a host that mark it as junk. They
#: label URLs where no labels are at hand.
SEED_WORDS = (
    "ad", "ads", "adserver", "adult", "bet", "bets", "betting", "bonus", "casino", "cheap", "click", "clicks", "coupon", "crack", "deal", "deals", "farm", "free", "gambling", "gratis", "jackpot", "loan", "loans",
    "lottery", "phish", "pharma", "pill", "pills", "poker", "popup", "porn", "promo", "sex", "slots", "spam", "sponsor", "spy", "track", "tracker", "tracking", "traffic", "viagra", "warez", "win", "winner", "xxx",
)
#: Most labelled URLs that trees are fitted to, chosen by a hash of the URL.
TRAIN_ROWS = 200_000
FEATURES = ("url_length", "host_length", "path_length", "host_labels", "longest_label", "depth", "digit_ratio", "hyphens", "entropy", "parameters", "query_length", "suffix_rate")
#: Trees, levels of each, share of a leaf that is added, weight of no evidence.
TREES, LEVELS, RATE, SHRINK = 16, 3, 0.3, 1.0
#: Gradients are summed as whole parts of so many, in any order alike.
UNIT = 1 << 20
#: Rows of the suffix table that stand for the common rate.
SUFFIX_PRIOR = 20.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _url(url: Column) -> Column:
    return F.coalesce(url, F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first ``://``, in lower case; empty if there is none."""
    return F.translate(F.regexp_extract(_url(url), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_url(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(_url(url), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """``(verdict, rule)`` of the longest rule that fits, or null. Of rules of
    equal length the first by text wins. A rule without a slash has the empty
    path."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<verdict:string,rule:string>") if out is None else out


def _entropy(text: Column) -> Column:
    """Bits per character, from the runs of the sorted characters."""
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("s"))

    def term(run: Column) -> Column:
        return F.when(run > 1, run * F.log2(run.cast("double"))).otherwise(0.0)

    def step(acc: Column, c: Column) -> Column:
        same = acc["last"] == c
        return F.struct(c.alias("last"), F.when(same, acc["run"] + 1).otherwise(1).alias("run"), (acc["s"] + F.when(same, 0.0).otherwise(term(acc["run"]))).alias("s"))

    n = F.length(text)
    total = F.aggregate(F.array_sort(F.split(text, "")), zero, step, lambda a: a["s"] + term(a["run"]))
    return F.when(n > 1, F.log2(n.cast("double")) - total / n).otherwise(0.0)


def lexical(url: Column) -> Column:
    """A struct of host, path, suffix (the host's last label) and ``values``:
    all ``FEATURES`` but the suffix's rate."""
    def measured(x: Column) -> Column:
        host, path, query = x["host"], x["path"], x["query"]
        labels = F.split(host, r"\.")
        chars = F.greatest(F.lit(1), F.length(x["url"]))
        values = (
            F.length(x["url"]), F.length(host), F.length(path), F.size(labels), F.array_max(F.transform(labels, F.length)), F.regexp_count(path, F.lit("/+[^/]")),
            F.regexp_count(x["url"], F.lit("[0-9]")) / chars, F.regexp_count(host, F.lit("-")), _entropy(host), F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1), F.length(query),
        )
        return F.struct(host.alias("host"), path.alias("path"), F.element_at(labels, -1).alias("suffix"), F.array(*[v.cast("double") for v in values]).alias("values"))

    parts = F.struct(_url(url).alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), query_of(url).alias("query"))
    return let(parts, measured)


def with_lexical(rows: DataFrame) -> DataFrame:
    """``rows`` with the struct ``u`` of their ``url``, made by a generator, so
    that its fields are computed once."""
    return rows.select("*", F.explode(F.array(lexical(F.col("url")))).alias("u"))


def seed_labels(urls: DataFrame, words=SEED_WORDS) -> DataFrame:
    """``(url, blocked)``: 1 where the host bears a seed word, 0 elsewhere. URLs
    without a host have no label."""
    host = host_of(F.col("url"))
    marked = F.arrays_overlap(F.split(host, "[^a-z]+"), F.array(*map(F.lit, words)))
    return urls.select("url", marked.cast("int").alias("blocked")).where(host != "")


@dataclass
class Boosted:
    """Trees over binned features: ``{node: (feature, bin) or leaf value}``,
    node ``i`` having children ``2 i`` (at most the bin) and ``2 i + 1``."""

    base: float = -1.0
    trees: list[dict] = field(default_factory=list)
    edges: list[list[float]] = field(default_factory=list)
    common: float = 0.0
    suffixes: DataFrame | None = None

    def bins(self, values: Column) -> Column:
        """Bins of all features from their values: how many edges lie below."""
        def place(i: int) -> Column:
            out = F.lit(0)
            for edge in self.edges[i]:
                out = out + (values[i] > edge).cast("int")
            return out

        return F.array(*[place(i) for i in range(len(FEATURES))])

    def with_rates(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``values`` of all features: the suffix's rate is that of
        the labelled URLs, a suffix that none of them has takes the common."""
        side = self.suffixes.select(F.col("suffix").alias("known_"), "rate")
        joined = rows.join(small_side(side), F.col("u.suffix") == F.col("known_"), "left")
        return joined.withColumn("values", F.concat(F.col("u.values"), F.array(F.coalesce("rate", F.lit(self.common))))).drop("known_", "rate")

    def _value(self, tree: dict, node: int, bins: Column) -> Column:
        at = tree[node]
        if not isinstance(at, tuple):
            return F.lit(float(at))
        return F.when(bins[at[0]] <= at[1], self._value(tree, 2 * node, bins)).otherwise(self._value(tree, 2 * node + 1, bins))

    def score(self, bins: Column) -> Column:
        """The log odds that a URL is to be blocked."""
        return sum((self._value(t, 1, bins) for t in self.trees), F.lit(self.base))


def _gain(g: float, h: float) -> float:
    return g * g / (h + SHRINK)


def best_split(cells: dict[int, dict[int, tuple[float, float]]]) -> tuple | None:
    """``(feature, bin, left value, right value)`` with the greatest gain of the
    cells ``feature -> bin -> (gradient, curvature)``; of equal ones the first."""
    best, top = None, 1e-6
    for f, bins in sorted(cells.items()):
        g0, h0 = (sum(x[k] for x in bins.values()) for k in (0, 1))
        g = h = 0.0
        for b in sorted(bins)[:-1]:
            g, h = g + bins[b][0], h + bins[b][1]
            if (gain := _gain(g, h) + _gain(g0 - g, h0 - h) - _gain(g0, h0)) > top + 1e-9:
                best, top = (f, b, RATE * g / (h + SHRINK), RATE * (g0 - g) / (h0 - h + SHRINK)), gain
    return best


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Boosted:
    """Fit trees to ``labelled`` (url, blocked 0 or 1); rows with a null in
    either are not used, of more than ``train_rows`` a share is, by the hash of
    the URL. Rows that repeat count again.

    Without URLs of both kinds there are no trees and the one kind decides;
    without any nothing is blocked.
    """
    known = labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull())
    total = known.count()
    if total > train_rows:
        known = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 31)) < int(train_rows / total * (1 << 31)))
    rows = stored(with_lexical(known.select("url", "blocked")).select("u", "blocked"), "urls")
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    model = Boosted(common=bad / n if n else 0.0)
    model.edges = [[] for _ in FEATURES]
    rate = (F.sum("blocked") + SUFFIX_PRIOR * model.common) / (F.count(F.lit(1)) + SUFFIX_PRIOR)
    model.suffixes = stored(rows.groupBy("u.suffix").agg(rate.alias("rate")), "suffixes")
    if not 0 < bad < n:
        model.base = 1.0 if n and bad == n else -1.0
        return model
    model.base = math.log(bad / (n - bad))
    rows = model.with_rates(rows).select("values", "blocked")
    share = [k / 12 for k in range(1, 12)]
    quantiles = rows.groupBy("blocked").agg(*[F.percentile_approx(F.col("values")[i], share, 1000).alias(f"q{i}") for i in range(len(FEATURES))]).collect()
    seen = [sorted({v for q in quantiles for v in q[f"q{i}"]}) for i in range(len(FEATURES))]
    model.edges = [[(a + b) / 2 for a, b in zip(v, v[1:])] for v in seen]
    cells = rows.groupBy(model.bins(F.col("values")).alias("bins")).agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("bad"))
    cells = stored(cells.coalesce(max(1, min(n, train_rows) // 25_000)), "cells")  # at most a sample's worth
    bins = F.col("bins")
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-F.col("score")))
        state = cells.select("bins", "n", "bad", model.score(bins).alias("score")).select("bins", F.round((F.col("bad") - F.col("n") * p) * UNIT).cast("long").alias("g"), F.round(F.col("n") * p * (1 - p) * UNIT).cast("long").alias("h"))
        tree: dict = {1: 0.0}
        open_nodes = [1]
        for _ in range(LEVELS):
            sums = state.select(node_of(tree, bins).alias("node"), "g", "h", F.posexplode("bins").alias("f", "b")).where(F.col("node").isin(open_nodes)).groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            at: dict = {}
            for r in sums:
                at.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"] / UNIT, r["h"] / UNIT)
            grown = []
            for node in open_nodes:
                if split := best_split(at.get(node, {})):
                    tree[node], tree[2 * node], tree[2 * node + 1] = split[:2], split[2], split[3]
                    grown += [2 * node, 2 * node + 1]
            open_nodes = grown
            if not grown:
                break
        if not isinstance(tree[1], tuple):
            break
        model.trees.append(tree)
    return model


def node_of(tree: dict, bins: Column, node: int = 1) -> Column:
    """The number of the leaf that a row of bins falls into."""
    at = tree[node]
    if not isinstance(at, tuple):
        return F.lit(node)
    return F.when(bins[at[0]] <= at[1], node_of(tree, bins, 2 * node)).otherwise(node_of(tree, bins, 2 * node + 1))


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, train_rows: int = TRAIN_ROWS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block) and
    score, the trees' log odds of a block.

    Trees are fitted to ``labelled`` (url, blocked) or, without it, to the
    pages' own URLs as ``seed_labels`` marks them. A null URL, or one without
    ``://``, has an empty host and path, fits no rule and is judged by the trees
    like others. Repeated rows give repeated rows; a very long URL is measured
    whole. Other columns are not looked at. An empty table gives an empty
    result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    model = fit(seed_labels(rows) if labelled is None else labelled, train_rows)
    found = model.with_rates(with_lexical(rows).select("page_id", "u"))
    rule = ruled(F.col("u.host"), F.col("u.path"), rules)
    found = found.select("page_id", "u.host", "u.path", rule.alias("r"), model.score(model.bins(F.col("values"))).alias("score"))
    learned = F.when(F.col("score") > 0, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", learned).alias("verdict"), "score")
