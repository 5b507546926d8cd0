"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Two fingerprints within ``2 * half`` bits share a point within ``half`` bits of
each. Every *distinct* fingerprint therefore emits all points of its ball of
half the radius; points are shuffled, and neighbours that met at a point are
verified and linked. All that meet at a point lie within the radius of each
other, so linking each to its predecessor loses no connection and a ball of
copies never becomes all pairs of it. Components give the groups.

Edited copies lie farther apart than fingerprints can tell. For them
``near_copies_removed`` supplements the links: MinHash bands propose pairs, and
a pair counts if its sets of five-word shingles have a Jaccard similarity of
``JACCARD`` or more, compared whole. Those that share a band are first compared
with one of them and with neighbours, which joins copies of one text without
pairing them all; then, in the bands that still hold texts of several groups,
every pair of two groups is compared, in tiles dealt to as many tasks. No pair
that shares a band and is not joined already is left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, connected_components, cut, free_name, release, small_side, stored, tidy

RADIUS = 2
SHINGLE = 3
#: Words of a shingle and least Jaccard similarity (a ratio) of edited copies.
WIDE = 5
JACCARD = (4, 5)
#: MinHash bands and rows of each: a pair at 0.8 shares a band with 0.9996.
BANDS, ROWS = 20, 5
#: Texts of a band whose neighbours are sought together, texts of one side of a
#: tile, and members of their sets that are multiplied at a time.
RUN, TILE, PIECE = 1000, 256, 8192
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a text in UTF-8; 0 if it has no word."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), _BLOCK):
        h = np.array([digest(s, 42) for s in shingles[at:at + _BLOCK]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    out = 0
    for bit in np.flatnonzero(2 * ones > len(shingles)):
        out |= 1 << int(bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long, one row per row."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, fp long")


def ball(radius: int) -> list[int]:
    """Masks of all changes of up to ``radius`` bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)`` links among the distinct values of ``classes.fp``, enough to
    connect all that are joined by steps of ``radius`` bits or fewer.

    An odd radius uses balls of the larger half and drops neighbours that
    verification refuses; there every pair that meets is compared, as meeting
    no longer implies being close.
    """
    half = (radius + 1) // 2
    met = classes.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in ball(half)])).alias("mask")).select(
        F.col("fp").bitwiseXOR(F.col("mask")).alias("point"), "fp"
    )
    if radius % 2 == 0:
        w = W.partitionBy("point").orderBy("fp")
        pairs = met.select("fp", F.lag("fp").over(w).alias("prev")).where(F.col("prev").isNotNull()).select(F.col("prev").alias("a"), F.col("fp").alias("b"))
    else:
        # at most a ball of members (65 for half 1) can meet at one point
        w = W.partitionBy("point").orderBy("fp").rowsBetween(W.unboundedPreceding, -1)
        pairs = met.select("fp", F.collect_list("fp").over(w).alias("earlier")).select(F.explode("earlier").alias("a"), F.col("fp").alias("b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def simhash_groups(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id among all documents that can be
    reached over links of ``radius`` or fewer differing bits, the document
    itself included. A null or empty text, or one without a word, has
    fingerprint zero and is linked like any other; a very long text is hashed
    whole. Repeated rows give repeated
    rows. A null id is never a component's name unless all ids in it are null.
    Other columns are not looked at. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    labels = connected_components(fingerprint_links(classes, radius)).select(F.col("node").alias("fp"), F.col("component").alias("label"))
    labelled = classes.join(labels, "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    names = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = labelled.join(names, "label").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a text in UTF-8; a
    shorter text is one shingle, a text without a word has none."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    width, digest = min(WIDE, len(words)), xxhash.xxh64_intdigest
    known = {w: digest(w, 7) for w in set(words)}
    h = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[i:len(h) - width + 1 + i]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique(out ^ (out >> np.uint64(29)))


_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(11))
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def band_keys(shingles: np.ndarray) -> list[int]:
    """One signed key per MinHash band; none for an empty set."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[at:at + 4096, None] * _TIMES + _PLUS).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[b].tobytes(), b) - (1 << 63) for b in range(BANDS)]


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, fp, same, bands)`` per row; ``same`` is equal for
    equal sets of five-word shingles."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("fp", pa.int64()), ("same", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        release()
        for batch in batches:
            fps, same, bands = [], [], []
            for x in batch.column(2):
                text = x.as_py()
                wide = shingle_set(text)
                fps.append(fingerprint(text))
                same.append(xxhash.xxh64_intdigest(wide.tobytes()) - (1 << 63))
                bands.append(band_keys(wide))
            new = [pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(same, pa.int64()), pa.array(bands, schema.field("bands").type)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=["doc_id", "text_hash", *schema.names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, text_hash long, fp long, same long, bands array<long>")


def band_members(classes: DataFrame) -> DataFrame:
    """``(band, text_hash, fp, n, first)`` of the texts that share a band with
    another: ``n`` is how many share it and ``first`` one of them, in an order
    that differs from band to band. Bands' sizes are stored, so that skew
    handling may split a popular band's texts when they meet them."""
    me = F.struct("text_hash", "fp")
    met = stored(classes.select(F.explode("bands").alias("band"), "text_hash", "fp"), "bands")
    first = F.min(F.struct(F.xxhash64("text_hash", "band").alias("h"), me.alias("me")))["me"]
    sizes = stored(met.groupBy("band").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).where("n > 1"), "sizes")
    return stored(met.join(sizes, "band"), "met")


def star_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs ``(a, b)`` of ``(text_hash, fp)``: each text of a band with
    the first of them and with the two before it. Crowded bands are cut into
    runs of about ``RUN`` texts for the neighbours, so that none is sorted
    whole."""
    me = F.struct("text_hash", "fp")
    order = F.xxhash64("text_hash", "band")
    w = W.partitionBy("band", "run").orderBy(order, "text_hash", "fp")
    runs = members.withColumn("run", F.pmod(F.shiftright(order, 20), F.ceil(F.col("n") / RUN).cast("long")))
    near = runs.select(me.alias("me"), F.array(F.lag(me).over(w), F.lag(me, 2).over(w)).alias("others")).select("me", F.explode("others").alias("other"))
    pairs = members.select(me.alias("me"), F.col("first").alias("other")).unionByName(near).where("other.fp <> me.fp")  # equal ones are linked as they are
    return pairs.select(F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b")).distinct()


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(text_hash, shingles)`` of the distinct texts that ``wanted`` names,
    stored."""
    wanted = cut(wanted.distinct())
    texts = docs.select(F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(small_side(wanted, wanted.count()), "text_hash", "left_semi").dropDuplicates(["text_hash"])

    def run(batches):
        for batch in batches:
            sets = [shingle_set(x.as_py()).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["text_hash", "shingles"])

    return cut(texts.mapInArrow(tidy(run), "text_hash long, shingles array<long>"))


def shingle_links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b)`` fingerprints of the pairs whose similarity is ``JACCARD`` or
    more, by the whole sets of shingles."""
    sets = shingle_sets(docs, pairs.select(F.explode(F.array("a.text_hash", "b.text_hash")).alias("text_hash")))
    both = pairs.select("a", "b", F.col("a.text_hash").alias("text_hash")).join(sets, "text_hash").select("a", "b", F.col("shingles").alias("x"), F.col("b.text_hash").alias("text_hash"))
    both = both.join(sets, "text_hash").select("a", "b", F.size("x").alias("m"), F.size("shingles").alias("n"), F.size(F.array_intersect("x", "shingles")).alias("common"))
    times, of = JACCARD
    return both.where(of * F.col("common") >= times * (F.col("m") + F.col("n") - F.col("common"))).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many members each set of ``xs`` shares with each of ``ys``: a product
    of incidence matrices, a piece of the common members at a time."""
    flat = [np.concatenate(s) if s else np.empty(0, np.int64) for s in (xs, ys)]
    common = np.intersect1d(*flat)
    places = []
    for sets, values in zip((xs, ys), flat):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(common, values)
        known = at < len(common)
        known[known] = common[at[known]] == values[known]
        order = np.argsort(at[known], kind="stable")
        places.append((at[known][order], owner[known][order]))
    out = np.zeros((len(xs), len(ys)), dtype=np.float32)
    for first in range(0, len(common), PIECE):
        parts = []
        for (at, owner), sets in zip(places, (xs, ys)):
            lo, hi = np.searchsorted(at, (first, first + PIECE))
            part = np.zeros((len(sets), min(PIECE, len(common) - first)), dtype=np.float32)
            part[owner[lo:hi], at[lo:hi] - first] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def crowd_links(docs: DataFrame, members: DataFrame, tile: int = TILE) -> DataFrame:
    """``(a, b)`` labels of groups that belong together though the stars left
    them apart: of texts that share a band and are of different groups
    (``members``: band, text_hash, label), every pair is compared.

    A band of one group needs nothing. Others are cut into tiles of ``tile`` by
    ``tile`` texts; a tile gives no more links than it has texts, enough to join
    all that it found alike.
    """
    members = stored(members, "labelled-bands")
    mixed = stored(members.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("band", "n"), "mixed")
    crowd = stored(members.join(mixed, "band"), "crowd")
    schema = "a long, b long"
    if crowd.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    cuts = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64("text_hash", "band"), cuts).cast("int")
    dealt = crowd.select("band", "text_hash", "label", mine.alias("mine"), F.explode(F.sequence(F.lit(0), cuts - 1)).alias("other"))
    dealt = dealt.select("band", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "text_hash", "label", "mine")
    rows = dealt.join(shingle_sets(docs, crowd.select("text_hash")), "text_hash")
    times, of = JACCARD

    def run(group: pa.Table) -> pa.Table:
        labels, side = (group.column(c).to_numpy() for c in ("label", "mine"))
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        shingles = group.column("shingles").combine_chunks()
        ends, values = shingles.offsets.to_numpy(), shingles.values.to_numpy()
        sets = [values[ends[i]:ends[i + 1]] for i in range(group.num_rows)]
        x, y = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        a, b = [], []
        if len(x) and len(y) and len(np.unique(labels)) > 1:
            common = overlaps([sets[i] for i in x], [sets[i] for i in y])
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            alike = of * common >= times * (sizes[x][:, None] + sizes[y][None] - common)
            alike &= labels[x][:, None] != labels[y][None]
            root = {v: v for v in labels.tolist()}

            def find(v):
                while root[v] != v:
                    root[v] = v = root[root[v]]
                return v

            for i, j in zip(*np.nonzero(alike)):
                u, v = find(int(labels[x[i]])), find(int(labels[y[j]]))
                if u != v:
                    root[u] = v
                    a.append(u)
                    b.append(v)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.groupBy("band", "lo", "hi").applyInArrow(run, schema)


def near_copy_groups(docs: DataFrame, radius: int = RADIUS, edited: bool = True) -> DataFrame:
    """``(doc_id, text_hash, fp, label)`` per row: rows with equal labels are
    joined by steps of ``radius`` bits or, if ``edited``, of a Jaccard
    similarity of 0.8 on five-word shingles."""
    rows = cut(sketches(docs))
    links = fingerprint_links(rows.select("fp").distinct(), radius)
    if edited:
        classes = cut(rows.groupBy("same").agg(F.min(F.struct("text_hash", "fp", "bands")).alias("r")).select("same", "r.*"))
        equal = rows.select("same", F.col("fp").alias("b")).distinct().join(classes.select("same", F.col("fp").alias("a")), "same").where("a <> b").select("a", "b")
        members = band_members(classes)
        links = links.unionByName(equal).unionByName(shingle_links(docs, cut(star_pairs(members))))
    labelled = with_labels(rows.select("doc_id", "text_hash", "fp"), "fp", connected_components(links))
    if not edited:
        return labelled
    labelled = stored(labelled, "labelled")
    groups = labelled.select("fp", "label").distinct()
    crowded = members.where("n > 4").join(groups, "fp").select("band", "text_hash", "label")  # stars pair up to four whole
    joined = connected_components(crowd_links(docs, crowded))
    return with_labels(labelled.withColumnRenamed("label", "first_"), "first_", joined).drop("first_")


def with_labels(rows: DataFrame, node: str, components: DataFrame) -> DataFrame:
    """``rows`` with the label of their ``node``; one without links is its own."""
    labels = components.select(F.col("node").alias(node), F.col("component").alias("label"))
    return rows.join(labels, node, "left").select(*rows.columns, F.coalesce("label", F.col(node)).alias("label"))


def _removals(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text_hash)`` of rows that go, and of those that stay but are
    repeated: of each group one document stays."""
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    kept = groups.groupBy("label").agg(F.min(order).alias("r")).select("label", F.col("r.doc_id").alias("kept_id"), F.col("r.text_hash").alias("kept_hash"))
    rows = groups.groupBy("label", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).join(kept, "label")
    stays = F.col("doc_id").eqNullSafe(F.col("kept_id")) & F.col("text_hash").eqNullSafe(F.col("kept_hash"))
    rows = rows.where(~stays | (F.col("n") > 1)).select("doc_id", "text_hash", stays.alias("stays"))
    return rows.where(~F.col("stays")).drop("stays"), rows.where("stays").drop("stays")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but rows that ``gone`` names. It is broadcast if small; texts
    are shuffled only if it is not."""
    a, b = free_name(docs, "gone_id"), free_name(docs, "gone_hash")
    side = gone.select(F.col("doc_id").alias(a), F.col("text_hash").alias(b))
    same = F.col("doc_id").eqNullSafe(F.col(a)) & (F.xxhash64("text") == F.col(b))
    return docs.join(small_side(side, bound=4 * BROADCAST_ROWS), same, "left_anti")


def near_copies_removed(docs: DataFrame, radius: int = RADIUS, edited: bool = True) -> DataFrame:
    """``docs`` with one row of each group of ``near_copy_groups``: the one
    with the smallest id, of texts that share it the one with the least hash,
    and of rows that share both one.

    A null, empty or wordless text is in the group of fingerprint zero; a very
    long one is compared whole. A null id stays only where its whole group has
    none. Extra columns stay as they are. An empty table stays empty.
    """
    gone, again = _removals(cut(near_copy_groups(docs, radius, edited)))
    gone, again = stored(gone, "gone"), stored(again, "again")
    out = _without(docs, gone)
    if again.isEmpty():
        return out
    once = docs.join(small_side(again.select(F.col("doc_id").alias("again_id"), F.col("text_hash").alias("again_hash"))), F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.xxhash64("text") == F.col("again_hash")), "left_semi")
    return _without(out, again).unionByName(once.dropDuplicates(["doc_id", "text"]))
