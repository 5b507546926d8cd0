"""Unigram token counts with dynamic programming shared through a trie.

A pre-token's best segmentation maximises the sum of its pieces' log
probabilities. The forward score of a position depends on the prefix alone, so
what two pre-tokens share is computed once: the *distinct* pre-tokens of the
corpus are dealt out by range and inserted in a trie in sorted order, so that
only the path to the last one has to be kept, whose nodes hold the forward
score, the number of pieces, the last piece, and the state of an automaton that
knows all pieces ending there. The path is kept from batch to batch of a task. A
pre-token's count is read at its terminal node.

1. One grouped count gives the corpus's distinct pre-tokens and how often each
   occurs.
2. The pieces are those of a public byte-level vocabulary. Their probabilities
   are estimated from the whole corpus: every distinct pre-token is segmented
   with a prior that falls with a piece's rank, and its pieces are counted as
   often as it occurs (a step of hard expectation maximisation).
3. Every distinct pre-token is segmented with those probabilities; documents
   sum the counts of their words, which are split once more for it. Common
   words' counts are broadcast; of the rest each document's distinct ones, with
   their number, meet theirs in a join.
"""

from __future__ import annotations

import base64
import math
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded_batches, held, shuffle_partitions, small_side, stored, trimmed_split

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
BREAKS = r"[\x20\x09-\x0D]+"
SHIFT = 256
#: Pseudo-count of a piece.
SMOOTH = 0.1
#: What a byte that is no piece costs below the least probable piece.
UNKNOWN = 10.0
#: Words whose counts are broadcast, the most frequent first, of at most
#: ``COMMON_BYTES`` each: 48 MB with their counts, under ``BROADCAST_BYTES``.
COMMON, COMMON_BYTES = 1_000_000, 24
assert COMMON * (COMMON_BYTES + 24) <= BROADCAST_BYTES


@lru_cache(maxsize=2)
def pieces_of(path: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's pieces by rank."""
    with open(path, "rb") as lines:
        return [p for _, p in sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, lines))]


def prior_scores(pieces: list[bytes]) -> np.ndarray:
    return -np.log(np.arange(len(pieces)) + SHIFT)


def fitted_scores(counts: np.ndarray) -> np.ndarray:
    return np.log(counts + SMOOTH) - math.log(counts.sum() + SMOOTH * len(counts))


class Automaton:
    """All pieces that end at a place of a text, by one step a byte."""

    def __init__(self, pieces: list[bytes]):
        have = set(pieces)
        self.n = len(pieces)
        listed = [*pieces, *(bytes([b]) for b in range(256) if bytes([b]) not in have)]
        child: list[dict[int, int]] = [{}]
        own: list[tuple[int, int] | None] = [None]
        for i, piece in enumerate(listed):
            at = 0
            for byte in piece:
                to = child[at].get(byte)
                if to is None:
                    to = child[at][byte] = len(child)
                    child.append({})
                    own.append(None)
                at = to
            own[at] = (len(piece), i)
        self.child, self.fail = child, [0] * len(child)
        #: (length, number) of the pieces that end in a state, the longest first
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(child)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            if at:
                self.ends[at] = ((own[at],) if own[at] else ()) + self.ends[self.fail[at]]
            for byte, to in child[at].items():
                back = self.fail[at]
                while back and byte not in child[back]:
                    back = self.fail[back]
                self.fail[to] = child[back].get(byte, 0) if at else 0
                queue.append(to)

    def step(self, at: int, byte: int) -> int:
        while at and byte not in self.child[at]:
            at = self.fail[at]
        return self.child[at].get(byte, 0)


def automaton(path: str) -> Automaton:
    """One automaton per worker process and vocabulary."""
    return held("automaton", path, lambda: Automaton(pieces_of(path)))


class Path:
    """The trie's path to the last pre-token: the automaton's state, forward
    score, number of pieces and last piece of each node; ``scored`` counts the
    nodes that were made."""

    def __init__(self):
        self.last = b""
        self.state, self.best, self.pieces, self.back = [0], [0.0], [0], [(0, 0)]
        self.scored = 0


def segmented(words: Iterable[str], machine: Automaton, scores: np.ndarray, times: Iterable[int] | None = None, counts: np.ndarray | None = None, path: Path | None = None) -> Iterator[int]:
    """The number of pieces of each pre-token (a space and the word). Of equally
    good segmentations the one with fewest pieces counts, of these the one with
    the longest last piece. ``counts`` gets each piece's number as often as
    ``times`` says. Words need not be sorted, but sharing is best if they are;
    ``path`` goes on from what was segmented before."""
    value = [*scores.tolist(), *[float(scores.min()) - UNKNOWN if len(scores) else -UNKNOWN] * 256]
    ends, step, n_known = machine.ends, machine.step, machine.n
    path = path or Path()
    state, best, pieces, back = path.state, path.best, path.pieces, path.back
    weights = iter(times) if times is not None else None
    for word in words:
        text = b" " + word.encode("utf-8", "surrogatepass")
        same = 0
        for a, b in zip(text, path.last):
            if a != b:
                break
            same += 1
        del state[same + 1:], best[same + 1:], pieces[same + 1:], back[same + 1:]
        path.scored += len(text) - same
        for i in range(same, len(text)):
            at = step(state[i], text[i])
            top, fewest, how = -math.inf, 0, (0, 0)
            for end in ends[at]:
                j = i + 1 - end[0]
                total = best[j] + value[end[1]]
                if total > top or (total == top and pieces[j] + 1 < fewest):
                    top, fewest, how = total, pieces[j] + 1, end
            state.append(at)
            best.append(top)
            pieces.append(fewest)
            back.append(how)
        path.last = text
        if counts is not None:
            weight, i = next(weights), len(text)
            while i:
                size, piece = back[i]
                if piece < n_known:
                    counts[piece] += weight
                i -= size
        yield pieces[-1]


def distinct_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)`` of the whole corpus: each file holds a range of words, in
    order, so a prefix lies in one file or begins or ends a few."""
    words = docs.select(F.explode(trimmed_split(F.col(text_col), BREAKS)).alias("word"))
    counted = stored(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "counted")
    return stored(counted.repartitionByRange(shuffle_partitions(docs.sparkSession), "word").sortWithinPartitions("word"), "words")


def fit_scores(words: DataFrame, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Log probabilities of the vocabulary's pieces over the corpus."""
    n = len(pieces_of(vocabulary))

    def run(batches):
        machine, prior, counts, path = automaton(vocabulary), prior_scores(pieces_of(vocabulary)), np.zeros(n, dtype=np.int64), Path()
        for batch in batches:
            for _ in segmented(batch.column(0).to_pylist(), machine, prior, batch.column(1).to_pylist(), counts, path):
                pass
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used])], names=["piece", "n"])

    totals = np.zeros(n)
    # a row per piece of the vocabulary, at most
    for r in words.select("word", "n").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        totals[r["piece"]] = r["n"]
    return fitted_scores(totals)


def word_counts(words: DataFrame, scores: np.ndarray, vocabulary: str = VOCABULARY) -> DataFrame:
    """``words`` with the number of pieces of each."""
    def run(batches):
        machine, path = automaton(vocabulary), Path()
        for batch in batches:
            found = list(segmented(batch.column(0).to_pylist(), machine, scores, path=path))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=["word", "n", "pieces"])

    return stored(words.select("word", "n").mapInArrow(run, "word string, n long, pieces int"), "counted")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, common: int = COMMON) -> DataFrame:
    """Per row: doc_id, n_pretokens (words between white space) and n_tokens.

    A null, empty or wordless text has zeros; a very long one is counted whole.
    Repeated rows and null ids are counted like others; extra columns are
    ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    words = distinct_words(docs, text_col)
    counted = word_counts(words, fit_scores(words, vocabulary), vocabulary)
    short = counted.where(F.octet_length("word") <= COMMON_BYTES)
    # how often a word must occur to be among the most frequent ``common``
    rows = short.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect()  # a row per frequency: far fewer than words
    least, held = math.inf, 0
    for r in rows:
        held += r["words"]
        if held > common:
            break
        least = r["n"]
    is_common = (F.octet_length("word") <= COMMON_BYTES) & (F.col("n") >= (least if least < math.inf else 1 << 62))
    known = counted.where(is_common).select(F.col("word").alias("known_word"), F.col("pieces").alias("known"))
    rare = counted.where(~is_common).select("word", "pieces")
    # a text's hash with its id names a row; repeated rows are counted together and parted at the end
    # hashed before it is split, so that no word carries its text along
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), trimmed_split(F.col(text_col), BREAKS).alias("split"))
    exploded = rows.select("doc_id", "text_hash", F.posexplode_outer("split").alias("pos", "said")).join(small_side(known, bound=max(1, common)), F.col("said") == F.col("known_word"), "left")
    key = ["doc_id", "text_hash"]
    # one row for all common words of a document, and one for each rare one
    unknown = F.when(F.col("known").isNull(), F.col("said")).alias("word")
    found = stored(exploded.groupBy(*key, unknown).agg(
        F.count("said").alias("words"), F.coalesce(F.sum("known"), F.lit(0)).alias("tokens"), F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("rows")
    ), "found")
    met = found.where("word IS NOT NULL").join(rare, "word").select(*key, (F.col("words") * F.col("pieces")).alias("tokens"))
    zero = F.lit(0).cast("long")
    both = found.select(*key, "words", "tokens", "rows").unionByName(met.select(*key, zero.alias("words"), "tokens", zero.alias("rows"))).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("words", "tokens", "rows")])
    each = both.select("doc_id", F.expr("words div rows").alias("n_pretokens"), F.expr("tokens div rows").alias("n_tokens"), "rows")
    return each.withColumn("again", F.explode(F.expr("sequence(1, rows)"))).select("doc_id", "n_pretokens", "n_tokens")
