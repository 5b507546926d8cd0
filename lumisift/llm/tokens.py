"""Byte-level BPE ids of whole texts with the ``tokenizers`` library, memoised.

BPE merges never cross pre-tokens, and a single space between two characters
that are not white space always begins a pre-token. Texts are therefore cut
before such spaces, a batch at a time: each distinct chunk is encoded once by
the library and remembered, up to a fixed number of entries, and the ids of a
batch are gathered from there as vectors. The ids are those of
``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from .common import held

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
#: Remembered chunks per worker; when full, the memo starts anew.
MEMO = 400_000
#: Bytes of texts that are cut and gathered at once; a longer text goes alone.
SPAN = 1 << 20
#: Characters that the library encodes at once.
JOINED = 1 << 16

#: White space of any notion, so that doubtful texts take the plain path.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_DOUBTFUL = f"^{_SPACE}|{_SPACE}$|{_SPACE}{_SPACE}|\\x1f"
#: Marks between a letter and a space are a pre-token of their own.
_MARK = r"(\pL)([^\s\x0b\x1c-\x1f\x{85}\pZ\pL\pN]+)( |$)"
_JOINABLE = re.compile(r"\n?[^\s\x1c-\x1f]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others, in
    order, as the code points from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _ids(tokenizer: Tokenizer, text: str) -> np.ndarray:
    return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)


def _groups(chunks: list[str]) -> Iterator[list[str]]:
    """Runs of chunks of about JOINED characters."""
    group, held = [], 0
    for chunk in chunks:
        group.append(chunk)
        held += len(chunk) + 1
        if held >= JOINED:
            yield group
            group, held = [], 0
    if group:
        yield group


class Encoder:
    def __init__(self, path: str = VOCABULARY, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # threads of one text at a time only hold memory
        self._tokenizer = Tokenizer.from_file(path)
        self._most = memo
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        byte_level = type(self._tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self._tokenizer.normalizer is None
        self._chunked = byte_level and not any(re.search(r"\s", s) for s in self._special)
        # a space is written as this letter, so a token that begins with it begins a chunk
        vocabulary = self._tokenizer.get_vocab()
        self._begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._begins[[i for token, i in vocabulary.items() if token[0] == "Ġ"]] = True
        # words of letters alone are one pre-token each: written in the model's
        # alphabet they need no pre-tokenising but at spaces
        self._letters = _byte_letters()
        self._words = Tokenizer(self._tokenizer.model)
        self._words.pre_tokenizer = CharDelimiterSplit(" ")
        self._reset()

    def _reset(self) -> None:
        self._slots: dict[str, int] = {}  # chunk -> its place in _start and _size
        self._start, self._size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self._pool, self._used, self._n = np.zeros(1 << 16, np.uint32), 0, 0

    def _put(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Append entries to the pool; returns the place of the first."""
        n, m = len(sizes), len(ids)
        while self._used + m > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        while self._n + n > len(self._start):
            self._start, self._size = (np.concatenate([x, np.zeros_like(x)]) for x in (self._start, self._size))
        first = self._n
        self._pool[self._used:self._used + m] = ids
        self._size[first:first + n] = sizes
        self._start[first:first + n] = self._used + np.cumsum(sizes) - sizes
        self._used, self._n = self._used + m, first + n
        return first

    def _plain(self, text: str) -> np.ndarray:
        return _ids(self._tokenizer, text)

    def _spaced(self, chunk: str) -> np.ndarray:
        """A chunk after a space; one that begins with a line feed stands for
        that line feed, without the space, and what follows, and one that
        begins with a unit separator for what follows."""
        return self._plain(chunk.removeprefix("\x1f") if chunk[:1] in "\n\x1f" else " " + chunk)

    def _learn(self, chunks: list[str]) -> None:
        """Remember chunks that stand after a space, many encoded at once."""
        alone, words, others = [], [], []
        for chunk in chunks:
            (words if chunk.isalpha() else others if _JOINABLE.fullmatch(chunk) else alone).append(chunk)
        for group in _groups(words):
            text = "\r " + "\r ".join(group)  # a return stands for the end of a chunk
            letters = text.encode().decode("latin-1").translate(self._letters).replace(self._letters[13] + self._letters[32], " " + self._letters[32])
            self._enter(group, _ids(self._words, letters[1:]), None, alone)
        for group in _groups(others):
            self._enter(group, self._plain(" " + " ".join(group)), np.array([c[0] == "\n" for c in group]), alone)
        for chunk in alone:
            ids = self._spaced(chunk)
            self._slots[chunk] = self._put(ids, np.array([len(ids)]))

    def _enter(self, group: list[str], ids: np.ndarray, lines: np.ndarray | None, alone: list[str]) -> None:
        """Remember the chunks of ``group``, whose ids follow each other. Where
        ``lines``, the space before a line feed is not the text's."""
        at = np.flatnonzero(self._begins[ids])
        if len(at) != len(group) or at[0]:
            alone.extend(group)
            return
        sizes = np.diff(np.append(at, len(ids)))
        if lines is not None:
            ids, sizes = np.delete(ids, at[lines]), sizes - lines
        first = self._put(ids, sizes)
        self._slots.update(zip(group, range(first, first + len(group))))

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text as the library gives them; none for null."""
        return self._plain(text or "")

    def encode_column(self, texts: pa.Array, end: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first row, ids, ids per text)`` for runs of rows of a string
        array, each text followed by ``end`` if given. Null is empty."""
        if not len(texts):
            return
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        row = 0
        while row < len(texts):
            before = sizes[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(sizes, before + SPAN, side="right")))
            got = self._span(pc.fill_null(texts.slice(row, stop - row), ""), end)
            pa.default_memory_pool().release_unused()  # a span's chunks are many times its text
            yield (row, *got)
            row = stop

    def _span(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if self._n >= self._most:
            self._reset()
        if self._chunked:
            odd = pc.match_substring_regex(texts, _DOUBTFUL)
            for s in self._special:
                odd = pc.or_(odd, pc.match_substring(texts, s))
            odd = odd.to_numpy(zero_copy_only=False)
        else:
            odd = np.ones(len(texts), dtype=bool)
        whole = {int(i): self._plain(texts[int(i)].as_py()) for i in np.flatnonzero(odd)}
        if whole:
            texts = pc.if_else(pa.array(odd), "", texts)
        texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " \n"), _MARK, "\\1 \x1f\\2\\3")
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        offsets, chunks = offsets - offsets[0], lists.flatten()
        coded = chunks.dictionary_encode()
        kinds = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        index = coded.indices.to_numpy(zero_copy_only=False)
        firsts = offsets[:-1]
        later = np.ones(len(index), dtype=bool)
        later[firsts] = False
        used = np.zeros(len(kinds), dtype=bool)
        used[index[later]] = True
        self._learn([kinds[k] for k in np.flatnonzero(used) if kinds[k] not in self._slots])
        slot = np.fromiter((self._slots.get(k, 0) for k in kinds), dtype=np.int64, count=len(kinds))[index]
        kept = self._n, self._used
        # entries of this span alone: texts' first chunks, whole texts, the end id
        own = [whole.get(i) if i in whole else self._plain(kinds[index[at]]) for i, at in enumerate(firsts)]
        slot[firsts] = self._put(np.concatenate(own), np.array([len(x) for x in own])) + np.arange(len(own))
        if end is not None:
            slot = np.insert(slot, offsets[1:], self._put(np.array([end], np.uint32), np.array([1])))
            offsets = offsets + np.arange(len(offsets))
        size = self._size[slot]
        bounds = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self._start[slot] - bounds[:-1], size) + np.arange(bounds[-1])
        ids = self._pool[place]
        self._n, self._used = kept
        return ids, np.diff(bounds[offsets])


def encoder(path: str = VOCABULARY, memo: int = MEMO) -> Encoder:
    """One encoder, and so one memo, per worker process, vocabulary and size."""
    return held("encoder", (path, memo), lambda: Encoder(path, memo))
