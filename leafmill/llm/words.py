"""Texts as runs of known words: the batch machinery that both tokenizing operators share.

A text is cut into words; each distinct word is resolved to token ids once per worker
while it stays in a bounded table, and the ids of whole chunks of texts are gathered
with numpy. Chunks bound the memory that words and ids take, whatever a batch holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that are held as words at a time, and words in the table.
CHUNK_CHARS, TABLE_WORDS = 1_000_000, 500_000
#: Bytes of text that Arrow cuts at a time.
CHUNK_BYTES = 8_000_000


def gather(flat: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices ``flat[first:first + length]`` one after another."""
    ends = np.cumsum(length)
    at = np.repeat(first - (ends - length), length)
    at += np.arange(len(at))
    return flat[at]


class _Codes(dict):
    """Numbers words as they are first looked up."""

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


class Coder:
    """``resolve`` gives the token ids of a list of new words one after another, and how many each word has."""

    def __init__(self, cut: Callable[[str], list[str]], resolve: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.cut, self.resolve = cut, resolve
        self.clear()

    def codes_of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words))

    def encode_column(self, column: pa.Array, split: Callable[[pa.Array], pa.ListArray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As :meth:`encode`, of texts without nulls that Arrow splits: a word that occurs often is looked up once a chunk."""
        sizes, at = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < len(column):
            self.shrink()
            past = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, past + CHUNK_BYTES, "right")))
            words = split(column.slice(at, to - at))
            found = words.flatten().dictionary_encode()
            yield self.ids_of(self.codes_of(found.dictionary.to_pylist())[found.indices.to_numpy(zero_copy_only=False)], words.value_lengths().to_numpy(zero_copy_only=False))
            at = to

    def ids_of(self, code: np.ndarray, counts: np.ndarray | list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of coded words, and where the texts of so many words each end among them."""
        self._learn()
        length = self.length[code]
        after = np.concatenate([[0], np.cumsum(length)])
        return gather(self.flat, self.first[code], length), after[np.cumsum(counts, dtype=np.int64)]

    def shrink(self) -> None:
        """Start anew when the table is full."""
        if len(self.codes) > TABLE_WORDS:
            self.clear()

    def clear(self) -> None:
        self.codes = _Codes()
        self.codes.new = []
        self.first, self.length, self.flat, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32), 0

    def _learn(self) -> None:
        words, self.codes.new = self.codes.new, []
        if not words:
            return
        ids, n = self.resolve(words)
        known = len(self.codes) - len(words)
        while len(self.first) < len(self.codes):
            self.first, self.length = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.length, np.zeros_like(self.length)])
        while len(self.flat) < self.used + n.sum():
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.length[known : len(self.codes)] = n
        self.first[known : len(self.codes)] = self.used + np.cumsum(n) - n
        self.flat[self.used : self.used + n.sum()] = ids
        self.used += int(n.sum())

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For chunk after chunk: the ids of its texts, and where each text ends among them."""
        at = 0
        while at < len(texts):
            self.shrink()
            codes, ends, chars = [], [], 0  # arrays of codes by text, and their sizes
            while at < len(texts) and (not ends or chars + len(texts[at]) <= CHUNK_CHARS):
                words = self.cut(texts[at])
                codes.append(self.codes_of(words))
                ends.append(len(words))
                chars += len(texts[at])
                at += 1
            yield self.ids_of(np.concatenate(codes), ends)
