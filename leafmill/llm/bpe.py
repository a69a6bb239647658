"""Byte-level BPE encoding and decoding with a minimal acyclic transducer lexicon.

1. Words (pieces of the public split pattern) are counted over all documents.
2. The most frequent words, at most ``lexicon``, and their ids, merged exactly, are compiled into a
   shared-suffix automaton (:mod:`transducer`) that Spark ships to executors as a file and
   workers map into memory.
3. Every whole text is cut into words; the distinct words of a chunk run through the
   automaton together; words it does not hold are merged exactly by rank. Decoding looks
   up the bytes of the ids.

The lexicon only decides which words skip the merge loop: ids are the same with any.
Null and empty texts have no ids; the special token's text is the special token, as in the
tokenizer; rows keep any doc_id; repeated rows give repeated results; other columns are
ignored. Texts of any length are cut whole; a word of any length is merged in
O(n log n).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .transducer import Transducer, build, write
from .words import Coder, gather

LEXICON, COUNTED_WORDS = 32_768, 300_000
#: Words of at most so many bytes are merged together; a rank that no merge has.
WIDE, NONE = 40, 1 << 40
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@cache
def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: printable bytes as themselves, others from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        plain = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        out.append(chr(b if plain else spare))
        spare += not plain
    return out


@cache
def classes(top: int) -> tuple[str, str]:
    """Letters and numbers up to code point ``top`` as contents of a character class."""
    out = {"L": [], "N": []}
    for kind, ranges in out.items():
        for c in range(top + 1):
            if unicodedata.category(chr(c))[0] == kind:
                if ranges and ranges[-1][1] == c - 1:
                    ranges[-1][1] = c
                else:
                    ranges.append([c, c])
    one = lambda ranges: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    return one(out["L"]), one(out["N"])


@cache
def _cutter(top: int) -> Callable[[str], list[str]]:
    l, n = classes(top)  # noqa: E741
    s = SPACES
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{l}]+| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+").findall


_ASTRAL = re.compile("[\U00010000-\U0010ffff]").search


def _cut(text: str) -> list[str]:
    return _cutter(sys.maxunicode if not text.isascii() and _ASTRAL(text) else 0xFFFF)(text)


class Vocabulary:
    """The tokenizer file: ids, merge ranks, special tokens and the bytes of each id."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        self.ids = spec["model"]["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        back = {c: b for b, c in enumerate(self.letters)}
        texts = {i: bytes(back[c] for c in t) for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        parts = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.first, self.bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(parts), np.uint8)
        pairs = sorted((self.ids[x] << 32 | self.ids[y], r, self.ids[x + y]) for (x, y), r in self.rank.items())
        self.pair, self.pair_rank, self.pair_id = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
        self.byte_ids = np.array([self.ids[c] for c in self.letters], np.int64)
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else lambda t: [t]

    def cut(self, text: str) -> list[str]:
        if "<|" not in text:
            return _cut(text)
        return [w for i, part in enumerate(self.parts(text)) for w in ([part] if i % 2 else _cut(part))]

    def merge(self, word: str) -> list[int]:
        """The ids of a word by exact merging: always the pair of lowest rank, leftmost first."""
        if word in self.special:
            return [self.special[word]]
        t = [self.letters[b] for b in word.encode()]
        rank, n = self.rank, len(t)
        if n <= 40:
            while len(t) > 1:
                least, i = min((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(t, t[1:], strict=False)))
                if least == 1 << 30:
                    break
                t[i : i + 2] = [t[i] + t[i + 1]]
            return [self.ids[x] for x in t]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rank[p], i, *p) for i, p in enumerate(zip(t, t[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or t[i] != a or t[j] != b:
                continue
            t[i], t[j], after[i] = a + b, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (p := (t[x], t[y])) in rank:
                    heapq.heappush(heap, (rank[p], x, *p))
        return [self.ids[x] for x in t if x]

    def merge_all(self, words: list[str]) -> list[np.ndarray]:
        """:meth:`merge` for many words: one merge of every unfinished word per step, in matrices of tokens by position."""
        out: list = [None] * len(words)
        raw, short = [w.encode() for w in words], []
        for i, (w, r) in enumerate(zip(words, raw, strict=True)):
            if len(r) > WIDE or w in self.special:
                out[i] = np.array(self.merge(w), np.uint32)
            else:
                short.append(i)
        short.sort(key=lambda i: len(raw[i]))  # narrow matrices for short words
        for a in range(0, len(short), 20_000):
            live = np.array(short[a : a + 20_000])
            size = np.array([len(raw[i]) for i in live])
            flat = self.byte_ids[np.frombuffer(b"".join(raw[i] for i in live), np.uint8)]
            width = int(size.max())
            token = np.full((len(live), width + 1), -1, np.int64)
            token[np.arange(width + 1) < size[:, None]] = flat
            rank, made = self._pairs(token[:, :-1], token[:, 1:])
            while len(live):
                at = rank.argmin(1)
                row = np.arange(len(live))
                going = rank[row, at] < NONE
                if not going.all():
                    for i, t, n in zip(live[~going].tolist(), token[~going], size[~going].tolist(), strict=True):
                        out[i] = t[:n].astype(np.uint32)
                    live, token, rank, made, size, at = live[going], token[going], rank[going], made[going], size[going], at[going]
                    row = np.arange(len(live))
                    if not len(live):
                        break
                col = np.arange(token.shape[1] - 1)
                token[row, at] = made[row, at]
                token = np.take_along_axis(token, col + (col > at[:, None]), 1)
                keep = col[:-1] + (col[:-1] > at[:, None]) if token.shape[1] > 1 else col[:0] + at[:, None] * 0
                rank, made = np.take_along_axis(rank, keep, 1), np.take_along_axis(made, keep, 1)
                size = size - 1
                if rank.shape[1]:
                    for pos in (np.maximum(at - 1, 0), np.minimum(at, rank.shape[1] - 1)):
                        rank[row, pos], made[row, pos] = self._pairs(token[row, pos], token[row, pos + 1])
                else:
                    rank, made = np.full((len(live), 1), NONE), np.zeros((len(live), 1), np.int64)
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair of ids; rank ``NONE`` where they do not merge."""
        key = left << 32 | np.maximum(right, 0)
        i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = (self.pair[i] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_rank[i], NONE), self.pair_id[i]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``ids``, and where each id's bytes end."""
        size = self.size[ids]
        return gather(self.bytes, self.first[ids], size), np.cumsum(size)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _counted(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = vocabulary(path).cut, Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(cut(text.as_py() or ""))
                if len(seen) > COUNTED_WORDS:
                    yield pa.record_batch([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                    seen.clear()
        yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return run


def compile_lexicon(docs: DataFrame, path: str, lexicon: int = LEXICON) -> str:
    """Ship an automaton of the most frequent words of all documents; returns the shipped file's name."""
    counts = docs.select(F.col("text").cast("string")).mapInArrow(_counted(path), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    often = saved(counts.where("n > 1").withColumn("size", F.floor(F.log2("n") * 16).cast("int")), "words")
    room, least = lexicon, None  # whole size classes of frequency, at most 1024 of them, so that no more than the lexicon comes to the driver
    for r in often.groupBy("size").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("size")).collect():
        if r["words"] > room:
            break
        room, least = room - r["words"], r["size"]
    top = [] if least is None else [r["word"] for r in often.where(F.col("size") >= least).select("word").collect()]
    own = vocabulary(path)
    made = build(sorted((w.encode(), own.merge(w)) for w in top if w not in own.special))
    with tempfile.NamedTemporaryFile(prefix="lexicon-", suffix=".bin", delete=False) as file:
        write(made, file.name)
    docs.sparkSession.sparkContext.addFile(file.name)
    return Path(file.name).name


def _encoded(path: str, shipped: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = vocabulary(path), Transducer(SparkFiles.get(shipped))

        def resolve(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ranks = known.ranks([w.encode() for w in words]).tolist()
            unseen = iter(own.merge_all([w for w, rank in zip(words, ranks, strict=True) if rank < 0]))
            parts = [known.ids[known.first[rank] : known.first[rank + 1]] if rank >= 0 else next(unseen) for rank in ranks]
            return np.concatenate(parts), np.array(list(map(len, parts)), np.int64)

        coder = Coder(own.cut, resolve)
        for batch in batches:
            texts, rows = [t or "" for t in batch.column(1).to_pylist()], ([], [], [])
            for ids, ends in coder.encode(texts):
                data, stop = own.decode(ids)
                stop, at = np.concatenate([[0], stop]), 0
                for end in ends.tolist():
                    back = data[stop[at] : stop[end]].tobytes().decode("utf-8", "replace").encode()
                    for row, value in zip(rows, (end - at, hashlib.sha256(ids[at:end].astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()), strict=True):
                        row.append(value)
                    at = end
            yield pa.record_batch([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, path: str, lexicon: int = LEXICON) -> DataFrame:
    """One row per document: number of ids, digests of the ids and of the decoded text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shipped = compile_lexicon(docs, path, lexicon)
    return docs.mapInArrow(_encoded(path, shipped), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
