"""Runs of repeated words by partition refinement.

Positions of a text are held in classes: two positions are in one class of level l if the l words from
there on are equal. Level l + 1 refines level l: a position moves by the class of the position after it.
Only classes that split off in the last step are looked at, and of every split class all parts but the
largest (smaller half), so each position is moved at most about log n times. Every class keeps its
positions in a linked list in ascending order. Neighbours of a list at level l whose distance is l are
a square of period l, and never of a smaller one, for then there would be a position between them.
Squares of one period at consecutive positions are one run.

A distance is a square's at exactly one level, so the lists aren't searched at every level: when a
position's neighbour changes, its distance was in force from some level to some level, and that tells.
The refinement is done by numpy over a chunk of texts at a time, texts of like length together, so that the
levels' fixed cost is shared. Levels end at half the words of a text.

Texts never leave their task; nothing is shuffled or collected. A null or empty text has no words, no
runs and no words to keep. A row without a doc_id is taken as it stands by the query. Repeated rows
are each answered. Other columns are ignored. Memory grows with the longest single text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words (and twice its period).
SHORTEST = 12
#: Bytes of text refined at a time.
CHUNK = 4 << 20
_NONE = 1 << 60
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every start, as many as its count says."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


class Partition:
    """Classes of positions at one level: members as segments of one array, and in linked lists by position."""

    def __init__(self, cls: np.ndarray, half: np.ndarray):
        n = len(cls)
        self.cls, self.half, self.level = cls.astype(np.int64), half, 1
        self.members = np.argsort(self.cls, kind="stable")
        self.slot = np.empty(n, np.int64)
        self.slot[self.members] = np.arange(n)
        counts = np.bincount(self.cls)
        self.classes = len(counts)
        self.size, self.start = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.size[: self.classes], self.start[: self.classes] = counts, np.cumsum(counts) - counts
        self.after, self.before = np.full(n, _NONE), np.full(n, -1)
        a, b = self.members[:-1], self.members[1:]
        same = self.cls[a] == self.cls[b]
        self.after[a[same]], self.before[b[same]] = b[same], a[same]
        self.since, self.marked = np.ones(n, np.int64), np.zeros(n, bool)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """Position and period of every square with a primitive root."""
        small = np.arange(1, len(self.cls))
        while len(small):
            small = self.refine(small)
            self.level += 1
        at = np.flatnonzero(self.after != _NONE)
        distance = self.after[at] - at
        held = (self.since[at] <= distance) & (distance <= self.half[at])
        self.found.append((at[held], distance[held]))
        return tuple(np.concatenate(x) for x in zip(*self.found, strict=True))

    def refine(self, small: np.ndarray) -> np.ndarray:
        """One level more; ``small`` and what is returned are the positions of the classes to look at."""
        nothing = np.zeros(0, np.int64)
        at = small - 1
        able = (self.size[self.cls[at]] > 1) & (self.half[at] > self.level)
        at, key = at[able], self.cls[small[able]]
        parent = self.cls[at]
        order = np.lexsort((at, key, parent))
        at, key, parent = at[order], key[order], parent[order]
        if not len(at):
            return nothing
        new = np.concatenate([[True], (parent[1:] != parent[:-1]) | (key[1:] != key[:-1])])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        parts = count < self.size[parent[first]]  # else a class moves as a whole
        if not parts.all():
            rows = np.repeat(parts, count)
            at, parent, new, count = at[rows], parent[rows], new[rows], count[parts]
            if not len(at):
                return nothing
            first = np.flatnonzero(new)
        of = parent[first]
        lead = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        split, moved, most = of[lead], np.add.reduceat(count, lead), np.maximum.reduceat(count, lead)
        rest = self.size[split] - moved
        owner = np.repeat(np.arange(len(split)), np.diff(np.append(lead, len(of))))
        largest, full = np.empty(len(split), np.int64), np.flatnonzero(count == most[owner])
        largest[owner[full[::-1]]] = full[::-1]
        named = np.zeros(len(of), bool)
        named[largest[rest == 0]] = True  # nothing stays, so the largest part keeps the class's number
        number = of.copy()
        fresh = int(len(of) - named.sum())
        number[~named] = self.classes + np.arange(fresh)
        self.classes += fresh
        self._relist(at, parent, new)
        tail = self.start[split] + rest  # members that stay come first in the segment, then the parts
        slots = _spread(tail, moved)
        there = self.members[slots]
        self.marked[at] = True
        stay, holes = there[~self.marked[there]], self.slot[at]
        holes = holes[holes < np.repeat(tail, moved)]
        self.marked[at] = False
        self.members[holes], self.slot[stay] = stay, holes
        self.members[slots], self.slot[at] = at, slots
        self.size[split] = rest
        self.size[number], self.start[number] = count, slots[first]
        self.cls[at] = np.repeat(number, count)
        look = np.ones(len(of), bool)
        look[largest[most > rest]] = False
        left = (rest > 0) & (most > rest)
        return np.concatenate([at[np.repeat(look, count)], self.members[_spread(self.start[split[left]], rest[left])]])

    def _relist(self, at: np.ndarray, parent: np.ndarray, new: np.ndarray) -> None:
        """Take the positions ``at`` (by class and part, then ascending) out of their lists, and make a list of each part."""
        gone = at[np.lexsort((at, parent))]
        chained = self.after[gone[:-1]] == gone[1:]
        begin, end = gone[np.append(True, ~chained)], gone[np.append(~chained, True)]
        left, right = self.before[begin], self.after[end]
        some = right != _NONE
        self.before[right[some]] = left[some]
        inner = ~new[1:]
        follow = np.full(len(at), _NONE)
        follow[:-1][inner] = at[1:][inner]
        self.before[at] = -1
        self.before[at[1:][inner]] = at[:-1][inner]
        some = left >= 0
        who, to = np.concatenate([left[some], at]), np.concatenate([right[some], follow])
        changed = self.after[who] != to
        who, to = who[changed], to[changed]
        distance = self.after[who] - who
        held = (self.since[who] <= distance) & (distance <= self.level)
        if held.any():
            self.found.append((who[held], distance[held]))
        self.after[who], self.since[who] = to, self.level + 1


def runs(texts: list[list], shortest: int = SHORTEST) -> list[np.ndarray]:
    """For each list of words its runs as rows (start, length, period), by start, then period."""
    ids, half, starts, first, at = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [], 1, 1
    for words in texts:
        table = {w: k for k, w in enumerate(dict.fromkeys(words), first)}
        ids.append(np.fromiter(map(table.__getitem__, words), np.int64, len(words)))
        ids.append(np.array([first + len(table)]))  # the end of a text equals nothing
        half.append(np.append(np.full(len(words), len(words) // 2), 0))
        starts.append(at)
        first += len(table) + 1
        at += len(words) + 1
    where, period = Partition(np.concatenate(ids), np.concatenate(half)).squares()
    order = np.lexsort((where, period))
    where, period = where[order], period[order]
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(where)), bool), (where[1:] != where[:-1] + 1) | (period[1:] != period[:-1])]))
    start, q = where[begin], period[begin]
    length = np.diff(np.append(begin, len(where))) - 1 + 2 * q
    order = np.lexsort((q, start))
    order = order[length[order] >= shortest]
    start, length, q = start[order], length[order], q[order]
    cuts = np.searchsorted(start, starts[1:]) if starts else []
    return [np.column_stack([s - o, n, p]) for s, n, p, o in zip(np.split(start, cuts), np.split(length, cuts), np.split(q, cuts), starts, strict=False)]


def collapsed(words: list, found: np.ndarray) -> list:
    """``words`` without those that a run repeats: what is in a run after its first period."""
    if not len(found):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    return list(compress(words, (np.cumsum(depth[:-1]) == 0).tolist()))


def planted(doc_id: int | None, words: list) -> list:
    """The query's words: a tenth of the documents, told by their doc_id, end in a repeated stretch of theirs."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _answer(doc_id: int | None, words: list, found: np.ndarray) -> tuple:
    top = (None,) * 4
    if len(found):
        start, length, period = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
        top = (start, length, period, 1000 * length // period)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
    return doc_id, len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()


def _chunks(texts: list[bytes | None]) -> Iterator[list[int]]:
    """Numbers of texts, about CHUNK bytes at a time, from the shortest to the longest."""
    held, size = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i] or b"")):
        held.append(i)
        size += len(texts[i] or b"")
        if size > CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _found(shortest: int, plant: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names, kinds = [c.split()[0] for c in SCHEMA.split(", ")], [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for chunk in _chunks(texts):
                words = [(texts[i] or b"").split() for i in chunk]  # bytes split at 0x20 and 0x09-0x0D alone
                if plant:
                    words = [planted(ids[i], w) for i, w in zip(chunk, words, strict=True)]
                rows = [_answer(ids[i], w, f) for i, w, f in zip(chunk, words, runs(words, shortest), strict=True)]
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def detect(docs: DataFrame, shortest: int = SHORTEST, plant: bool = False) -> DataFrame:
    """One row per document: doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256; ``plant`` repeats words of a tenth of the documents first."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(_found(shortest, plant), SCHEMA)


def collapse(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with each text cut to the words that no run repeats, one space between them; texts without a run, and all other columns, are as they were."""
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else t.encode("utf-8", "replace") for t in batch.column(at).to_pylist()]
            out = batch.column(at).to_pylist()
            for chunk in _chunks(texts):
                words = [(texts[i] or b"").split() for i in chunk]
                for i, w, found in zip(chunk, words, runs(words, shortest), strict=True):
                    if len(found):
                        out[i] = b" ".join(collapsed(w, found)).decode()
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, schema)


#: The query in DuckDB's SQL: all pairs of equal words at most half a text apart, stretches of one distance, the smallest distance of each.
ORACLE = """
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
        xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
            lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h FROM documents),
    placed AS (SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM split),
    planted AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed),
    word AS MATERIALIZED (SELECT doc_id, n, i, words[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS w FROM (SELECT *, unnest(range(n)) AS i FROM planted)),
    equal AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.w = y.w WHERE y.i > x.i AND y.i - x.i <= x.n // 2),
    stretch AS (SELECT doc_id, min(i) AS s, count(*) + q AS l, q FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM equal) GROUP BY doc_id, q, part HAVING count(*) >= q AND count(*) + q >= 12),
    run AS MATERIALIZED (SELECT doc_id, s, l, min(q) AS q FROM stretch GROUP BY doc_id, s, l),
    told AS (SELECT doc_id, count(*) AS n_runs, arg_max(s, (l, -s, -q)) AS start, max(l) AS length, arg_max(q, (l, -s, -q)) AS period, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM run GROUP BY doc_id),
    repeated AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
    text AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM word ANTI JOIN repeated USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
    sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM documents LEFT JOIN told USING (doc_id) LEFT JOIN text USING (doc_id)
"""
