"""A minimal acyclic automaton that maps words to token ids.

Words are added in byte order; equal suffixes share states (registered by their
transitions), so the automaton is minimal. Each transition carries how many words come
before those behind it; the sum along a path is the word's rank, which points at its ids
in a flat table. All parts are plain arrays in one file, mapped into memory read-only, so
the workers of a machine share one copy. Lookups step through all words of a batch at
once, one byte per step.
"""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

import numpy as np

PARTS = [("key", np.int64), ("target", np.int32), ("skip", np.int32), ("final", np.int32), ("first", np.int32), ("ids", np.uint32)]


def build(entries: Iterable[tuple[bytes, list[int]]]) -> dict[str, np.ndarray]:
    """Arrays of the automaton for distinct words in byte order with their ids."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1].items()))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path, last, ids, first = [[False, {}]], b"", [], [0]  # a node: is it final, byte -> frozen state
    for word, out in entries:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for at in range(len(last), same, -1):
            path[at - 1][1][last[at - 1]] = freeze(path.pop())
        path += [[False, {}] for _ in word[same:]]
        path[-1][0] = True
        last = word
        ids += out
        first.append(len(ids))
    for at in range(len(last), 0, -1):
        path[at - 1][1][last[at - 1]] = freeze(path.pop())
    root = freeze(path[0])
    words = np.zeros(len(states), np.int64)  # children are frozen before their parents
    key, target, skip = [], [], []
    for s, (final, edges) in enumerate(states):
        seen = int(final)
        for byte, to in edges:
            key.append(s << 8 | byte)
            target.append(to)
            skip.append(seen)
            seen += words[to]
        words[s] = seen
    order = np.argsort(np.array(key, np.int64), kind="stable")
    made = {"key": np.array(key, np.int64)[order], "target": np.array(target, np.int32)[order], "skip": np.array(skip, np.int32)[order]}
    made |= {"final": np.array([f for f, _ in states], np.int32), "first": np.array(first, np.int32), "ids": np.array(ids, np.uint32)}
    return made | {"root": np.array([root], np.int64)}


def write(made: dict[str, np.ndarray], path: str) -> None:
    head = np.array([made["root"][0], *[len(made[k]) for k, _ in PARTS]], np.int64)
    Path(path).write_bytes(head.tobytes() + b"".join(made[k].astype(t).tobytes() for k, t in PARTS))


class Transducer:
    """An automaton mapped from a file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        head, at = raw[: 8 * (1 + len(PARTS))].view(np.int64), 8 * (1 + len(PARTS))
        self.root = int(head[0])
        for (name, kind), n in zip(PARTS, head[1:], strict=True):
            size = int(n) * np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + size].view(kind))
            at += size

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, or -1 where the automaton has none."""
        out, length = np.full(len(words), -1, np.int64), np.array([len(w) for w in words], np.int64)
        if not len(self.key) or not words:
            return out
        flat, start = np.frombuffer(b"".join(words) + b"\0", np.uint8), np.cumsum(length) - length
        live = np.flatnonzero(length > 0)
        state, rank, at = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            want = state << 8 | flat[start[live] + at]
            i = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[i] == want
            live, i, rank = live[ok], i[ok], rank[ok]
            state, rank, at = self.target[i].astype(np.int64), rank + self.skip[i], at + 1
            end = length[live] == at
            if end.any():
                hit = end & (self.final[state] == 1)
                out[live[hit]] = rank[hit]
                live, state, rank = live[~end], state[~end], rank[~end]
        return out
