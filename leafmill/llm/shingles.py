"""Sets of word shingles as 64-bit hashes, computed with numpy over chunks of texts.

Words are runs of bytes other than space and 0x09-0x0D, A-Z in lower case. A word's hash
is a polynomial over a table of random bytes values, taken from running sums over the
whole chunk; a shingle's hash mixes those of its words. Texts with fewer words than a
shingle have one shingle of all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes of text hashed at a time.
CHUNK = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_SEPARATOR = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BYTE[_SEPARATOR] = 0
_BASE = 0x9E3779B97F4A7C15
_STEP = _rng.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        one = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
        _powers[:] = [one(_BASE), one(pow(_BASE, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(texts: list[str | None]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "replace").lower()
        if held and size + len(raw) > CHUNK:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield held


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes in ascending order."""
    for held in _chunks(texts):
        data = np.frombuffer(b" ".join(held) + b" ", np.uint8)
        size = np.array([len(x) + 1 for x in held])
        up, down = _power(len(data))
        total = np.cumsum(_BYTE[data] * up, dtype=np.uint64)
        inside = ~_SEPARATOR[data]
        start = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        end = np.flatnonzero(~inside & np.concatenate([[False], inside[:-1]]))  # first byte after the word
        before = np.where(start > 0, total[np.maximum(start - 1, 0)], np.uint64(0))
        word = mixed((total[end - 1] - before) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = np.searchsorted(start, np.concatenate([[0], np.cumsum(size)]))
        full = max(0, len(word) - words + 1)
        run = np.zeros(full, np.uint64)
        for k in range(words if full else 0):
            run += word[k : k + full] * _STEP[k]
        run = mixed(run)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(run[a : b - words + 1])
            elif b > a:
                yield mixed((word[a:b] * _STEP[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def set_key(grams: np.ndarray) -> int:
    """A 64-bit key of a whole set: equal sets have equal keys."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)
