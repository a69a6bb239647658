"""Names that an unknown name may have meant."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

MOST = 3  # fixed value


def edits(a: str, b: str) -> int:
    """How many characters must be put in, taken out or replaced to make ``a`` into ``b``."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(accumulate(zip(b, row, row[1:]), lambda left, at: min(left + 1, at[2] + 1, at[1] + (x != at[0])), initial=i))
    return row[-1]


def nearest(asked: str, names: Iterable[str]) -> list[str]:
    """At most three names, nearest first: those that begin or hold the other, or differ in at most a third of the longer (or two characters)."""
    found, low = [], asked.lower()
    for name in names:
        other = name.lower()
        begins, holds, far = other.startswith(low) or low.startswith(other), other in low or low in other, edits(low, other)
        if holds or far <= max(2, max(len(low), len(name)) // 3):
            found.append((far, not begins, not holds, name))
    return [name for *_, name in sorted(found)[:MOST]]


def hint(asked: str, names: Iterable[str]) -> str:
    """The suggestions as the end of an error message; empty without any."""
    found = nearest(asked, names)
    return f" Did you mean {', '.join(f'`{n}`' for n in found)}?" if found else ""
