"""Slices: what lies between two boundaries of the raw source, with exact byte ranges.

A pattern dialect without look-around and back references is read by a small rewriter
and run by the ``regex`` module; ``$`` means the very end unless lines are asked for.
"""

from __future__ import annotations

import re as _re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

try:
    import regex as _engine
except ImportError:  # without it, Unicode property classes are not available
    _engine = _re

Find = Callable[[str, int], "tuple[int, int] | None"]
FLAGS = {"i": _re.I, "m": _re.M, "s": _re.S, "x": _re.X, "U": 0}
_QUANTIFIER = _re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})")


class PatternError(ValueError):
    def __init__(self, message: str, details: dict | None = None):
        super().__init__(message)
        self.message, self.details = message, details


def _adapted(pattern: str, flags: str) -> str:
    """The pattern for Python's engine: anchors, greed, and what the dialect leaves out refused."""
    out, at, swap, lines = [], 0, "U" in flags, "m" in flags
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            two = pattern[at : at + 2]
            if len(two) < 2:
                raise PatternError("incomplete escape sequence")
            if two[1].isdigit() and two[1] != "0" or two[1] in "kgGKXR":
                raise PatternError("backreferences are not supported")
            out.append(r"\Z" if two == r"\z" else two)
            at += 2
        elif c == "[":
            end, first = at + 1, True
            while end < len(pattern) and (pattern[end] != "]" or first):
                first = first and pattern[end] == "^"
                if pattern[end] == "[" and pattern[end + 1 : end + 2] == ":":
                    end = max(end, pattern.find(":]", end) + 1)
                end += 2 if pattern[end] == "\\" else 1
            if end >= len(pattern):
                raise PatternError("unclosed character class")
            out.append(pattern[at : end + 1])
            at = end + 1
        elif pattern.startswith(("(?=", "(?!", "(?<=", "(?<!", "(?>"), at):
            raise PatternError("look-around, including look-ahead and look-behind, is not supported")
        elif c == "(" and pattern.startswith("(?<", at):
            out.append("(?P<")
            at += 3
            continue
        elif c == "(":
            m = _re.match(r"\((?:\?(?:P<\w+>|[a-zA-Z-]*:?))?", pattern[at:])
            out.append(m[0])
            at += m.end()
            continue
        elif c == "$":
            out.append("$" if lines else r"\Z")
            at += 1
        else:
            out.append(c)
            at += 1
        if out[-1] != "" and (m := _QUANTIFIER.match(pattern, at)) and c not in "|(":
            lazy = pattern[m.end() : m.end() + 1] == "?"
            out.append(m[0] + ("?" if lazy != swap else ""))
            at = m.end() + lazy
    return "".join(out)


@lru_cache(maxsize=256)
def finder(pattern: str, regex: bool, flags: str = "") -> Find:
    """Finds a boundary from a position on; :class:`PatternError` if there can be none."""
    if not pattern:
        raise PatternError("Patterns must not be empty.")
    if not regex:

        def literal(text: str, at: int) -> tuple[int, int] | None:
            found = text.find(pattern, at)
            return None if found < 0 else (found, found + len(pattern))

        return literal
    for flag in flags:
        if flag not in FLAGS:
            raise PatternError(f"Unsupported regex flag: {flag}", {"flags": flags})
    try:
        compiled = _engine.compile(_adapted(pattern, flags), sum({FLAGS[f] for f in flags}))
    except (PatternError, _re.error, getattr(_engine, "error", _re.error)) as e:
        raise PatternError(f"Invalid regular expression: {e}", {"pattern": pattern, "flags": flags}) from e

    def search(text: str, at: int) -> tuple[int, int] | None:
        m = compiled.search(text, at)
        return m.span() if m else None

    return search


@dataclass(frozen=True)
class Cut:
    """One slice in characters: where the boundaries begin and end."""

    outer: tuple[int, int]
    inner: tuple[int, int]

    def selected(self, keep_start: bool, keep_end: bool) -> tuple[int, int]:
        return (self.outer[0] if keep_start else self.inner[0], self.outer[1] if keep_end else self.inner[1])


def cuts(text: str, start: Find, end: Find) -> tuple[list[Cut], int | None]:
    """All slices in order; the offset of a start without an end, if there is one.

    An empty slice moves the scan on by one character, so it always ends.
    """
    out, at = [], 0
    while at <= len(text):
        opened = start(text, at)
        if opened is None:
            break
        closed = end(text, opened[1])
        if closed is None:
            return out, opened[0]
        out.append(Cut((opened[0], closed[1]), (opened[1], closed[0])))
        at = closed[1] if closed[1] > opened[0] else opened[0] + 1
    return out, None


class Offsets:
    """Byte offsets of character positions that only grow or are near ones asked before."""

    def __init__(self, text: str):
        self.text, self.ascii, self.known = text, text.isascii(), {0: 0}
        self.last = 0

    def __call__(self, at: int) -> int:
        if self.ascii:
            return at
        if at not in self.known:
            base = self.last if self.last <= at else 0
            self.known[at] = self.known[base] + len(self.text[base:at].encode("utf-8", "surrogatepass"))
            self.last = at
        return self.known[at]


def inside_markup(text: str, positions: set[int]) -> set[int]:
    """Which of the positions lie inside a tag or a comment: one pass over the text."""
    found, todo = set(), sorted(p for p in positions if 0 < p <= len(text))
    for m in _SPAN.finditer(text):
        while todo and todo[0] <= m.start():
            todo.pop(0)
        if not todo:
            break
        closed = m[0].endswith("-->") and len(m[0]) >= 7 if m[0].startswith("<!--") else m["end"] is not None
        found |= {p for p in todo if p < m.end() or p == m.end() and not closed}
    return found


_SPAN = _re.compile(r"<!--(?:.*?-->|.*)|<(?=[A-Za-z/!?])(?:[^'\">]|'[^']*(?:'|$)|\"[^\"]*(?:\"|$))*(?P<end>>)?", _re.S)
