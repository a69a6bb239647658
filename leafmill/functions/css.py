"""CSS selectors: a parser with positioned errors, and matching over the document tree.

A selector list is a tuple of complex selectors; a complex selector is its compounds from
right to left with the combinator that leads to each next one. The same parsed form
drives the tree matcher here and the relational compiler in ``operators.relational``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from .dom import HTML, Document, Node
from .html_tokens import lower

# HTML attributes whose values compare without case.
FOLDED = frozenset(
    "accept accept-charset align alink axis bgcolor charset checked clear codetype color compact declare defer dir direction disabled enctype face frame hreflang http-equiv lang language link media method multiple nohref noresize noshade nowrap readonly rel rev rules scope scrolling selected shape target text type valign valuetype vlink".split()
)
_IDENT = re.compile(r"(?:--|-?(?:[A-Za-z_\u0080-\U0010ffff]|\\[^\n\r\f]))(?:[A-Za-z0-9_\-\u0080-\U0010ffff]|\\(?:[0-9a-fA-F]{1,6}[ \t\n\r\f]?|[^\n\r\f]))*")
_HASH = re.compile(r"(?:[A-Za-z0-9_\-\u0080-\U0010ffff]|\\(?:[0-9a-fA-F]{1,6}[ \t\n\r\f]?|[^\n\r\f]))+")
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})[ \t\n\r\f]?|([^\n\r\f]))")
_WS = re.compile(r"(?:[ \t\n\r\f]|/\*.*?(?:\*/|$))*", re.S)
_NTH = re.compile(r"(?i)[ \t\n\r\f]*(?:(odd)|(even)|([+-]?\d*)n(?:[ \t\n\r\f]*([+-])[ \t\n\r\f]*(\d+))?|([+-]?\d+))[ \t\n\r\f]*")


class SelectorError(ValueError):
    """Where and how a selector is wrong: line from 1, column in UTF-16 units from 1, class."""

    def __init__(self, kind: str, text: str, at: int):
        super().__init__(kind)
        before = text[:at]
        self.kind, self.line = kind, before.count("\n") + 1
        self.column = len(before[before.rfind("\n") + 1 :].encode("utf-16-le")) // 2 + 1


@dataclass(frozen=True)
class Simple:
    """One condition. ``kind``: tag, id, class, attr, nth, not, is, has, root, empty, never."""

    kind: str
    name: str = ""
    op: str = ""
    value: str = ""
    flag: str = ""
    a: int = 0
    b: int = 0
    inner: tuple = ()
    any_ns: bool = False


@dataclass(frozen=True)
class Complex:
    """``compounds[0]`` is the subject; ``combinators[i]`` leads from compound i to i + 1."""

    compounds: tuple[tuple[Simple, ...], ...]
    combinators: tuple[str, ...] = ()


def _plain(ident: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            n = int(m[1], 16)
            return "�" if n == 0 or n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n)
        return m[2]

    return _ESCAPE.sub(one, ident)


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, kind: str, at: int | None = None):
        raise SelectorError(kind, self.text, self.at if at is None else at)

    def space(self) -> bool:
        end = _WS.match(self.text, self.at).end()
        moved, self.at = end > self.at, end
        return moved

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def ident(self) -> str | None:
        m = _IDENT.match(self.text, self.at)
        if m:
            self.at = m.end()
            return _plain(m[0])
        return None

    def list_(self, end: str, forgiving: bool = False, relative: bool = False, inside: str = "") -> tuple[Complex, ...]:
        out = []
        while True:
            start = self.at
            try:
                out.append(self.complex(end, relative, inside))
            except SelectorError:
                if not forgiving:
                    raise
                self.at = start
                self.skip(end)
            self.space()
            if self.peek() == ",":
                self.at += 1
                continue
            if self.peek() == end:
                return tuple(out)
            if not self.peek():
                self.fail("end_of_input" if end else "empty_selector")
            self.fail("unexpected_token")

    def skip(self, end: str) -> None:
        depth, quote = 0, ""
        while self.at < len(self.text):
            c = self.text[self.at]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "([":
                depth += 1
            elif c in ")]":
                if not depth:
                    return
                depth -= 1
            elif c == "," and not depth:
                return
            self.at += 1

    def complex(self, end: str, relative: bool, inside: str) -> Complex:
        self.space()
        compounds, combinators, lead = [], [], " "
        if relative and self.peek() in (">", "+", "~"):
            lead = self.peek()
            self.at += 1
            self.space()
        while True:
            start = self.at
            compound = self.compound(inside)
            if not compound:
                if compounds:
                    self.fail("dangling_combinator", start)
                c = self.peek()
                if c in (">", "+", "~") and c:
                    self.fail("dangling_combinator" if not compounds else "unexpected_token")
                if c and c not in (",", end or ","):
                    self.fail("explicit_namespace_unexpected_token" if c == "|" else "unexpected_token")
                self.fail("empty_selector", self.at)
            compounds.append(tuple(compound))
            gap = self.space()
            c = self.peek()
            if c and c in ">+~":
                self.at += 1
                self.space()
                combinators.append(c)
                if not self.peek() or self.peek() in ("," + end):
                    self.fail("dangling_combinator")
            elif gap and c and c not in ("," + end):
                combinators.append(" ")
            else:
                break
        if relative:
            combinators.append(lead)
            compounds.insert(0, (Simple("anchor"),))
            combinators = [combinators[-1], *combinators[:-1]]
        return Complex(tuple(reversed(compounds)), tuple(reversed(combinators)))

    def compound(self, inside: str) -> list[Simple]:
        out: list[Simple] = []
        start, name = self.at, None
        if self.peek() == "*":
            self.at += 1
            name = "*"
        else:
            name = self.ident()
        if self.peek() == "|" and self.text[self.at + 1 : self.at + 2] != "=":
            prefix, bar = name, self.at
            self.at += 1
            if self.peek() == "*":
                self.at += 1
                name = "*"
            else:
                name = self.ident()
                if name is None:
                    self.fail("explicit_namespace_unexpected_token")
            if prefix not in (None, "*"):
                self.fail("expected_namespace", bar)
            if prefix is None:
                out.append(Simple("never"))
        if name is not None:
            out.append(Simple("any") if name == "*" else Simple("tag", name))
        while c := self.peek():
            start = self.at
            if c == "#":
                m = _HASH.match(self.text, self.at + 1)
                if not m or not _IDENT.fullmatch(m[0]):
                    self.fail("unexpected_token", start)
                self.at = m.end()
                out.append(Simple("id", value=_plain(m[0])))
            elif c == ".":
                self.at += 1
                ident = self.ident()
                if ident is None:
                    self.fail("class_needs_ident")
                out.append(Simple("class", value=ident))
            elif c == "[":
                out.append(self.attribute())
            elif c == ":":
                out.append(self.pseudo(inside))
            elif _IDENT.match(self.text, self.at) or c == "*":
                self.fail("unexpected_ident" if c != "*" else "unexpected_token")
            else:
                break
        return out

    def attribute(self) -> Simple:
        self.at += 1
        self.space()
        start = self.at
        any_ns = False
        if self.text.startswith("*|", self.at):
            self.at += 2
            any_ns = True
        elif self.peek() == "|" and self.text[self.at + 1 : self.at + 2] != "=":
            self.at += 1
        name = self.ident()
        if name is None:
            self.fail("invalid_qualified_name_in_attribute_selector" if self.peek() else "end_of_input", start)
        if self.peek() == "|" and self.text[self.at + 1 : self.at + 2] != "=":
            self.fail("expected_namespace")
        self.space()
        if self.peek() == "]":
            self.at += 1
            return Simple("attr", name, "", any_ns=any_ns)
        op = next((o for o in ("=", "~=", "|=", "^=", "$=", "*=") if self.text.startswith(o, self.at)), None)
        if op is None:
            self.fail("unexpected_token_in_attribute_selector" if self.peek() else "end_of_input")
        self.at += len(op)
        self.space()
        c, at = self.peek(), self.at
        if c and c in "\"'":
            end = self.at + 1
            while end < len(self.text) and self.text[end] != c and self.text[end] != "\n":
                end += 2 if self.text[end] == "\\" else 1
            if end < len(self.text) and self.text[end] == "\n":
                self.fail("invalid_attribute_value", at)
            value, self.at = _plain(self.text[self.at + 1 : end].replace("\\\n", "")), min(end + 1, len(self.text))
        else:
            value = self.ident()
            if value is None:
                self.fail("invalid_attribute_value" if c else "end_of_input", at)
        self.space()
        flag = ""
        if self.peek() and self.peek() != "]":
            ident = self.ident()
            if ident is None or lower(ident) not in ("i", "s"):
                self.fail("unexpected_token_in_attribute_selector")
            flag = lower(ident)
            self.space()
        if self.peek() == "]":
            self.at += 1
        elif self.peek():
            self.fail("unexpected_token_in_attribute_selector")
        return Simple("attr", name, op, value, flag, any_ns=any_ns)

    def pseudo(self, inside: str) -> Simple:
        start = self.at
        self.at += 1
        if self.peek() == ":":
            self.at += 1
            self.ident()
            self.fail("unsupported_pseudo_class_or_element", start)
        name = self.ident()
        if name is None:
            self.fail("pseudo_element_expected_ident" if not self.peek() else "no_ident_for_pseudo")
        name = lower(name)
        if self.peek() != "(":
            simple = {
                "root": Simple("root"), "scope": Simple("root"), "empty": Simple("empty"), "first-child": Simple("nth", "child", b=1), "last-child": Simple("nth", "last-child", b=1),
                "first-of-type": Simple("nth", "of-type", b=1), "last-of-type": Simple("nth", "last-of-type", b=1), "only-child": Simple("only", "child"), "only-of-type": Simple("only", "of-type"),
            }.get(name)
            if simple is None:
                self.fail("unsupported_pseudo_class_or_element", start)
            return simple
        self.at += 1
        if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
            m = _NTH.match(self.text, self.at)
            if not m or self.text[m.end() : m.end() + 1] != ")":
                self.fail("unexpected_token" if self.peek() else "end_of_input")
            self.at = m.end() + 1
            if m[1] or m[2]:
                a, b = 2, 1 if m[1] else 0
            elif m[6]:
                a, b = 0, int(m[6])
            else:
                a = int(m[3] + "1") if m[3] in ("", "+", "-") else int(m[3])
                b = int((m[4] or "+") + (m[5] or "0"))
            return Simple("nth", name.removeprefix("nth-"), a=a, b=b)
        if name in ("not", "is", "where", "has"):
            if name == "has" and inside == "has":
                self.fail("unsupported_pseudo_class_or_element", start)
            within = "has" if name == "has" or inside == "has" else name
            inner = self.list_(")", name in ("is", "where"), name == "has", within)
            self.at += 1
            return Simple("is" if name == "where" else name, inner=inner)
        if name == "host":
            self.compound(inside)
            self.space()
            if self.peek() != ")":
                self.fail("unexpected_token")
            self.at += 1
            return Simple("never")
        self.fail("unsupported_pseudo_class_or_element", start)
        raise AssertionError


@lru_cache(maxsize=512)
def parse(text: str) -> tuple[Complex, ...]:
    """The selector list of ``text``; :class:`SelectorError` where it is wrong."""
    return _Reader(text).list_("")


# -- matching ------------------------------------------------------------------------


def fits(op: str, value: str | None, want: str) -> bool:
    if value is None:
        return False
    if op == "":
        return True
    if op == "=":
        return value == want
    if op == "|=":
        return value == want or value.startswith(want + "-")
    if not want:
        return False
    if op == "~=":
        return want in re.split("[ \t\n\r\f]+", value)
    return {"^=": value.startswith, "$=": value.endswith, "*=": value.__contains__}[op](want)


class Matcher:
    """Matches elements of one tree; sibling positions are counted once per parent."""

    def __init__(self) -> None:
        self.places: dict[int, dict[int, tuple[int, int, int, int]]] = {}
        self.siblings: dict[int, list[Node]] = {}
        self.held: dict[tuple[int, int, int], dict] = {}
        self.anchors: dict[int, set[int]] = {}

    def place(self, e: Node) -> tuple[int, int, int, int]:
        """Position among siblings from either end, and among those of its type."""
        parent = e.parent
        if parent is None:
            return (1, 1, 1, 1)
        held = self.places.get(id(parent))
        if held is None:
            held, all_, seen = {}, parent.child_elements(), {}
            counts: dict[tuple[str, str], int] = {}
            for n in all_:
                counts[n.tag, n.ns] = counts.get((n.tag, n.ns), 0) + 1
            for i, n in enumerate(all_):
                k = seen[n.tag, n.ns] = seen.get((n.tag, n.ns), 0) + 1
                held[id(n)] = (i + 1, len(all_) - i, k, counts[n.tag, n.ns] - k + 1)
            self.places[id(parent)], self.siblings[id(parent)] = held, all_
        return held[id(e)]

    def any(self, selectors: tuple[Complex, ...], e: Node) -> bool:
        return any(self.complex(s, e, 0) for s in selectors)

    def complex(self, s: Complex, e: Node, i: int, anchor: Node | None = None) -> bool:
        if not all(self.simple(c, e, anchor) for c in s.compounds[i]):
            return False
        if i == len(s.combinators):
            return True
        how = s.combinators[i]
        if how == ">":
            return e.parent is not None and e.parent.kind == "element" and self.complex(s, e.parent, i + 1, anchor)
        held = self.held.setdefault((id(s), i, id(anchor)), {})
        if how == " ":
            return self.above(s, e, i, anchor, held)
        at = self.place(e)[0] - 1
        if not at or e.parent is None:
            return False
        before = self.siblings[id(e.parent)]
        if how == "+":
            return self.complex(s, before[at - 1], i + 1, anchor)
        first, tried = held.get(id(e.parent), (None, 0))  # the first sibling that matches, and how many were tried
        while first is None and tried < at:
            first = tried if self.complex(s, before[tried], i + 1, anchor) else None
            tried += 1
        held[id(e.parent)] = first, tried
        return first is not None and first < at

    def above(self, s: Complex, e: Node, i: int, anchor: Node | None, held: dict) -> bool:
        """Whether some ancestor of ``e`` matches; each ancestor is asked once."""
        passed, found = [], False
        up = e
        while not found and up.parent is not None and up.parent.kind == "element":
            if (known := held.get(id(up))) is not None:
                found = known
                break
            passed.append(up)
            up = up.parent
            found = self.complex(s, up, i + 1, anchor)
        for n in passed:
            held[id(n)] = found
        return found

    def having(self, s: Complex, e: Node) -> set[int]:
        """All elements of the tree of ``e`` from which a relative selector leads to some element: found once, from its subjects back."""
        if id(s) not in self.anchors:
            top = e
            while top.parent is not None:
                top = top.parent
            found = [n for n in top.walk() if n.kind == "element" and all(self.simple(c, n, None) for c in s.compounds[0])]
            for simples, how in zip(s.compounds[1:], s.combinators, strict=True):
                found = [n for n in self.leading(how, found) if all(c.kind == "anchor" or self.simple(c, n, None) for c in simples)]
            self.anchors[id(s)] = {id(n) for n in found}
        return self.anchors[id(s)]

    def leading(self, how: str, found: list[Node]) -> list[Node]:
        """The elements from which a combinator leads to one of ``found``, each once and in linear time."""
        out: dict[int, Node] = {}
        last: dict[int, int] = {}
        for n in found:
            up = n.parent
            if up is None:
                continue
            if how in "+~":
                at = self.place(n)[0] - 1
                if how == "~":
                    last[id(up)] = max(last.get(id(up), 0), at)
                elif at:
                    before = self.siblings[id(up)][at - 1]
                    out[id(before)] = before
            elif how == ">":
                if up.kind == "element":
                    out[id(up)] = up
            else:
                while up is not None and up.kind == "element" and id(up) not in out:
                    out[id(up)] = up
                    up = up.parent
        return [*out.values(), *(n for up, at in last.items() for n in self.siblings[up][:at])]

    def simple(self, c: Simple, e: Node, anchor: Node | None) -> bool:
        kind = c.kind
        if kind == "any":
            return True
        if kind == "tag":
            return e.tag == (lower(c.name) if e.ns == HTML else c.name)
        if kind == "id":
            return e.attrs.get("id") == c.value
        if kind == "class":
            return c.value in e.classes()
        if kind == "attr":
            name = lower(c.name) if e.ns == HTML else c.name
            value = e.attrs.get(name)
            if value is not None and e.names and name in e.names and not c.any_ns:
                return False
            want = c.value
            if value is not None and (c.flag == "i" or c.flag != "s" and e.ns == HTML and name in FOLDED):
                value, want = lower(value), lower(want)
            return fits(c.op, value, want)
        if kind == "anchor":
            return e is anchor
        if kind == "nth":
            at = self.place(e)[("child", "last-child", "of-type", "last-of-type").index(c.name)]
            return at == c.b if c.a == 0 else (at - c.b) % c.a == 0 and (at - c.b) // c.a >= 0
        if kind == "only":
            p = self.place(e)
            return p[0] == p[1] == 1 if c.name == "child" else p[2] == p[3] == 1
        if kind == "root":
            return e.parent is not None and e.parent.kind == "document"
        if kind == "empty":
            return not any(n.kind == "element" or n.kind == "text" and n.text for n in e.children)
        if kind == "not":
            return not self.any(c.inner, e)
        if kind == "is":
            return self.any(c.inner, e)
        if kind == "has":
            return any(id(e) in self.having(s, e) for s in c.inner)
        return False


def select(document: Document, selectors: tuple[Complex, ...]) -> list[Node]:
    """Matching elements in the order of creation."""
    m = Matcher()
    return [e for e in document.elements() if m.any(selectors, e)]
