"""The text of an element as a reader would see it.

A :class:`Writer` collects lines; each kind of element has a method. ``reader`` leaves out
page furniture everywhere; otherwise the selected root itself is exempt.
"""

from __future__ import annotations

import re

from .chrome import CAPTION, SILENT, Signals, heading_level, joins_with_space, squeezed
from .dom import Document, Node, copied, roomy
from .urls import meaningful

# Elements that stand on lines of their own.
BLOCKS = frozenset("article aside blockquote dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header li main p section".split())
_MANY = re.compile("\n{3,}")


def lines_of(text: str) -> list[str]:
    """Lines as ended by a newline, with or without a carriage return; no empty last line."""
    out = [x.removesuffix("\r") for x in text.split("\n")]
    return out[:-1] if out and out[-1] == "" else out


def tidy_line(line: str) -> str:
    rest = line.lstrip()
    inner = squeezed(rest)
    return line[: len(line) - len(rest)] + inner if inner else ""


def spaced(text: str, mode: str) -> str:
    """Apply a white-space mode: ``rendered`` or ``normalize``."""
    if mode == "normalize":
        out: list[str] = []
        for line in map(tidy_line, lines_of(text)):
            if line or not out or out[-1]:
                out.append(line)
        text = "\n".join(out)
    return text.strip("\n")


def without_echoes(text: str) -> str:
    """Drops a line after a heading that repeats it."""
    lines, out, at = lines_of(text), [], 0
    while at < len(lines):
        line = lines[at]
        out.append(line)
        at += 1
        title = line.lstrip("#").strip() if line.startswith("#") else ""
        if not title:
            continue
        after = at
        if lines[at : at + 1] == [""] and len(lines) > at + 1 and lines[at + 1].strip() == title:
            after = at + 1
        else:
            while after < len(lines) and lines[after] == "":
                after += 1
            if after >= len(lines) or lines[after].strip() != line.strip():
                continue
        at = after + 1
        at += lines[at : at + 1] == [""]
        out.append("")
    return "\n".join(out)


def finished(text: str, mode: str) -> str:
    body = _MANY.sub("\n\n", "\n".join(x.rstrip() for x in lines_of(text)))
    return spaced(without_echoes(body).strip("\n"), mode)


def compact(text: str, glue: str) -> str:
    """Non-empty lines joined."""
    return glue.join(x for x in map(tidy_line, lines_of(_MANY.sub("\n\n", text))) if x)


class Writer:
    """Text so far; ``root`` marks the one element that furniture rules spare."""

    def __init__(self, signals: Signals, root: Node | None = None):
        self.text, self.signals, self.root = "", signals, root
        self.spared: set[int] = set()

    def side(self) -> Writer:
        out = Writer(self.signals, None)
        return out

    def put(self, text: str) -> None:
        if text:
            self.text += (" " if joins_with_space(self.text, text) else "") + text

    def line(self, count: int) -> None:
        self.text = self.text.rstrip("\n")
        if self.text:
            self.text += "\n" * count

    def below(self, node: Node, pre: bool = False, item: bool = False, stop: bool = False) -> None:
        seen = bool(self.text.strip())
        for child in node.children:
            if stop and seen and child.kind == "element" and self.signals.ends_narrative(child):
                return
            size = len(self.text)
            self.node(child, pre, item)
            seen = seen or len(self.text) > size

    def aside(self, node: Node, pre: bool = False) -> str:
        """The text of the children alone."""
        out = self.side()
        out.below(node, pre)
        return out.text

    def node(self, n: Node, pre: bool = False, item: bool = False) -> None:
        if n.kind == "text":
            self.put(n.text if pre else squeezed(n.text))
        elif n.kind == "element":
            self.element(n, pre, item)
        else:
            for child in n.children:
                self.node(child, pre, item)

    def element(self, e: Node, pre: bool, item: bool) -> None:
        tag, s = e.tag, self.signals
        if tag in SILENT:
            return
        if tag == "math":
            self.put(math_text(e) or "")
            return
        if s.hidden_style(e):
            self.put(next((math_text(n) or "" for n in e.walk() if n.kind == "element" and n.tag == "math"), ""))
            return
        if s.hidden(e):
            return
        if e is not self.root and id(e) not in self.spared and (s.auxiliary(e) or s.notice(e) or s.attribution(e) or s.auxiliary_section(e) or s.chrome(e)):
            return
        special = getattr(self, f"on_{tag}", None) or (self.on_heading if heading_level(tag) else None)
        if special is not None and special(e, pre):
            return
        row = self.label_row(e, pre)
        if row is not None:
            self.own_lines(row)
            return
        block = tag in BLOCKS
        if block and not item:
            self.line(2)
        self.below(e, pre or tag == "pre", stop=True)
        if block:
            self.line(2)

    def own_lines(self, text: str) -> None:
        self.line(2)
        self.text += text
        self.line(2)

    # -- kinds of elements; each tells whether it is done --------------------------------------

    def on_br(self, e: Node, pre: bool) -> bool:
        self.line(1)
        return True

    def on_hr(self, e: Node, pre: bool) -> bool:
        self.own_lines("---")
        return True

    def on_img(self, e: Node, pre: bool) -> bool:
        if not captioned(e, self.signals):
            self.put(squeezed(e.attrs.get("alt", "")))
        return True

    def on_a(self, e: Node, pre: bool) -> bool:
        label = self.aside(e, pre)
        label = label.strip("\n") if pre else squeezed(label)
        href = e.attrs.get("href", "").strip()
        self.put(f"{label} [{href}]" if label and meaningful(href) and label != href else label)
        return True

    def on_heading(self, e: Node, pre: bool) -> bool:
        if text := heading_text(e, self.signals):
            self.own_lines("#" * heading_level(e.tag) + " " + text)
        return True

    def on_p(self, e: Node, pre: bool) -> bool:
        """True only for a paragraph that is one shouted link."""
        rest = [c for c in e.children if c.kind != "text" or c.text.strip()]
        if len(rest) != 1 or rest[0].kind != "element" or rest[0].tag != "a":
            return False
        text = squeezed(self.aside(rest[0], pre))
        return sum(map(str.isupper, text)) >= 8 and not any(map(str.islower, text))

    def on_ul(self, e: Node, pre: bool) -> bool:
        self.line(2)
        self.below(e)
        self.line(2)
        return True

    on_ol = on_dl = on_ul

    def on_dt(self, e: Node, pre: bool) -> bool:
        self.line(2)
        self.below(e)
        self.line(1)
        return True

    def on_dd(self, e: Node, pre: bool) -> bool:
        self.line(1)
        self.text += ": "
        self.below(e, item=True)
        self.line(2)
        return True

    def on_code(self, e: Node, pre: bool) -> bool:
        if pre:
            return False
        if text := self.aside(e, True).strip():
            self.put(f"`{text}`")
        return True

    def on_blockquote(self, e: Node, pre: bool) -> bool:
        self.line(2)
        self.text += "\n".join("> " + x for x in lines_of(_MANY.sub("\n\n", self.aside(e).strip())))
        self.line(2)
        return True

    def on_li(self, e: Node, pre: bool) -> bool:
        depth = sum(a.kind == "element" and a.tag in ("ul", "ol") for a in e.ancestors())
        indent, marker = "    " * max(depth - 1, 0), item_marker(e)
        parts, nested, run = [], [], self.side()

        def flush() -> None:
            nonlocal run
            parts.append(run.text.strip())
            run = self.side()

        for child in e.children:
            list_, block = child.kind == "element" and child.tag in ("ul", "ol"), child.kind == "element" and (child.tag in BLOCKS or child.tag in ("hr", "pre"))
            if list_ or block:
                flush()
                alone = self.side()
                alone.node(child, pre and block)
                (nested if list_ else parts).append(alone.text.strip("\n") if list_ else alone.text.strip())
            else:
                run.node(child, pre, True)
        flush()
        parts, nested = [p for p in parts if p], [x for x in nested if x]
        if parts or nested:
            self.line(1)
            body = lines_of("\n\n".join(parts))
            after = "\n" + indent + " " * len(marker)
            self.text += "\n".join(([indent + marker + after.join(body)] if body else []) + nested)
            self.line(1)
        return True

    def on_table(self, e: Node, pre: bool) -> bool:
        caption = next((compact(self.aside(c, pre), " ") for c in e.child_elements() if c.tag == "caption"), "")
        rows: list[list[str]] = []

        def collect(n: Node) -> None:
            if n.kind == "element" and n.tag == "tr":
                rows.append([compact(self.aside(c, pre), " / ") for c in n.child_elements() if c.tag in ("td", "th")])
            elif n.kind == "element" and n.tag in ("table", "thead", "tbody", "tfoot"):
                for c in n.children:
                    collect(c)

        collect(e)
        rows = [r for r in rows if any(r)]
        count = max(map(len, rows), default=0)
        rows = [r + [""] * (count - len(r)) for r in rows]
        widths = [max(len(r[i]) for r in rows) for i in range(count)]
        grid = "\n".join(" | ".join([*(c.ljust(w) for c, w in zip(r[:-1], widths, strict=False)), r[-1]]).rstrip() for r in rows).strip("\n")
        text = f"{caption}\n{grid}" if caption and rows else caption or grid
        if text:
            self.own_lines(text)
        return True

    def label_row(self, e: Node, pre: bool) -> str | None:
        """``Label: value`` of a box that holds just these two."""
        parts = e.child_elements()
        if e.tag not in ("div", "section") or len(parts) != 2 or any(c.kind == "text" and c.text.strip() for c in e.children):
            return None
        left, right = [compact(self.aside(c, pre), " ") for c in parts]
        good = left and right and left.endswith(":") and len(left) <= 60 and len(right) <= 160 and "|" not in left + right
        return f"{left} {right}" if good else None


def item_marker(e: Node) -> str:
    parent = e.parent
    if parent is None or parent.kind != "element" or parent.tag != "ol":
        return "- "

    def number(n: Node, name: str) -> int | None:
        value = n.attrs.get(name, "")
        return int(value) if re.fullmatch(r"[+-]?[0-9]+", value, re.ASCII) and -(2**63) <= int(value) < 2**63 else None

    items, back = [c for c in parent.child_elements() if c.tag == "li"], "reversed" in parent.attrs
    at = number(parent, "start")
    at = (len(items) if back else 1) if at is None else at
    for n in items:
        own = number(n, "value")
        at = at if own is None else own
        if n is e:
            break
        at += -1 if back else 1
    return f"{at}. "


def captioned(e: Node, signals: Signals) -> bool:
    """Whether an image stands in or beside a caption, up to three levels up."""
    for depth, up in enumerate(e.ancestors()):
        if up.kind == "element":
            if up.tag in ("figure", "figcaption"):
                return True
            if any(n is not e and (n.tag == "figcaption" or signals.hits(n, CAPTION)) for n in up.walk() if n.kind == "element"):
                return True
            if depth >= 2:
                return False
    return False


def heading_text(e: Node, signals: Signals) -> str | None:
    roomy(e)
    out = Writer(signals)

    def add(n: Node, pre: bool) -> None:
        if n.kind == "text":
            out.put(n.text if pre else squeezed(n.text))
            return
        if n.kind == "element":
            if n.tag in SILENT:
                return
            if n.tag == "math":
                out.put(math_text(n) or "")
                return
            if signals.hidden_style(n):
                out.put(next((math_text(x) or "" for x in n.walk() if x.kind == "element" and x.tag == "math"), ""))
                return
            if signals.skipped(n) or n.tag != "button" and signals.chrome(n):
                return
            if n.tag == "br":
                out.line(1)
                return
            if n.tag == "img":
                out.put(squeezed(n.attrs.get("alt", "")))
                return
        for c in n.children:
            add(c, pre or n.tag == "pre")

    for c in e.children:
        add(c, False)
    return squeezed(out.text) or None


def math_text(e: Node) -> str | None:
    """Mathematics in one line."""
    put = lambda before, text: before + (" " if joins_with_space(before, text) else "") + text

    def group(text: str) -> str:
        return f"({text})" if any(c.isspace() or c in "/^_" for c in text) else text

    def one(n: Node) -> str:
        if n.kind == "text":
            return squeezed(n.text)
        if n.kind == "element":
            if n.tag in ("annotation", "annotation-xml"):
                return ""
            parts = [squeezed(one(c)) for c in n.child_elements()]
            a, b, c = (parts + ["", "", ""])[:3]
            form = ""
            if n.tag == "mfrac" and a and b:
                form = f"{group(a)}/{group(b)}"
            elif n.tag == "msub" and a and b:
                form = f"{a}_{group(b)}"
            elif n.tag == "msup" and a and b:
                form = f"{a}^{group(b)}"
            elif n.tag == "msubsup" and a and b and c:
                form = f"{a}_{group(b)}^{group(c)}"
            elif n.tag == "msqrt" and (inner := squeezed(all_of(n))):
                form = f"sqrt({inner})"
            elif n.tag == "mroot" and a and b:
                form = f"root({a}, {b})"
            if form:
                return form
        return all_of(n)

    def all_of(n: Node) -> str:
        out = ""
        for c in n.children:
            text = one(c)
            out = put(out, text) if text else out
        return out

    return squeezed(one(e)) or squeezed(e.attrs.get("alttext", "")) or None


# -- entry points ----------------------------------------------------------------------------


def element_text(e: Node, mode: str) -> str:
    """The text of a selected element."""
    roomy(e)
    out = Writer(Signals(), e)
    out.node(e)
    return finished(out.text, mode)


def body_text(document: Document, mode: str, reader: bool) -> str:
    """The text of a document's body; unless for a reader, its top elements are exempt from furniture rules."""
    top = document.first("body") or document.html() or document.root
    roomy(top)
    out = Writer(Signals())
    out.spared = set() if reader else {id(c) for c in top.children}
    out.below(top, stop=True)
    return finished(out.text, mode)


def children_text(e: Node, mode: str) -> str:
    roomy(e)
    out = Writer(Signals())
    out.below(e, stop=True)
    return finished(out.text, mode)


def plain_text(e: Node, mode: str) -> str:
    return spaced(e.content(), mode)


def canonical(e: Node, ignored: frozenset[str], strip_blank: bool) -> Node:
    """A detached copy without the ignored attributes and, if asked, without blank text nodes."""
    out = copied(e)
    for n in list(out.walk()):
        if strip_blank and n.kind == "text" and not n.text.strip():
            n.detach()
        elif ignored:
            n.attrs = {k: v for k, v in n.attrs.items() if k.lower() not in ignored}
    return out


def title(document: Document) -> str | None:
    e = document.first("title")
    return (children_text(e, "normalize") or None) if e is not None else None
