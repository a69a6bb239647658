"""The document tree: nodes, traversal, serialisation and paths.

A tree is plain objects with slots, made and used inside one Arrow batch. ``number`` is the
order in which nodes were created, which differs from document order after foster
parenting or the adoption agency; selectors list their candidates by it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

HTML, SVG, MATHML = "html", "svg", "math"
#: Fixed values of the serialisation algorithm.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW_TEXT = frozenset("style script xmp iframe noembed noframes plaintext".split())
PREFIXES = {"xlink": "http://www.w3.org/1999/xlink", "xml": "http://www.w3.org/XML/1998/namespace", "xmlns": "http://www.w3.org/2000/xmlns/"}


class Node:
    """``kind``: document, doctype, comment, text, element or fragment."""

    __slots__ = ("kind", "ns", "tag", "attrs", "text", "parent", "children", "number", "names", "flag")

    def __init__(self, kind: str, number: int, tag: str = "", text: str = "", ns: str = HTML, attrs: dict[str, str] | None = None):
        self.kind, self.number, self.tag, self.text, self.ns = kind, number, tag, text, ns
        self.attrs: dict[str, str] = attrs or {}
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.names: dict[str, str] | None = None  # qualified names of attributes that have a prefix
        self.flag = False

    def append(self, child: Node) -> None:
        child.parent = self
        self.children.append(child)

    def insert(self, at: int, child: Node) -> None:
        child.parent = self
        self.children.insert(at, child)

    def detach(self) -> None:
        if self.parent is not None:
            siblings = self.parent.children
            del siblings[next(i for i, n in enumerate(siblings) if n is self)]
            self.parent = None

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.children))

    def elements(self) -> Iterator[Node]:
        """Elements below this node, itself left out, in document order."""
        return (n for n in self.walk() if n.kind == "element" and n is not self)

    def child_elements(self) -> list[Node]:
        return [n for n in self.children if n.kind == "element"]

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").replace("\t", " ").replace("\n", " ").replace("\f", " ").replace("\r", " ").split(" ")

    def content(self) -> str:
        """All text below."""
        return "".join(n.text for n in self.walk() if n.kind == "text")


class Document:
    """A parsed document and all nodes in the order of their creation."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.quirks = False
        self.root = self.make("document")

    def make(self, kind: str, **values) -> Node:
        node = Node(kind, len(self.nodes), **values)
        self.nodes.append(node)
        return node

    def attached(self) -> set[int]:
        return {n.number for n in self.root.walk()}

    def elements(self) -> list[Node]:
        """Attached elements by creation."""
        live = self.attached()
        return [n for n in self.nodes if n.kind == "element" and n.number in live]

    def first(self, tag: str) -> Node | None:
        return next((n for n in self.elements() if n.tag == tag and n.ns == HTML), None)

    def html(self) -> Node | None:
        return next((n for n in self.root.children if n.kind == "element"), None)

    def clone(self) -> Document:
        """A copy with the same creation numbers."""
        out = Document.__new__(Document)
        out.quirks, out.nodes = self.quirks, []
        for n in self.nodes:
            copy = Node(n.kind, n.number, n.tag, n.text, n.ns, dict(n.attrs))
            copy.names, copy.flag = n.names, n.flag
            out.nodes.append(copy)
        for n, copy in zip(self.nodes, out.nodes, strict=True):
            copy.parent = out.nodes[n.parent.number] if n.parent is not None else None
            copy.children = [out.nodes[c.number] for c in n.children]
        out.root = out.nodes[0]
        return out


def copied(node: Node) -> Node:
    """A detached copy of a subtree."""
    out, todo = None, [(node, None)]
    while todo:
        n, parent = todo.pop()
        copy = Node(n.kind, n.number, n.tag, n.text, n.ns, dict(n.attrs))
        copy.names, copy.flag = n.names, n.flag
        if parent is None:
            out = copy
        else:
            parent.append(copy)
        todo.extend((c, copy) for c in reversed(n.children))
    return out


def roomy(node: Node) -> None:
    """Let recursive renderers go as deep as the subtree of ``node``; Python's own frames need no more of the C stack."""
    deepest, todo = 0, [(node, 1)]
    while todo:
        n, depth = todo.pop()
        deepest = max(deepest, depth)
        todo.extend((c, depth + 1) for c in n.children if c.children)
    if deepest > 100:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 8 * deepest))


def qualified(node: Node, name: str) -> str:
    return (node.names or {}).get(name, name)


def escaped(text: str, attribute: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("\u00a0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;") if attribute else text


def serialized(node: Node, inner: bool = False) -> str:
    """The markup of a node, or of its children alone; attributes sorted by name."""
    out: list[str] = []
    todo: list[Node | str] = list(reversed(node.children)) if inner else [node]  # markup that is due, and nodes
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.kind == "text":
            raw = n.parent is not None and n.parent.kind == "element" and n.parent.ns == HTML and n.parent.tag in RAW_TEXT
            out.append(n.text if raw else escaped(n.text))
        elif n.kind == "element":
            attrs = "".join(f' {q}="{escaped(v, True)}"' for q, v in sorted((qualified(n, k), v) for k, v in n.attrs.items()))
            out.append(f"<{n.tag}{attrs}>")
            if n.ns != HTML or n.tag not in VOID:
                todo.append(f"</{n.tag}>")
                todo.extend(reversed(n.children))
        elif n.kind == "comment":
            out.append(f"<!--{n.text}-->")
        elif n.kind == "doctype":
            out.append(f"<!DOCTYPE {n.text}>")
        else:
            todo.extend(reversed(n.children))
    return "".join(out)


def path_of(node: Node) -> str:
    """``html:nth-of-type(1) > body:nth-of-type(1) > ...``"""
    parts = []
    while node is not None and node.kind == "element":
        place = 1
        for sibling in node.parent.children if node.parent is not None else ():
            if sibling is node:
                break
            place += sibling.kind == "element" and sibling.tag == node.tag
        parts.append(f"{node.tag}:nth-of-type({place})")
        node = node.parent
    return " > ".join(reversed(parts))
