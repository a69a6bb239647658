"""CSS selectors as relational plans over the node table.

A compound is a filter; combinators are semi joins from left to right: child on the parent's
id, siblings on the parent and their ordinals, descendants on the document with the
containment interval as a residual. ``:not`` is an anti join, ``:is`` a semi join on a union,
``:has`` a semi join with the interval turned around. All are exchanged and merged, none is broadcast; each is keyed by the
document and the node or parent that it asks for, so joins with different keys exchange their narrow sides anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.css import FOLDED, Complex, Simple, parse
from ..functions.html_tokens import lower
from ..sources.tables import met

_FOLD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _attribute(c: Simple) -> Column:
    here = F.col("ns") == "html"
    if lower(c.name) != c.name or c.flag == "" and c.op and lower(c.name) in FOLDED:  # html folds these, other namespaces do not
        return F.when(here, _compared(c, lower(c.name), True)).otherwise(_compared(c, c.name, False))
    return _compared(c, c.name, True)


def _compared(c: Simple, name: str, html: bool) -> Column:
    value, want = F.col("attrs")[name], c.value
    if c.flag == "i" or c.flag != "s" and html and name in FOLDED:
        value, want = F.translate(value, *_FOLD), lower(want)
    if c.op == "":
        return value.isNotNull()
    if c.op == "=":
        return value == want
    if c.op == "|=":
        return (value == want) | value.startswith(want + "-")
    if not want:
        return F.lit(False)
    if c.op == "~=":
        return F.array_contains(F.split(value, "[ \t\n\r\f]+"), want)
    return {"^=": value.startswith, "$=": value.endswith, "*=": value.contains}[c.op](want)


def _condition(c: Simple) -> Column | None:
    """What a simple selector asks of a node by itself; None if it needs others."""
    if c.kind in ("any", "anchor"):
        return F.lit(True)
    if c.kind == "tag":
        return F.when(F.col("ns") == "html", F.col("tag") == lower(c.name)).otherwise(F.col("tag") == c.name)
    if c.kind == "id":
        return F.col("attrs")["id"] == c.value
    if c.kind == "class":
        return F.array_contains(F.split(F.col("attrs")["class"], "[ \t\n\r\f]"), c.value)
    if c.kind == "attr":
        return _attribute(c)
    if c.kind == "nth":
        at = F.col({"child": "elem_ordinal", "last-child": "elem_last", "of-type": "type_ordinal", "last-of-type": "type_last"}[c.name])
        return at == c.b if c.a == 0 else (F.pmod(at - c.b, F.lit(abs(c.a))) == 0) & ((at - c.b) * (1 if c.a > 0 else -1) >= 0)
    if c.kind == "only":
        first, last = ("elem_ordinal", "elem_last") if c.name == "child" else ("type_ordinal", "type_last")
        return (F.col(first) == 1) & (F.col(last) == 1)
    if c.kind == "root":
        return F.col("depth") == 1
    if c.kind == "empty":
        return F.col("is_empty")
    if c.kind == "never":
        return F.lit(False)
    return None


class Compiler:
    def __init__(self, nodes: DataFrame, keys: list[str]):
        self.keys = keys
        self.nodes = nodes.where("kind = 'element'")

    def compound(self, simples: tuple[Simple, ...], pool: DataFrame) -> DataFrame:
        for c in simples:
            if (asked := _condition(c)) is not None:
                pool = pool.where(F.coalesce(asked, F.lit(False)))
        for c in simples:
            if c.kind in ("is", "not"):
                found = self.any(c.inner).select(*self.keys, "node_id").distinct()
                pool = met(pool, found, [*self.keys, "node_id"], "left_semi" if c.kind == "is" else "left_anti")
            elif c.kind == "has":
                pool = self.has(c.inner, pool)
        return pool

    def any(self, selectors: tuple[Complex, ...]) -> DataFrame:
        parts = [self.complex(s) for s in selectors]
        return reduce(DataFrame.union, parts).dropDuplicates([*self.keys, "node_id"]) if len(parts) > 1 else parts[0] if parts else self.nodes.limit(0)

    def step(self, how: str, right: DataFrame, left: DataFrame) -> DataFrame:
        """Rows of ``right`` that stand to some row of ``left`` as the combinator says."""
        l = left.select(*[F.col(k).alias(f"_l_{k}") for k in (*self.keys, "node_id", "parent_id", "pre", "post", "elem_ordinal")])  # noqa: E741
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in self.keys])
        on &= {
            " ": (F.col("_l_pre") < F.col("pre")) & (F.col("post") < F.col("_l_post")), ">": F.col("parent_id") == F.col("_l_node_id"),
            "+": (F.col("parent_id") == F.col("_l_parent_id")) & (F.col("elem_ordinal") == F.col("_l_elem_ordinal") + 1),
            "~": (F.col("parent_id") == F.col("_l_parent_id")) & (F.col("elem_ordinal") > F.col("_l_elem_ordinal")),
        }[how]
        return met(right, l, on, "left_semi")

    def complex(self, s: Complex) -> DataFrame:
        found = self.compound(s.compounds[-1], self.nodes)
        for simples, how in zip(reversed(s.compounds[:-1]), reversed(s.combinators), strict=True):
            found = self.step(how, self.compound(simples, self.nodes), found)
        return found

    def has(self, selectors: tuple[Complex, ...], pool: DataFrame) -> DataFrame:
        """Rows of ``pool`` from which some relative selector leads to a node.

        The path is walked back from its subject, the combinators turned around, up to the anchor.
        """
        marks = []
        for s in selectors:
            found = self.compound(s.compounds[0], self.nodes)
            for simples, how in zip(s.compounds[1:], s.combinators, strict=True):
                up = pool if simples and simples[0].kind == "anchor" else self.compound(simples, self.nodes)
                found = self.back(how, up, found)
            marks.append(found.select(*self.keys, "node_id"))
        return met(pool, reduce(DataFrame.union, marks).distinct(), [*self.keys, "node_id"], "left_semi")

    def back(self, how: str, left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.select(*[F.col(k).alias(f"_r_{k}") for k in (*self.keys, "node_id", "parent_id", "pre", "post", "elem_ordinal")])
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in self.keys])
        on &= {
            " ": (F.col("pre") < F.col("_r_pre")) & (F.col("_r_post") < F.col("post")), ">": F.col("_r_parent_id") == F.col("node_id"),
            "+": (F.col("parent_id") == F.col("_r_parent_id")) & (F.col("_r_elem_ordinal") == F.col("elem_ordinal") + 1),
            "~": (F.col("parent_id") == F.col("_r_parent_id")) & (F.col("_r_elem_ordinal") > F.col("elem_ordinal")),
        }[how]
        return met(left, r, on, "left_semi")


def select(nodes: DataFrame, selector: str, keys: list[str]) -> DataFrame:
    """The rows of the node table that the selector matches; ``keys`` name the document."""
    return Compiler(nodes, keys).any(parse(selector))
