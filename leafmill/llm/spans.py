"""Positions of pattern matches as native column expressions.

Spark returns matched strings but not where they are. Splitting a text at the same
pattern gives the gaps between matches, so running sums of gap and match lengths
(in code points, as ``length`` counts) give exact positions without any Python.
Patterns use possessive quantifiers, which Java evaluates in a loop: no recursion
and no backtracking on long runs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.arrays import blocks, bound, running_sums

LOCATED = "array<struct<s:int,e:int,m:string>>"
SPAN = "array<struct<s:int,k:int,e:int>>"


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs of start, end (exclusive) and text; empty where none."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(gaps, found, lambda gap, m: F.struct(F.length(gap).alias("g"), F.coalesce(F.length(m), F.lit(0)).alias("n"), m.alias("m")))

    def placed(x: Column) -> Column:
        starts = running_sums(F.transform(x, lambda y: y["g"] + y["n"]))
        return F.zip_with(x, starts, lambda y, at: F.struct((at + y["g"]).cast("int").alias("s"), (at + y["g"] + y["n"]).cast("int").alias("e"), y["m"].alias("m")))

    none = F.array().cast(LOCATED)
    return F.when(text.rlike(pattern), F.filter(bound(pairs, placed), lambda x: x["m"].isNotNull())).otherwise(none)


#: Spans are found by their place in windows of so many code points.
WINDOW = 256


def _window(at: Column) -> Column:
    return (at / WINDOW).cast("int")


def indexed(spans: Column, body: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """``body(between)``; ``between(a, b)`` gives the spans that start in the windows of a to b, and the one before.

    ``spans`` are sorted by start and do not overlap each other. An array of the first span
    of each window is made once, so a look costs only what it finds: a few spans for each
    window, since every span is some characters long.
    """

    def looked(spans: Column) -> Column:
        before = lambda i: F.when(i > 0, _window(F.get(spans, i - 1)["s"])).otherwise(F.lit(-1))
        firsts = F.flatten(F.transform(spans, lambda x, i: F.array_repeat(i, _window(x["s"]) - before(i))))

        def with_firsts(first: Column) -> Column:
            at = lambda w: F.coalesce(F.get(first, w), F.size(spans))

            def between(a: Column, b: Column) -> Column:
                low = F.greatest(at(_window(F.greatest(a, F.lit(0)))) - 1, F.lit(0))
                return F.slice(spans, low + 1, F.greatest(at(_window(b) + 1) - low, F.lit(0)))

            return body(between)

        return bound(firsts, with_firsts)

    return bound(spans, looked)


def looking(roles: list[Column], body: Callable[[list], Column], held: tuple = ()) -> Column:
    """``body`` with the ``between`` of each of ``roles``."""
    return indexed(roles[0], lambda between: looking(roles[1:], body, (*held, between))) if roles else body(list(held))


def free_of(spans: Column, taken: list[Column]) -> Column:
    """Those of ``spans`` that overlap none of ``taken`` (each sorted, not overlapping itself)."""

    def clear(looks: list) -> Column:
        hit = lambda x, between: F.exists(between(x["s"], x["e"]), lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
        return F.filter(spans, lambda x: ~reduce(or_, [hit(x, between) for between in looks]))

    return looking(taken, clear)


def within(spans: Column, roles: list[Column], reach: int) -> Column:
    """Those of ``spans`` with a span of any of ``roles`` (each sorted, not overlapping itself) that starts at most ``reach`` code points away: an interval join by windows."""

    def close(looks: list) -> Column:
        near = lambda x, between: F.exists(between(x["s"] - reach, x["s"] + reach), lambda y: F.abs(y["s"] - x["s"]) <= reach)
        return F.filter(spans, lambda x: reduce(or_, [near(x, between) for between in looks]))

    return looking(roles, close)


def as_spans(found: Column, kind: int) -> Column:
    """Located matches as (start, kind number, end)."""
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"))).cast(SPAN)


def written(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    one = lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def masked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with every span replaced by ``mark``; spans that overlap are merged first.

    Spans are taken in blocks, and a block reads only its own part of the text.
    """
    ends = lambda block: F.array_max(F.transform(block, lambda x: x["e"]))

    def block(b: Column) -> Column:
        def inside(part: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

            def step(acc: Column, x: Column) -> Column:
                s, e = x["s"] - b["at"], x["e"] - b["at"]
                gap = F.substring(part, acc["at"] + 1, F.greatest(s - acc["at"], F.lit(0)))
                fresh = e > acc["at"]
                grown = F.when(s < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark)))
                return F.struct(F.greatest(acc["at"], e).alias("at"), F.when(fresh, grown).otherwise(acc["out"]).alias("out"))

            return F.aggregate(b["spans"], start, step, lambda acc: acc["out"])

        return bound(F.substring(text, b["at"] + 1, F.greatest(ends(b["spans"]) - b["at"], F.lit(0))), inside)

    def whole(cut: Column) -> Column:
        upto = F.transform(cut, ends)
        begun = F.transform(cut, lambda c, i: F.coalesce(F.array_max(F.slice(upto, 1, i)), F.lit(0)))
        out = F.transform(F.zip_with(cut, begun, lambda c, at: F.struct(c.alias("spans"), at.alias("at"))), block)
        return F.concat(F.array_join(out, ""), F.substring(text, F.array_max(upto) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, bound(F.array_sort(spans), lambda sorted_: bound(blocks(sorted_), whole))).otherwise(text)
