"""Array algorithms as native column expressions, without work that grows with the square of an array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(items: Column) -> Column:
    """``items`` (not empty) cut into arrays of about the square root of its size."""
    width = F.ceil(F.sqrt(F.size(items))).cast("int")
    last = F.floor((F.size(items) - 1) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * width + 1, width))


def running_sums(values: Column) -> Column:
    """For each of ``values`` the sum of those before it (long).

    A fold that grows an array copies it at every step; folds over blocks and then over the
    blocks' sums copy ``n`` times the square root of ``n`` elements instead of ``n`` squared.
    """
    none = F.array().cast("array<bigint>")

    def sums(items: Column, of: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
        return F.aggregate(items, start, lambda acc, x: F.struct((acc["at"] + of(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def whole(v: Column) -> Column:
        def joined(parts: Column) -> Column:
            moved = F.zip_with(parts, sums(parts, lambda x: x["at"])["out"], lambda p, o: F.transform(p["out"], lambda y: y + o))
            return F.flatten(moved)

        return F.when(F.size(v) > 0, bound(F.transform(blocks(v), lambda c: sums(c, lambda x: x)), joined)).otherwise(none)

    return bound(F.transform(values, lambda x: x.cast("long")), whole)
