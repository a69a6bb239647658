"""Row functions as column expressions: what needs no tree stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intervals import _SPACE


def looks_like_document(c: Column) -> Column:
    """That a text begins as a whole page does."""
    return c.rlike(f"^(?:{_SPACE})?(?i:<!doctype|<html)")


def _div(c: Column, by: int) -> Column:
    return ((c - F.pmod(c, F.lit(by))) / by).cast("long")  # a whole quotient: exact below 2 ** 53


def byte_size(c: Column) -> Column:
    """``1 byte``, ``7 bytes``, or the largest of KiB, MiB and GiB with at most one rounded decimal."""
    n = c.cast("long")
    shown = F.when(n == 1, "1 byte").otherwise(F.concat(n.cast("string"), F.lit(" bytes")))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB")):
        size = 1024**power
        tenths = _div(n * 10 + size // 2, size)
        decimal = F.when(tenths % 10 > 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise("")
        shown = F.when(n >= size, F.concat(_div(tenths, 10).cast("string"), decimal, F.lit(f" {unit}"))).otherwise(shown)
    return shown


def redacted(c: Column) -> Column:
    """An http URL as it may be shown: its query masked, no fragment; null with credentials or another scheme.

    Scheme and host are in lower case and default ports left out; the path is shown as it is written.
    """
    part = lambda i: F.regexp_extract(c, r"^(?i)(https?)://([^/?#\\]*)([^?#]*)(\?[^#]*)?", i)
    scheme, place, path = F.lower(part(1)), F.lower(part(2)), part(3)
    place = F.regexp_replace(place, F.when(scheme == "http", F.lit(":(?:80)?$")).otherwise(F.lit(":(?:443)?$")), F.lit(""))
    shown = F.concat(scheme, F.lit("://"), place, F.when(path == "", "/").otherwise(path), F.when(part(4) != "", "?[redacted]").otherwise(""))
    return F.when((scheme != "") & (place != "") & ~place.contains("@"), shown)
