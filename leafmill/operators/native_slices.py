"""Literal and simple regex slices with built-in functions alone.

Splitting the source at the same pattern that yields the slices gives the gaps between
them, so running sums of byte lengths are exact ranges. Everything stays in the row until the
slices are exploded; Python is never started.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.arrays import bound, running_sums

JAVA_SPECIAL = re.compile(r"([\\.\[\]{}()*+?^$|])")


def quoted(text: str) -> str:
    return JAVA_SPECIAL.sub(r"\\\1", text)


def slices(docs: DataFrame, start: str, end: str, source: str = "html", regex: bool = False, flags: str = "") -> DataFrame:
    """One row per document: the other columns, ``slices`` (array of structs with byte ranges), and ``dangling``, the byte offset of a start without an end.

    ``regex`` patterns may not capture groups; ``flags`` are Java's inline letters.
    """
    a, b = (start, end) if regex else (quoted(start), quoted(end))
    mode = f"(?{flags})" if flags else ""
    whole = f"{mode}(?:{a})(?s:.*?)(?:{b})"
    text = F.coalesce(F.col(source), F.lit(""))
    keys = [F.col(c) for c in docs.columns if c != source]
    cut = docs.select(*keys, F.split(text, whole, -1).alias("_gaps"), F.regexp_extract_all(text, F.lit(f"{mode}({a})((?s:.*?))({b})"), F.lit(1)).alias("_a"),
                      F.regexp_extract_all(text, F.lit(f"{mode}({a})((?s:.*?))({b})"), F.lit(2)).alias("_v"), F.regexp_extract_all(text, F.lit(f"{mode}({a})((?s:.*?))({b})"), F.lit(3)).alias("_b"))
    size = lambda c: F.octet_length(c).cast("long")
    empty_type = "array<struct<index:bigint,outer_start:bigint,inner_start:bigint,inner_end:bigint,outer_end:bigint,value:string>>"
    empty = F.array().cast(empty_type)
    parts = F.arrays_zip(F.slice("_gaps", 1, F.size("_v")).alias("gap"), F.col("_a").alias("a"), F.col("_v").alias("v"), F.col("_b").alias("b"))

    def ranges(x, at, index):
        o = at + size(x["gap"])
        i = o + size(x["a"])
        j = i + size(x["v"])
        return F.struct((index + 1).cast("long").alias("index"), o.alias("outer_start"), i.alias("inner_start"), j.alias("inner_end"), (j + size(x["b"])).alias("outer_end"), x["v"].alias("value"))

    def placed(found):
        starts = running_sums(F.transform(found, lambda x: size(x["gap"]) + size(x["a"]) + size(x["v"]) + size(x["b"])))
        return F.transform(F.zip_with(found, starts, lambda x, at: F.struct(x.alias("x"), at.alias("at"))), lambda y, index: ranges(y["x"], y["at"], index))

    found = F.coalesce(bound(parts, placed), empty).cast(empty_type)
    rest = F.element_at("_gaps", -1)
    opened = F.regexp_instr(rest, F.lit(f"{mode}{a}"))
    names = [c for c in docs.columns if c != source]
    out = cut.select(*names, found.alias("_f"), F.when(opened > 0, size(F.substring(rest, F.lit(1), opened - 1))).alias("_d"))
    return out.select(*names, F.col("_f").alias("slices"), (F.coalesce(F.try_element_at("_f", F.lit(-1))["outer_end"], F.lit(0)) + F.col("_d")).alias("dangling"))


def slice_rows(docs: DataFrame, start: str, end: str, source: str = "html", regex: bool = False, flags: str = "") -> DataFrame:
    """One row per slice of the documents whose starts all have an end."""
    found = slices(docs, start, end, source, regex, flags).where("dangling IS NULL")
    return found.select(*[c for c in found.columns if c not in ("slices", "dangling")], F.inline("slices"))


def slice_diagnostics(docs: DataFrame, start: str, end: str, source: str = "html", regex: bool = False, flags: str = "") -> DataFrame:
    """code and message for documents without a slice, or with a start that has no end."""
    found = slices(docs, start, end, source, regex, flags)
    message = F.when(F.col("dangling").isNotNull(), F.concat(F.lit("End pattern was not found after offset "), F.col("dangling").cast("string"), F.lit(f": {end}")))
    message = message.when(F.size("slices") == 0, F.lit(f"Start pattern was not found: {start}"))
    keys = [c for c in found.columns if c not in ("slices", "dangling")]
    return found.select(*keys, F.lit("NO_MATCH").alias("code"), message.alias("message")).where("message IS NOT NULL")
