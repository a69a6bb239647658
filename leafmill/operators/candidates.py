"""Which part of a document to extract or to read: scores, nesting and promotion as relational plans.

:func:`measured` gives one row per candidate container with its interval; all judgements after that are columns,
joins and windows. Candidates that contain each other meet by :func:`nested`: time in a document is cut into blocks,
an outer candidate stands in each block that it covers, an inner one in the block where it begins, so that
a document with very many candidates is spread over many keys and each pair meets once. Documents are bounded by
the size limit; what is left after ranking is at most ``limit`` rows a document and purpose.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import urls
from ..functions.dom import Document, roomy
from ..functions.extract import MAX_BYTES, parsed
from ..functions.inspect import EXTRACTION, READING, RULES, SAMPLES, Inspector, Weights
from ..functions.shipping import ship
from ..sources.tables import kept, met
from .corpus import _batches, _keys, spread

#: Times (two a node) in a block.
BLOCK = 1024
_TEXTS, _NUMBERS, _FLAGS = ("selector", "path", "tag"), ("node_id", "pre", "post", "chars", "headings", "links", "blocks", "level", "primaries", "depth", "utility", "positive", "negative"), ("main_role", "body_prop")
MEASURED = T.StructType([*[T.StructField(n, T.StringType()) for n in _TEXTS], *[T.StructField(n, T.LongType()) for n in _NUMBERS], *[T.StructField(n, T.BooleanType()) for n in _FLAGS]])
_DERIVED = ("shallow", "stable", "steps")
_ALL = (*MEASURED.names, *_DERIVED)


def times(document: Document) -> dict[str, tuple[int, int, int]]:
    """Of every element, by its path: number, pre and post, as in the node table."""
    clock, entered, out = 0, {}, {}
    todo = [(document.root, "", False)]
    while todo:
        n, path, leaving = todo.pop()
        if leaving:
            if n.kind == "element":
                out[path] = (n.number, entered[n.number], clock)
        else:
            entered[n.number] = clock
            todo.append((n, path, True))
            of_tag: dict[str, int] = {}
            below = []
            for c in n.children:
                at = path
                if c.kind == "element":
                    of_tag[c.tag] = of_tag.get(c.tag, 0) + 1
                    at = (f"{path} > " if n.kind == "element" else "") + f"{c.tag}:nth-of-type({of_tag[c.tag]})"
                below.append((c, at, False))
            todo.extend(reversed(below))
        clock += 1
    return out


def measured(docs: DataFrame, html: str = "html", base_url: str | None = None, partitions: int | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The other columns of ``docs`` and one row per candidate container; none for documents that :func:`corpus.oversized` tells."""
    docs = docs.where(F.coalesce(F.octet_length(F.col(html)), F.lit(0)) <= max_bytes)
    ship(docs.sparkSession)
    keys = _keys(docs, html, base_url)
    names = [f.name for f in keys]

    def run(row: dict) -> Iterator[dict]:
        document = parsed(row[html] or "")
        roomy(document.root)
        shown = urls.redacted(row[base_url]) if base_url and row[base_url] else None
        own, when = {k: row[k] for k in names}, times(document)
        for c in Inspector(document, urls.effective_base(document, shown)).measured():
            node, pre, post = when.get(c.path, (None, None, None))
            yield own | {n: getattr(c, n) for n in MEASURED.names if hasattr(c, n)} | {"node_id": node, "pre": pre, "post": post}

    schema = T.StructType([*keys, *MEASURED.fields])
    return judged(spread(docs, partitions).mapInArrow(_batches(run, schema), schema))


def judged(found: DataFrame) -> DataFrame:
    """Measured candidates with how far their selector can be trusted (stable), whether their title is near the top (shallow), and the steps of their path."""
    s = F.col("selector")
    stable = (
        F.when(s.contains(":nth-of-type("), 0).when(s.startswith("#"), 5).when(s.contains("[itemprop=") | s.contains("[role=") | s.startswith("["), 4)
        .when(s.contains(".") & s.rlike(r"^\p{L}"), 3).when(s.startswith("."), 2).otherwise(1)
    )
    shallow = F.col("depth").isNotNull() & ((F.col("level") == 1) & (F.col("depth") <= 5) | (F.col("level") == 2) & (F.col("depth") <= 2))
    steps = F.size(F.split("path", " > ")) - 1
    return found.withColumns({"shallow": F.coalesce(shallow, F.lit(False)), "stable": stable.cast("long"), "steps": steps.cast("long")})


@dataclass(frozen=True)
class Side:
    """A candidate of a pair: its values are columns, its judgements conditions."""

    prefix: str

    def __getattr__(self, name: str) -> Column:
        return F.col(f"{self.prefix}{name}")

    def holds(self, other: Side) -> Column:
        return (self.pre < other.pre) & (other.post < self.post)

    def loses_title(self, inner: Side) -> Column:
        return self.shallow & ~(inner.shallow & ((inner.level == 1) | (self.level != 1)))

    def is_shell_of(self, inner: Side) -> Column:
        more = (self.headings >= inner.headings + 24) & (self.headings >= inner.headings * 2)
        return (inner.headings >= 2) & (inner.chars * 100 >= self.chars * 94) & more & (self.links <= inner.links + 12) & (inner.stable >= self.stable)


@dataclass(frozen=True)
class ColumnGap:
    """What an outer candidate has beyond an inner one, for the rules."""

    outer: Side
    inner: Side

    def __getattr__(self, name: str) -> Column:
        return getattr(self.outer, name) - getattr(self.inner, name)

    def share(self, percent: int) -> Column:
        return self.inner.chars * 100 >= self.outer.chars * percent

    @property
    def loses(self) -> Column:
        return self.outer.loses_title(self.inner)


def rated(w: Weights) -> Column:
    """The score of a candidate for one purpose."""
    c = Side("")
    big = c.tag.isin("article", "main")
    of = lambda values, key: reduce(lambda e, kv: e.when(key == kv[0], kv[1]), values.items(), F.when(F.lit(False), 0)).otherwise(0)
    total = of(w.tags, c.tag) + c.main_role.cast("int") * w.main_role + c.body_prop.cast("int") * w.body_prop + F.floor(F.least(c.chars, F.lit(8000)) / w.chars) + F.least(c.headings, F.lit(8)) * w.heading
    total += F.when(c.shallow, of(w.primary, c.level) + F.least(c.primaries, F.lit(2)) * w.primary_each).otherwise(0)
    total += F.least(c.blocks, F.lit(16)) * 7 + F.least(c.positive, F.lit(4)) * w.positive - F.least(c.negative, F.lit(4)) * w.negative
    total -= F.least(c.utility, F.lit(12)) * F.when(big & c.shallow, w.utility[0]).otherwise(w.utility[1])
    total -= F.when(c.selector == c.path, 220).otherwise(0) + w.constant
    total -= F.when((c.blocks == 0) & (c.chars < 500), w.no_body[0]).when((c.blocks <= 1) & (c.chars < w.no_body[2]), w.no_body[1]).otherwise(0)
    total -= F.when(~big & c.shallow & (c.blocks == 0) & (c.chars < w.title_only[1]), w.title_only[0]).otherwise(0)
    crowd = F.when((c.chars < 240) & (c.links > 8), w.crowded[0])
    for (penalty, chars), ratio in zip(w.crowded[1:], (6, 4, 3), strict=True):
        crowd = crowd.when((c.links > c.blocks * ratio) & (c.chars < chars), penalty)
    return (total - crowd.otherwise(0)).cast("long")


def nested(found: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Every pair of candidates of which the outer (``o_``) contains the inner (``i_``), once."""
    named = lambda prefix: [F.col(c).alias(f"{prefix}{c}") for c in _ALL]
    at = lambda c: F.floor(F.col(c) / block)
    outer = found.select(*keys, *named("o_"), F.explode(F.sequence(at("pre"), at("post"))).alias("_block"))
    inner = found.select(*keys, *named("i_"), at("pre").alias("_block"))
    return met(outer, inner, [*keys, "_block"]).where(Side("o_").holds(Side("i_"))).drop("_block")


def nested_bias(found: DataFrame, keys: Sequence[str], reading: bool, block: int = BLOCK) -> DataFrame:
    """keys, node_id and shift: by how much the score of a candidate changes because of those it contains or lies in."""
    gap, zero = ColumnGap(Side("o_"), Side("i_")), F.lit(0)
    shifts = {"i_": zero, "o_": zero}
    for rule in reversed(RULES):  # from the last to the first, so that a rule that ends stands around those after it
        if amounts := rule.reading if reading else rule.extraction:
            for side, amount in zip(("i_", "o_"), amounts, strict=True):
                rest, holds = shifts[side], F.when(rule.test(gap), amount)
                shifts[side] = holds.otherwise(rest) if rule.ends else holds.otherwise(zero) + rest
    both = F.array(*[F.struct(F.col(f"{side}node_id").alias("node_id"), shift.cast("long").alias("shift")) for side, shift in shifts.items()])
    return nested(found, keys, block).select(*keys, F.inline(both)).groupBy(*keys, "node_id").agg(F.sum("shift").alias("shift"))


def ranked(found: DataFrame, keys: Sequence[str], reading: bool, limit: int = SAMPLES, block: int = BLOCK) -> DataFrame:
    """Candidates of positive score with their final score and rank, the best ``limit`` of each document."""
    score = rated(READING) if reading else rated(EXTRACTION) + F.floor(F.greatest(rated(READING), F.lit(0).cast("long")) / 3)
    live = found.withColumn("score", score).where("score > 0")
    moved = met(live, nested_bias(live, keys, reading, block), [*keys, "node_id"], "left").withColumn("score", F.col("score") + F.coalesce("shift", F.lit(0).cast("long"))).drop("shift")
    order = ["-score", "-chars", "-headings", "-stable", "selector"] if reading else ["-score", "links", "-stable", "-steps", "-chars", "selector"]
    by = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in (*order, "node_id")]
    return moved.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("long")).where(F.col("rank") <= limit)


def promoted(extraction: DataFrame, reading: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Extraction candidates after the reading candidates had their say: three passes, each the best of a pool by an ordered key.

    Every document has one row of state, its leader so far and the leading reading candidate; a pass joins the few
    reading candidates with it and takes ``max_by`` or ``min_by``. Documents without extraction candidates take those for reading.
    """
    whole = [*_ALL, "score", "rank"]
    one = lambda df, name: df.where("rank = 1").select(*keys, F.struct(*whole).alias(name))
    state = met(one(extraction, "now"), one(reading, "top"), keys, "left")
    c, now, top = Side("c."), Side("now."), Side("top.")
    same = now.node_id == top.node_id
    grade = F.when(c.tag == "div", 1).when(c.tag == "section", 2).when(c.tag == "main", 3).when(c.tag == "article", 4).otherwise(0).cast("long")

    def best(pool: Column, key: Column, highest: bool) -> DataFrame:
        pairs = met(reading.select(*keys, F.struct(*whole).alias("c")), state, keys).where(pool)
        return pairs.groupBy(*keys).agg((F.max_by if highest else F.min_by)("c", key).alias("best"))

    def lead(found: DataFrame, number: int) -> DataFrame:
        led = met(state, found, keys, "left").withColumns({f"lead{number}": F.col("best"), "now": F.coalesce("best", "now")})
        return led.drop("best")

    inside_top = same & (c.rank > 1) & top.holds(c) & (c.chars * 100 >= top.chars * 92) & ((c.headings + 2 >= top.headings) & (c.links <= top.links) | top.is_shell_of(c))
    inside_now = ~same & now.holds(c) & (c.chars * 100 >= now.chars * 90) & ((now.links >= c.links + 20) | now.is_shell_of(c)) & (c.stable >= 2)
    first, second = F.when(same, grade).otherwise(c.stable), F.when(same, c.stable).otherwise(grade)
    state = lead(best(inside_top | inside_now, F.struct(first, second, -c.chars, -c.links, -c.steps, c.selector, c.rank), True), 1)  # of equals the last
    back = top.holds(now) & top.loses_title(now) & (now.chars * 100 >= top.chars * 85) & (top.headings + 2 >= now.headings) & (top.links <= now.links + 60)
    state = state.withColumn("lead2", F.when(back, F.col("top"))).withColumn("now", F.coalesce("lead2", "now"))
    leaner = now.holds(c) & (c.chars * 100 >= now.chars * 90) & (c.headings + 2 >= now.headings) & (now.links >= c.links + 20) & ~now.loses_title(c)
    state = lead(best(leaner, F.struct(c.links, -c.stable, -c.chars, c.steps, c.selector, c.rank), False), 3)
    leads = state.select(*keys, F.explode(F.filter(F.array(*[F.struct(F.lit(3 - n).cast("long").alias("place"), F.col(f"lead{n}").alias("c")) for n in (1, 2, 3)]), lambda x: x["c"].isNotNull())).alias("l"))
    rows = leads.select(*keys, "l.place", "l.c.*").unionByName(extraction.select(*keys, (F.col("rank") + 3).alias("place"), *whole))
    last = rows.withColumn("_least", F.min("place").over(Window.partitionBy(*keys, "node_id"))).where("place = _least").drop("_least")
    instead = met(reading, extraction.select(*keys).distinct(), keys, "left_anti").withColumn("place", F.col("rank")).select(*keys, "place", *whole)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("place")).cast("long")
    return last.unionByName(instead).withColumn("rank", place).drop("place")


def recommended(found: DataFrame, keys: Sequence[str], limit: int = SAMPLES, block: int = BLOCK) -> DataFrame:
    """Ranked candidates for both purposes: keys, purpose, rank, selector, path, tag, chars, headings, links, score.

    ``found`` is read several times: a kept table. The ranked candidates, ``limit`` a document, are kept in turn for the promotion's passes.
    """
    reading, extraction = (kept(ranked(found, keys, purpose, limit, block), "ranked") for purpose in (True, False))
    out = lambda df, purpose: df.select(*keys, F.lit(purpose).alias("purpose"), "rank", *_TEXTS, "chars", "headings", "links", "score")
    return out(reading, "reading").unionByName(out(promoted(extraction, reading, keys), "extraction"))
