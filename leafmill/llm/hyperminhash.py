"""Near copies by HyperMinHash: compressed registers, banded, with exact confirmation.

1. One pass hashes every whole text into its set of distinct ``WORDS``-word shingles; equal sets form a class.
   For each of ``BANDS`` hash functions the set is dealt into ``BUCKETS`` buckets by the leading bits of the
   hash, and of the least hash of each bucket a register of 16 bits is kept: how many
   zeros it begins with (6 bits), and the ``MANTISSA`` bits after the first one. Equal least hashes have equal
   registers, so compression can only add candidates.
2. The registers of one function are a band. Classes whose band is equal are a group. Two sets with a Jaccard
   similarity of 0.85 agree in one band with probability 0.85 ** 4 at least, and miss each other in all 32 bands with
   (1 - 0.522) ** 32, less than 1e-10; for nearer sets that is smaller still. Classes too small to link with
   any other set are left out.
3. Classes of small groups meet; the estimate drops pairs that are far off. It is the share of equal registers,
   less the expected share of chance collisions (which the lengths of the registers and the sizes of
   the sets give). The margin is ``SIGMAS`` standard deviations, so that a pair that links stays with
   about the same certainty as in the bands.
4. Larger groups have pivots, and what is left of them meets by bounds, as in :mod:`ngram_join`; every link is confirmed by
   counting what the full sets have in common, once a pair. Components are those of the confirmed links.

No pair, candidate or partner is capped. Null, empty or wordless texts have an empty set and link with nothing;
each is its own component. Rows without a doc_id get a component only through others' ids (null if there are none)
and are kept only then. Rows that repeat a doc_id are judged by their own texts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ngram_join
from .common import discard, join_one, saved
from .components import components
from .ngram_join import BUCKET_BITS, Join, Order
from .shingles import mixed, set_key, shingle_sets

WORDS, PERCENT = 3, 85
BANDS, BUCKETS, MANTISSA = 32, 4, 10
#: Classes of a group that meet each other directly.
SMALL = 4
SIGMAS = 6.5
EMPTY = 0xFFFF
#: Share of chance collisions of registers without a mantissa, for sets of one size (a constant of the sketch's analysis).
COLLISIONS = 0.169919487159739
_SEEDS = np.random.Generator(np.random.PCG64(31)).integers(1, 1 << 63, BANDS, np.uint64)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _compressed(least: np.ndarray) -> np.ndarray:
    """Registers of least hashes (62 bits, leading): zeros, then the bits after the first one; EMPTY for no hash."""
    fraction, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))
    zeros = np.where(fraction > 0, 53 - exponent, 53)
    bits = np.where(fraction > 0, (fraction * (2 << MANTISSA)).astype(np.int64) & ((1 << MANTISSA) - 1), 0)
    return np.where(least == _MOST, EMPTY, zeros << MANTISSA | bits).astype("<u2")


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The registers of non-empty sets of hashes: one row a set, band after band."""
    grams = np.concatenate(sets)
    at = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), BANDS, BUCKETS), "<u2")
    for band, seed in enumerate(_SEEDS):
        h = mixed(grams ^ seed)
        bucket, rest = h >> np.uint64(62), h << np.uint64(2)
        for b in range(BUCKETS):
            out[:, band, b] = _compressed(np.minimum.reduceat(np.where(bucket == b, rest, _MOST), at))
    return out.reshape(len(sets), BANDS * BUCKETS)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected estimates of the similarity of rows of registers, and how many registers told."""
    told = ((a != EMPTY) | (b != EMPTY)).sum(1)
    equal = ((a == b) & (a != EMPTY)).sum(1)
    ratio = na / nb
    chance = COLLISIONS * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)
    return (equal / np.maximum(told, 1) - chance) / (1 - chance), told


def _near(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = percent / 100
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, -1) for i in (4, 5))
                na, nb = (batch.column(i).to_numpy() for i in (2, 3))
                share, told = estimate(a, b, na, nb)
                keep = share >= t - SIGMAS * np.sqrt(t * (1 - t) / np.maximum(told, 1))
                yield batch.select([0, 1, 2, 3]).filter(pa.array(keep))

    return run


def _sketched(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sketches, held, waiting = [], [], [], [], 0
            for grams in shingle_sets(batch.column(2).to_pylist(), words):
                sizes.append(len(grams))
                keys.append(set_key(grams))
                held.append(grams)
                waiting += len(grams)
                if waiting > 1 << 18:
                    sketches += _sketch_values(held)
                    held, waiting = [], 0
            sketches += _sketch_values(held)
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.record_batch(columns, ["doc_id", "text_key", "n", "cls", "sketch"])

    return run


def _sketch_values(sets: list[np.ndarray]) -> list[bytes | None]:
    some = [s for s in sets if len(s)]
    rows = iter(registers(some)) if some else iter(())
    return [next(rows).tobytes() if len(s) else None for s in sets]


class Sketched(Join):
    """A join whose candidates come from bands of registers instead of prefixes."""

    most = SMALL

    def measure(self) -> None:
        first = saved(self.texts.mapInArrow(_sketched(self.words), "doc_id long, text_key long, n long, cls long, sketch binary"), "measured")
        self.rows = first.select("doc_id", "text_key", "n", "cls")
        least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("rep"), F.col("text_key").alias("rep_key"))).alias("least")
        each = first.where("n > 0").groupBy("cls").agg(least, F.max("n").alias("n"), F.min("sketch").alias("sketch"))
        self.sketches = saved(each.select("cls", "least.rep", "least.rep_key", "n", "sketch"), "classes")
        self.classes = self.sketches.select("cls", "rep", "rep_key")
        self.order = self.spark.sparkContext.broadcast(Order(np.ones(1 << BUCKET_BITS, np.int64), 1))  # sets are compared whole

    def entries(self) -> DataFrame:
        """Bands that more than one class has: gram (the band's number and registers), cls, k (classes of the group), n and company."""
        able = (F.floor(F.col("n") * 100 / self.percent) > F.col("n")) | (F.ceil(F.col("n") * self.percent / 100) < F.col("n"))
        band = F.substring("sketch", F.col("band") * (2 * BUCKETS) + 1, F.lit(2 * BUCKETS))
        each = self.sketches.where(able).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))))
        each = saved(each.select(F.xxhash64("band", band).alias("gram"), "cls", "n"), "bands")
        sizes = each.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        company = F.sum("k").over(Window.partitionBy("cls"))  # at most BANDS rows of each class
        known = join_one(each, saved(sizes, "sizes"), ["gram"]).withColumns({"held": F.col("n"), "end": F.lit(0).cast("long"), "company": company})
        return saved(known, "entries")

    def first(self, m: str, o: str) -> Column:
        return F.lit(True)  # bands have no prefixes whose ends could tell anything

    def able(self, members: DataFrame) -> DataFrame:
        """All classes of large groups: sets with an equal band are seldom of sizes that rule each other out."""
        return saved(members.select("cls").distinct(), "able")

    def opened(self, entries: DataFrame, small: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """As for prefixes, in two steps: a class has up to BANDS groups, so it meets the pivot with the most company first, and others only in groups that are still open then."""
        every = self.open(entries, None).where("cls <> p.cls")
        pair = [F.col("p.cls").alias("a"), F.col("cls").alias("b"), F.col("p.n").alias("na"), F.col("n").alias("nb")]
        first = every.groupBy("cls", "n").agg(F.max("p").alias("p")).select(*pair).where(self.fits())
        met = self.overlaps(saved(small.union(first).distinct(), "pairs"), parts)
        found = self.links(met)
        open_ = self.open(entries, components(found) if found.limit(1).count() else None)
        rest = open_.where("cls <> p.cls").select(*pair).where(self.fits()).distinct().join(met.select("a", "b"), ["a", "b"], "left_anti")
        return open_, met.union(self.overlaps(saved(rest, "pairs"), parts))

    def small(self, entries: DataFrame) -> DataFrame:
        """Pairs (a, b, na, nb) of classes that meet in small groups and whose estimate does not rule a link out."""
        x, y = (entries.where(F.col("k") <= self.most).select("gram", F.col("cls").alias(f"c{side}"), F.col("n").alias(f"n{side}")) for side in "ab")
        met = x.join(y, "gram").where("ca < cb").where(self.fits())
        return self.likely(saved(met.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "na", "nb").distinct(), "met"))

    def apart(self, outside: DataFrame, every: DataFrame) -> DataFrame:
        return self.likely(super().apart(outside, every))

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a saved table, given up here) whose estimate does not rule a link out."""
        of = lambda side: self.sketches.select(F.col("cls").alias(side), F.col("sketch").alias(f"s{side}"))
        both = join_one(pairs, of("a"), ["a"]).join(of("b"), "b").select("a", "b", "na", "nb", "sa", "sb")  # only a may be a pivot
        found = saved(both.mapInArrow(_near(self.percent), "a long, b long, na long, nb long"), "likely")
        discard(pairs)
        return found


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    found = ngram_join.told(Sketched(docs, words, percent))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with exactly one row of each component, as :func:`ngram_join.keep_one` says."""
    return ngram_join.one_of_each(docs, Sketched(docs, words, percent))
