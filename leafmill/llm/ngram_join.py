"""N-gram Jaccard join by vertical partitioning.

Documents are sets of distinct ``WORDS``-word shingles; two link when 100 times their
intersection is at least 80 times their union. The result is exact components:

1. One pass hashes every whole text. Equal sets form a class, named by a key of the set.
   Occurrences of shingles are counted exactly into ``1 << BUCKET_BITS`` buckets by hash.
   Buckets by (count, number) and shingles within them by hash give one global order from
   rare to frequent; the table of bucket ranks has a fixed size and is broadcast.
2. A set of n shingles can only link with sets that share one of its first
   ``n - ceil(0.8 n) + 1`` shingles in that order. These prefixes are grouped by shingle;
   shingles of far too full buckets are salted by class. Groups of one end here.
3. In groups of at most ``SMALL`` classes, those whose sizes fit meet; a pair is a candidate if
   the shingles it met by, and at most all that either has in larger groups, suffice.
4. A larger group has a pivot, the class whose prefix has the most company: usually the text that
   the others are copies of. Only classes whose sizes and prefixes allow a link with some size
   in the group go on; bands of sizes are compared, not classes.
5. The classes that are left are hashed once more and kept as segments: the global order is cut
   into ``FRAGMENTS`` fragments of about equal occurrences. Candidates, and pivots with their
   groups, are compared by vertical partitioning: partial overlaps are counted per fragment
   and summed per pair. What links is contracted into components.
6. Two classes x, y of a larger group that are still apart share at most
   ``min(ix, iy) + min(sx - ix, sy - iy)`` shingles, with i a class's overlap with the pivot and
   s its shingles that any other class at hand has. So each class has a band of sizes
   it can link with; classes outside the pivot's component meet those of their band, and
   pairs that the bound allows are compared like the others. While too many would
   meet, further pivots come first (at most ``ROUNDS`` times).

No pair, candidate or partner is dropped or capped: a pair inside one component may stay
uncompared because it cannot change a component. Hashes have 64 bits.

Null, empty or wordless texts have an empty set and link with nothing. Rows without a
doc_id get a component only through others' ids (null if there are none). Rows that
repeat a doc_id are judged by their own texts. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import COUNT_ROWS, bucketed, count_rows, discard, join_one, release, row_key, saved, summed, without_marked
from .components import components
from .shingles import WORDS, set_key, shingle_sets

PERCENT, BUCKET_BITS, FRAGMENTS = 80, 20, 4
#: Partners of one class in a task; salts of shingles whose bucket is so many times fuller than the mean.
SALT_ROWS, SALTS, SALT_BITS, HOT = 512, 64, 7, 8
#: Bits of the Bloom filter for each class, and at most; beyond, more texts than needed are hashed again.
BLOOM_EACH, BLOOM_MOST = 32, 1 << 27
#: Pivot rounds end when so few meetings of classes are left for each prefix entry, or after so many rounds.
PAIRS_PER_ENTRY, ROUNDS = 8.0, 8
#: Classes of a group that meet each other directly; larger groups have pivots.
SMALL = 16
#: Bands of sizes, as steps of the logarithm.
BANDS = 32
#: What is known of each side of a pair, by the letter of its column.
SIDE = {"c": "cls", "n": "n", "l": "label", "h": "held", "e": "end"}


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _measured(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        names = ["doc_id", "text_key", "n", "cls", "part", "grp", "counts"]
        for batch in batches:
            sizes, keys, held, waiting = [], [], [], 0
            for grams in shingle_sets(batch.column(2).to_pylist(), words):
                sizes.append(len(grams))
                keys.append(set_key(grams))
                held.append(grams)
                waiting += len(grams)
                if waiting > 1 << 18:
                    total += np.bincount((np.concatenate(held) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
                    held, waiting = [], 0
            if held:
                total += np.bincount((np.concatenate(held) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
            n, none = len(sizes), lambda kind: pa.nulls(len(sizes), kind)  # noqa: B023
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.binary())], names)
        rows = count_rows(total)
        n = rows.num_rows
        yield pa.record_batch([*[pa.nulls(n, pa.int64())] * 4, *rows.columns], names)

    return run


class Order:
    """The global order: a rank for every bucket, and the first rank of each fragment but the first."""

    def __init__(self, counts: np.ndarray, fragments: int = FRAGMENTS):
        self.fragments = fragments
        by_rank = np.argsort(counts, kind="stable")
        rank = np.empty(len(counts), np.uint32)
        rank[by_rank] = np.arange(len(counts), dtype=np.uint32)
        upto = np.cumsum(counts[by_rank])
        self.hot = int(np.searchsorted(counts[by_rank], HOT * max(1.0, counts.mean()), "right"))  # first rank of buckets that are far too full
        self.cuts = np.searchsorted(upto, upto[-1] * np.arange(1, fragments) / fragments)
        self.packed = zlib.compress(rank.tobytes(), 1)

    def ranks(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self.packed), np.uint32)


def _band(size: Column) -> Column:
    return F.floor(F.ln(size.cast("double")) * BANDS).cast("int")


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _prefixes(order, words: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, hot, seen = order.value.ranks(), order.value.hot, set()  # classes whose prefix this task has given
        for batch in batches:
            out, salts, keys, marks = [], [], [], []  # salts from 1; 0 for shingles that are not frequent

            def rows() -> pa.RecordBatch:
                count = [len(x) for x in out]  # noqa: B023
                k, m = (np.repeat(np.array(c, np.int64), count) for c in (keys, marks))  # noqa: B023
                return pa.record_batch([_signed(np.concatenate(out)), pa.array(k), pa.array(m | np.concatenate(salts) << BUCKET_BITS)], ["gram", "cls", "mark"])  # noqa: B023

            waiting = 0
            for grams in shingle_sets(batch.column(0).to_pylist(), words):
                if (n := len(grams)) and (key := set_key(grams)) not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key)
                    prefix = n + (-percent * n // 100) + 1
                    ranks = rank[_bucket(grams)]
                    at = np.argsort(ranks, kind="stable")[:prefix]  # grams ascend, so ties keep the order of hashes
                    out.append(grams[at])
                    salts.append(np.where(ranks[at] >= hot, 1 + key % SALTS, 0))
                    keys.append(key)
                    marks.append(n << BUCKET_BITS + SALT_BITS | int(ranks[at[-1]]))  # size, and the bucket where the prefix ends; ties count for both sides
                    waiting += prefix
                    if waiting > 1 << 18:
                        yield rows()
                        out, salts, keys, marks, waiting = [], [], [], [], 0
            if out:
                yield rows()

    return run


def _text_key(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _name(doc_id: str, text_key: str) -> Column:
    """What the Bloom filter knows a row by: its doc_id, or its text where it has none."""
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("t"), F.col(text_key).cast("string")))


def _bloom_places(name: str, bits: int) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(name.encode(), 42)  # as Spark's xxhash64
    return h % bits, (h >> 32) % bits


def _bloom(names: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``name`` as 32-bit words; what comes to the driver has a fixed bound."""
    bits = 1 << 16
    while bits < min(BLOOM_MOST, BLOOM_EACH * names.count()):
        bits *= 2
    h = F.xxhash64("name")
    places = F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)))
    words = names.select(F.explode(places).alias("p")).groupBy((F.col("p") / 32).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 32).cast("int"))).alias("bits"))
    filled = np.zeros(bits // 32, np.uint32)
    for w, v in words.coalesce(4).toLocalIterator():
        filled[w] = v
    return filled


def _segments(order, bloom, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, cuts, filled = order.value.ranks(), order.value.cuts, bloom.value
        bits = 32 * len(filled)
        for batch in batches:
            want = [all(int(filled[p >> 5]) >> (p & 31) & 1 for p in _bloom_places(i, bits)) for i in batch.column(0).to_pylist()]
            keys, frags, parts = [], [], []

            def rows() -> pa.RecordBatch:
                return pa.record_batch([pa.array(keys, pa.int64()), pa.array(frags, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], ["cls", "frag", "grams"])  # noqa: B023

            for grams in shingle_sets(batch.column(1).filter(pa.array(want, pa.bool_())).to_pylist(), words):
                if len(grams):
                    key, frag = set_key(grams), np.searchsorted(cuts, rank[_bucket(grams)], "right")
                    for f in range(order.value.fragments):
                        keys.append(key)
                        frags.append(f)
                        parts.append(grams[frag == f].view(np.int64))
                if len(parts) > 2000:
                    yield rows()
                    keys, frags, parts = [], [], []
            yield rows()

    return run


def _least(rows: DataFrame, by: str, doc_id: str, text_key: str) -> DataFrame:
    """For each ``by`` the row (rep, rep_key) of the smallest doc_id, and of those of the smallest text key; rows without a doc_id come last."""
    least = F.min(F.struct(F.col(doc_id).isNull(), F.col(doc_id).alias("rep"), F.col(text_key).alias("rep_key"))).alias("least")
    return rows.groupBy(by).agg(least).select(by, "least.rep", "least.rep_key")


class Join:
    """State of one join: texts, classes, the global order and what has been compared."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
        self.spark, self.words, self.percent = docs.sparkSession, words, percent
        self.measure()

    @property
    def most(self) -> int:
        """Classes of a group that meet each other directly."""
        return SMALL

    def measure(self) -> None:
        """The first pass over the texts: rows, classes and the global order."""
        first = saved(self.texts.mapInArrow(_measured(self.words), f"doc_id long, text_key long, n long, cls long, {COUNT_ROWS}"), "measured")
        self.rows = first.where("n IS NOT NULL").select("doc_id", "text_key", "n", "cls")
        self.classes = saved(_least(self.rows.where("n > 0"), "cls", "doc_id", "text_key"), "classes")
        counts = summed(first.where("part IS NOT NULL").select("part", "grp", "counts"), 1 << BUCKET_BITS)
        self.order = self.spark.sparkContext.broadcast(Order(counts))

    def entries(self) -> DataFrame:
        """Prefix shingles that more than one class has: gram, cls, n and of the class where its prefix ends, how many such shingles it has (held), how many of them in groups of more than SMALL (large) and how many others they have in all (company)."""
        raw = self.texts.select("text").mapInArrow(_prefixes(self.order, self.words, self.percent), "gram long, cls long, mark long")
        salt = F.shiftright("mark", BUCKET_BITS).bitwiseAND(F.lit((1 << SALT_BITS) - 1))
        each = raw.withColumn("salt", salt).repartition(F.col("gram"), F.col("salt")).groupBy("gram", "salt", "cls").agg(F.max("mark").alias("mark"))  # one exchange for this and the window
        each = saved(each.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("gram", "salt"))).where("k > 1 OR salt > 0"), "prefixes")
        salted = each.where("salt > 0").drop("k")
        sizes = salted.groupBy("gram", "salt").agg(F.count(F.lit(1)).alias("k"))  # at most SALTS rows of each shingle
        sizes = sizes.withColumn("k", F.sum("k").over(Window.partitionBy("gram"))).where("k > 1")
        many = each.where("salt = 0").select("gram", "cls", "mark", "k").unionByName(salted.join(sizes, ["gram", "salt"]).select("gram", "cls", "mark", "k"))
        many = many.withColumns({"n": F.shiftright("mark", BUCKET_BITS + SALT_BITS), "end": F.col("mark").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))}).drop("mark")
        own = Window.partitionBy("cls")
        found = saved(many.withColumns({"held": F.count(F.lit(1)).over(own), "large": F.sum((F.col("k") > SMALL).cast("long")).over(own), "company": F.sum("k").over(own)}), "entries")
        discard(each)
        return found

    def open(self, entries: DataFrame, labels: DataFrame | None) -> DataFrame:
        """The entries of groups that hold several components, with label and p, the pivot of the group."""
        now = entries.withColumn("label", F.col("cls")) if labels is None else entries.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        now = saved(now, "labelled")
        lead = F.max(F.struct("company", *SIDE.values())).alias("p")
        groups = now.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), lead).where("lo <> hi").select("gram", "p")
        found = saved(join_one(now, saved(groups, "groups"), ["gram"]), "open")
        discard(now)
        return found

    def fits(self, m: str = "na", n: str = "nb") -> Column:
        return (F.least(m, n) * 100) >= (F.greatest(m, n) * self.percent)

    def segments(self, classes: DataFrame) -> DataFrame:
        """The sets of ``classes`` in fragments (cls, frag, grams), and of others that the Bloom filter lets through, bucketed by cls so that joins need not move them again."""
        names = saved(classes.join(self.classes, "cls").select(_name("rep", "rep_key").alias("name")), "names")
        bloom = self.spark.sparkContext.broadcast(_bloom(names))
        full = names.count() * BLOOM_EACH > 2 * BLOOM_MOST
        discard(names)
        raw = self.texts.select(_name("doc_id", "text_key").alias("name"), "text").mapInArrow(_segments(self.order, bloom, self.words), "cls long, frag int, grams array<long>")
        if full:  # so that what is stored stays bounded by ``classes``
            raw = raw.join(classes.select("cls"), "cls", "left_semi")
        return bucketed(raw, "cls", ["cls", "frag"], "segments")

    def overlaps(self, pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """The pairs (a, b, na, nb) with their overlap (same): partial overlaps by fragment, summed per pair."""
        salts = pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / SALT_ROWS) + 1).alias("salts"))
        mine = parts.join(salts.withColumnRenamed("a", "cls"), "cls")
        mine = mine.select(F.col("cls").alias("a"), "frag", F.col("grams").alias("ga"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        salted = join_one(pairs, salts, ["a"]).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts"))).drop("salts")
        other = parts.join(salted.withColumnRenamed("b", "cls"), "cls").select("a", F.col("cls").alias("b"), "na", "nb", "salt", "frag", F.col("grams").alias("gb"))
        met = other.join(mine, ["a", "frag", "salt"])
        return saved(met.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("same")).groupBy("a", "b", "na", "nb").agg(F.sum("same").alias("same")), "overlaps")

    def links(self, met: DataFrame) -> DataFrame:
        return met.where((F.col("same") * 100) >= (F.col("na") + F.col("nb") - F.col("same")) * self.percent).select("a", "b")

    def small(self, entries: DataFrame) -> DataFrame:
        """Pairs (a, b, na, nb) of classes that meet in small groups and can share enough prefix shingles to link."""
        x, y = (entries.where(F.col("k") <= SMALL).select("gram", *[F.col(c).alias(x + side) for x, c in (SIDE | {"o": "large"}).items() if x != "l"]) for side in "ab")
        met = x.join(y, "gram").where("ca < cb").where(self.fits()).where(self.first("a", "b") | self.first("b", "a"))
        counted = met.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.count(F.lit(1)).alias("c"), *[F.max(c).alias(c) for c in ("na", "nb", "oa", "ob")])
        enough = F.col("c") + F.least("oa", "ob") >= F.least(self.need("na", "nb"), self.need("nb", "na"))
        return saved(counted.where(enough).select("a", "b", "na", "nb"), "small")

    def stars(self, open_: DataFrame) -> DataFrame:
        """Pairs (a, b, na, nb) of pivots with the other classes of their groups."""
        sides = [F.col(f"p.{c}").alias(x + "a") for x, c in SIDE.items() if x in "cn"] + [F.col(c).alias(x + "b") for x, c in SIDE.items() if x in "cn"]
        met = open_.where("cls <> p.cls AND label <> p.label").select(*sides).where(self.fits())
        return saved(met.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "na", "nb").distinct(), "stars")

    def opened(self, entries: DataFrame, small: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The open groups, and the overlaps of pivots with the classes of their groups and of the pairs of small groups."""
        open_ = self.open(entries, None)
        return open_, self.overlaps(saved(small.union(self.stars(open_)).distinct(), "pairs"), parts)

    def members(self, open_: DataFrame) -> DataFrame:
        """Every class of every pivot's groups, once: p, cls, n, held, end."""
        return open_.select(F.col("p.cls").alias("p"), "cls", "n", "held", "end").distinct()

    def able(self, members: DataFrame) -> DataFrame:
        """The classes (cls) that their sizes and the prefixes' ends allow to link with some class of their pivot's groups; no two classes meet."""
        members = saved(members, "members")
        common = F.ceil(F.col("n") * self.percent / 100) - 1 + F.col("held")
        partners = self.bands(members, common).select("p", "band", "cls")
        own = members.select("p", _band(F.col("n")).alias("band"), "cls")
        cell = lambda df, x: df.groupBy("p", "band").agg(F.min("cls").alias(f"{x}lo"), F.max("cls").alias(f"{x}hi"))
        cells = saved(cell(partners, "x").join(cell(own, "y"), ["p", "band"]).where("least(xlo, ylo) < greatest(xhi, yhi)"), "cells")
        some = lambda df, x: df.join(cells, ["p", "band"]).where(f"{x}lo <> cls OR {x}hi <> cls").select("cls")
        found = saved(some(partners, "y").union(some(own, "x")).distinct(), "able")
        discard(members)
        discard(cells)
        return found

    def bands(self, members: DataFrame, common: Column) -> DataFrame:
        """``members`` in every band of sizes of the sets they can link with, if they have ``common`` shingles in common at most; most is the largest such size."""
        p = self.percent
        each = members.withColumn("most", F.least(F.floor((common * (100 + p) - F.col("n") * p) / p), F.floor(F.col("n") * 100 / p)))
        each = each.withColumn("least", F.ceil(F.col("n") * p / 100)).where("most >= least")
        return each.withColumn("band", F.explode(F.sequence(_band(F.col("least")), _band(F.col("most"))))).drop("least")

    def lone(self, classes: DataFrame, parts: DataFrame) -> DataFrame:
        """cls, lone: how many shingles of each of ``classes`` no other of them has."""
        grams = parts.join(classes, "cls", "left_semi").select("cls", F.explode("grams").alias("gram"))
        once = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.min("cls").alias("cls")).where("c = 1")
        return once.groupBy("cls").agg(F.count(F.lit(1)).alias("lone"))

    def known(self, members: DataFrame, met: DataFrame, parts: DataFrame) -> DataFrame:
        """``members`` with s (shingles that others at hand have too) and i (overlap with the pivot; null where it was not counted)."""
        each = members.join(self.lone(members.select("cls").distinct(), parts), "cls", "left").join(met.select(F.col("a").alias("p"), F.col("b").alias("cls"), "same"), ["p", "cls"], "left")
        own = F.when(F.col("p") == F.col("cls"), F.col("n")).otherwise(F.col("same"))
        return saved(each.select("p", "cls", "n", "held", "end", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("s"), own.alias("i")), "known")

    def need(self, n: str, other: str) -> Column:
        """How many shingles of its prefix a set of ``n`` must share with one of ``other`` to link, if its prefix ends first."""
        n, other, p = F.col(n), F.col(other), self.percent
        return n - F.ceil(n * p / 100) + 1 - (n - F.ceil((n + other) * p / (100 + p)))

    def first(self, m: str, o: str) -> Column:
        """That the prefix of side ``m`` ends first and has enough shingles that anyone shares."""
        return (F.col(f"e{m}") <= F.col(f"e{o}")) & (F.col(f"h{m}") >= self.need(f"n{m}", f"n{o}"))

    def sides(self, known: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Classes outside their pivot's component in all bands of sizes they can link with, and all classes in the band of their size."""
        each = known.withColumns({"label": F.col("cls"), "lead": F.col("p")})
        if labels is not None:
            of = lambda node, name: labels.select(F.col("node").alias(node), F.col("label").alias(f"_{name}"))
            each = known.join(of("cls", "label"), "cls", "left").join(of("p", "lead"), "p", "left").withColumns({"label": F.coalesce("_label", "cls"), "lead": F.coalesce("_lead", "p")})
        named = lambda df, side: df.select("p", "band", *[F.col(c).alias(x + side) for x, c in (SIDE | {"g": "lead", "s": "s", "i": "i"}).items()])
        return named(self.bands(each.where("label <> lead"), F.col("s")), "a"), named(each.withColumn("band", _band(F.col("n"))), "b")

    def meetings(self, outside: DataFrame, every: DataFrame) -> int:
        """How many classes meet in bands, counted without meeting them."""
        many = lambda df, name: df.groupBy("p", "band").agg(F.count(F.lit(1)).alias(name))
        return int(many(outside, "x").join(many(every, "y"), ["p", "band"]).agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0))).first()[0])

    def apart(self, outside: DataFrame, every: DataFrame) -> DataFrame:
        """Pairs (a, b, na, nb) of classes of different components that the bounds allow to link."""
        once = (F.col("lb") == F.col("gb")) | (F.col("ca") < F.col("cb"))  # pairs outside meet from both sides
        common = F.least("ia", "ib") + F.least(F.col("sa") - F.col("ia"), F.col("sb") - F.col("ib"))
        common = F.when(F.col("ia").isNull() | F.col("ib").isNull(), F.least("sa", "sb")).otherwise(common)
        able = common * (100 + self.percent) >= (F.col("na") + F.col("nb")) * self.percent
        met = outside.join(every, ["p", "band"]).where("la <> lb").where(once & self.fits() & able).where(self.first("a", "b") | self.first("b", "a"))
        return saved(met.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "na", "nb").distinct(), "apart")

    def labels(self) -> DataFrame | None:
        """cls (node) and label of all linked classes; None without links."""
        every = self.entries()
        entries, small = saved(every.where(F.col("k") > self.most).drop("k", "large"), "entries"), self.small(every)
        budget = PAIRS_PER_ENTRY * every.count()
        discard(every)
        able = self.able(self.members(self.open(entries, None)))
        parts = self.segments(able.union(small.select("a")).union(small.select("b")).distinct())
        entries = saved(entries.join(able, "cls", "left_semi"), "entries")
        open_, met = self.opened(entries, small, parts)
        known, found, labels = self.known(self.members(open_), met, parts), self.links(met), None
        for number in range(ROUNDS + 1):
            labels = components(found) if found.limit(1).count() else None
            outside, every = self.sides(known, labels)
            meetings = self.meetings(outside, every)
            if not meetings:
                break
            if number == ROUNDS or meetings <= budget:
                more = self.links(self.overlaps(self.apart(outside, every), parts))
                labels = components(found.union(more)) if more.limit(1).count() else labels
                break
            led = open_.where("cls = p.cls").select("gram", "cls")  # these pivots have met all of their groups
            entries = saved(entries.join(led, ["gram", "cls"], "left_anti"), "entries")
            discard(open_)
            open_ = self.open(entries, labels)
            found = found.union(self.links(self.overlaps(self.stars(open_), parts)))
            release(self.spark)
        for table in (open_, known, entries, parts):
            discard(table)
        release(self.spark)
        return labels


def _rows(run: Join) -> DataFrame:
    """doc_id, text_key, n of every row, and rep, rep_key: the row that names its component (null for empty sets)."""
    labels = run.labels()
    classes = run.classes
    if labels is not None:
        named = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        named = saved(named, "named")
        classes = join_one(named.select("cls", "label"), saved(_least(named, "label", "rep", "rep_key"), "reps"), ["label"]).select("cls", "rep", "rep_key")
    some, none = run.rows.where("n > 0"), run.rows.where("n IS NULL OR n = 0")
    found = join_one(some, classes, ["cls"]).select("doc_id", "text_key", "n", "rep", "rep_key")  # many copies of one text are a hot key
    return found.unionByName(none.select("doc_id", "text_key", "n", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("long").alias("rep_key")))


def told(run: Join) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    component = F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id"))
    return _rows(run).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return told(Join(docs, words, percent))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with exactly one row of each component; columns as they are.

    The row with the smallest doc_id stays, of those the one with the smallest hash of its
    text, and any one of rows that repeat both. Rows without a doc_id come last. Rows are
    told apart by doc_id and text, so other texts under a doc_id that goes are left alone.
    Empty sets link with nothing: all their rows stay.
    """
    return one_of_each(docs, Join(docs, words, percent))


def one_of_each(docs: DataFrame, run: Join) -> DataFrame:
    stays = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_key") == F.col("rep_key"))
    each = _rows(run).where("n > 0").groupBy("doc_id", "text_key").agg(F.min(stays).alias("stays"), F.count(F.lit(1)).alias("n"))
    marked = saved(each.where("NOT stays OR n > 1").select(row_key(F.col("doc_id"), F.col("text_key")).alias("key"), "stays"), "marked")
    return without_marked(docs, row_key(F.col("doc_id").cast("long"), _text_key(F.col("text"))), marked)


def oracle(words: int = WORDS, percent: int = PERCENT) -> str:
    """The same components in DuckDB's SQL: all pairs that share a shingle, counted, and all that links reach."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    gram AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {words} - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - {words} + 2, 2))) AS i FROM split WHERE len(w) > 0)),
    many AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM gram x JOIN gram y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    link AS MATERIALIZED (SELECT a, b FROM common JOIN many x ON x.doc_id = a JOIN many y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
    ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN ways l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN many USING (doc_id)
"""
