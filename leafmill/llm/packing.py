"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens (only longer documents are cut);
a piece of full capacity is a sequence of its own. All other pieces get a number and
are dealt by it to demes of about ``deme`` pieces. ``ISLANDS`` islands evolve each deme's pieces
apart, each a small population of packings: they start from best-fit decreasing over
differently perturbed orders; a crossover injects the well-filled bins of one parent into
the other, removes bins that would repeat a piece, and best-fits the displaced pieces.
After each of ``EPOCHS`` epochs the elites (the well-filled bins of an island's best packing)
migrate to the next island of the deme, which injects them into its own. The deme's best
packing then settles its well-filled bins; the pieces of its poor bins are dealt to the
demes of the next round, among pieces of many demes. The last round settles all. Demes
hold a bounded number of pieces at every size of input, whatever ids repeat or are
null, and islands are seeded by their numbers, so a lost task repeats the same result.

Null and empty texts are one piece with the end id alone. Rows are packed as they are:
repeated doc_ids each get their own pieces. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPACES, classes
from .common import discard, saved
from .words import Coder, gather

CAPACITY, END, DEME, ROUNDS = 2048, 0, 8192, 3
ISLANDS, EPOCHS = 2, 2
#: Bins with at most this share of waste are elites.
WASTE = 0.004
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_odd = re.compile("[\u0300-\U0010ffff]").search


@cache
def _word_pattern(ascii_only: bool) -> Callable[[str], list[str]]:
    l, n = ("a-z", "0-9") if ascii_only else classes(0x2FF)  # noqa: E741
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{l}]+|[{n}]|[^{SPACES}{l}{n}]+|\n").findall


def _special(chunk: str) -> bool:
    """Whether a chunk goes to the tokenizer as it is: it may hold a special token, or need the normaliser.

    Below U+0300 every text is in composed form and lower case does not depend on neighbours.
    """
    return "<|" in chunk or not chunk.isascii() and _odd(chunk) is not None


def _spaced(texts: pa.Array) -> pa.ListArray:
    """The chunks of texts between ASCII white space, ASCII texts without special tokens in lower case.

    Other texts keep their case: what follows a letter may compose with one case of it alone.
    """
    plain = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
    return pc.ascii_split_whitespace(pc.if_else(plain, pc.ascii_lower(texts), texts))


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core: threads of its own cost more than they save
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def _coder(path: str) -> Coder:
    """The worker's tables of chunks, of their words and of the ids: bounded, and shared by its tasks.

    Only new chunks are cut into words, and only new words reach the tokenizer.
    """
    t = _tokenizer(path)

    def resolve(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in t.encode_batch_fast(words, add_special_tokens=False)]
        n = np.array(list(map(len, found)), np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())), n

    return Coder(list, _by_words(Coder(list, resolve)))


def _by_words(coder: Coder) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Chunks by their words, all cut at once: a line feed, which has no ids, ends each chunk."""

    def resolve(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coder.shrink()
        special = np.fromiter(map(_special, chunks), bool, len(chunks))
        lines = "".join([c + "\n" for c, s in zip(chunks, special.tolist(), strict=True) if not s])
        words = coder.codes_of(_word_pattern(lines.isascii())(lines.lower()))
        whole = coder.codes_of([c for c, s in zip(chunks, special.tolist(), strict=True) if s])
        counts = np.diff(np.flatnonzero(words == coder.codes["\n"]), prepend=-1)
        ids, ends = coder.ids_of(np.concatenate([words, whole]), np.concatenate([counts, np.ones(len(whole), np.int64)]))
        n = np.diff(ends, prepend=0)
        place = np.argsort(np.argsort(special, kind="stable"), kind="stable")  # special chunks come last among the ids
        return gather(ids, (ends - n)[place], n[place]), n[place]

    return resolve


def _pieces(path: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            texts, rows = pc.fill_null(batch.column(1), ""), ([], [], [], [], [])
            owner = iter(batch.column(0).to_pylist())
            for ids, ends in coder.encode_column(texts, _spaced):
                at = 0
                for end in ends.tolist():
                    raw = ids[at:end].astype("<u4").tobytes() + END.to_bytes(4, "little")
                    doc, n, at = next(owner), end - at + 1, end
                    for k in range(-(-n // capacity)):
                        cut = raw[4 * k * capacity : 4 * (k + 1) * capacity]
                        for row, value in zip(rows, (doc, k, k * capacity, len(cut) // 4, zlib.crc32(cut)), strict=True):
                            row.append(value)
            yield pa.record_batch([pa.array(r, k) for r, k in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class Bins:
    """Bins with best-fit insertion: a bit per free size that some bin has, and the bins of each free size."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.free, self.of, self.mask = capacity, [], [], [[] for _ in range(capacity + 1)], 0

    def _file(self, b: int) -> None:
        self.of[self.free[b]].append(b)
        self.mask |= 1 << self.free[b]

    def add(self, items: list[int], free: int) -> None:
        self.items.append(items)
        self.free.append(free)
        self._file(len(self.items) - 1)

    def insert(self, item: int, size: int) -> None:
        fitting = self.mask >> size
        if not fitting:
            return self.add([item], self.capacity - size)
        at = size + (fitting & -fitting).bit_length() - 1
        b = self.of[at].pop()
        if not self.of[at]:
            self.mask &= ~(1 << at)
        self.items[b].append(item)
        self.free[b] = at - size
        self._file(b)
        return None

    def fitness(self) -> float:
        """Mean squared fill: between packings of the same pieces, fewer and fuller bins win."""
        return sum((1 - f / self.capacity) ** 2 for f in self.free) / max(1, len(self.free))


def _start(sizes: list[int], capacity: int, rng: random.Random, noise: float) -> Bins:
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * rng.random()))
    bins = Bins(capacity)
    for i in order:
        bins.insert(i, sizes[i])
    return bins


def _cross(a: Bins, b: Bins, sizes: list[int], rng: random.Random, waste: float) -> Bins:
    """``a`` with well-filled bins of ``b`` injected."""
    good = [k for k, f in enumerate(b.free) if f <= waste * b.capacity] or [min(range(len(b.free)), key=b.free.__getitem__)]
    chosen = rng.sample(good, max(1, len(good) // 2))
    taken = {i for k in chosen for i in b.items[k]}
    child, displaced = Bins(a.capacity), []
    poor = sorted((k for k in range(len(a.free)) if a.free[k] > waste * a.capacity), key=lambda k: -a.free[k])
    opened = set(poor[: max(1, len(poor) // 2)])  # the emptiest bins are opened as well, so that their pieces find better places
    for k, items in enumerate(a.items):
        if k in opened or not taken.isdisjoint(items):
            displaced += [i for i in items if i not in taken]
        else:
            child.add(list(items), a.free[k])
    for k in chosen:
        child.add(list(b.items[k]), b.free[k])
    for i in sorted(displaced, key=lambda i: -sizes[i]):
        child.insert(i, sizes[i])
    return child


def evolve(sizes: list[int], capacity: int, seed: int, population: int = 4, generations: int = 8, waste: float = WASTE, own: Bins | None = None, migrants: Bins | None = None) -> Bins:
    """The fittest packing after ``generations`` crossovers, or the first that meets the lower bound of bins.

    ``own`` is a packing of an earlier epoch, ``migrants`` are bins of another island to be injected into it.
    """
    rng, least = random.Random(seed), -(-sum(sizes) // capacity)
    living = [] if own is None else [own]
    if own is not None and migrants is not None and migrants.items and len(own.free) > least:
        living.append(_cross(own, migrants, sizes, rng, waste))
    for noise in (0.0, 0.02, 0.1, 0.3)[: population - (own is not None)]:
        if living and min(len(x.free) for x in living) <= least:
            return min(living, key=lambda s: len(s.free))  # no packing has fewer bins
        living.append(_start(sizes, capacity, rng, noise))
    rank = lambda s: (len(s.free), -s.fitness())
    for _ in range(generations):
        living.sort(key=rank)
        if len(living[0].free) <= least:
            break
        a, b = living[0], living[rng.randrange(1, len(living))] if len(living) > 1 else living[0]
        child = _cross(a, b, sizes, rng, waste) if rng.random() < 0.5 else _cross(b, a, sizes, rng, waste)
        if rank(child) < rank(living[-1]):
            living[-1] = child
    return min(living, key=rank)


STATE = PIECES + ", row long, deme long, island int, source int, bin long, offset long, elite boolean, bins long, waste double"


def _packed(bins_of: dict[int, list[int]], sizes: list[int], capacity: int) -> Bins:
    bins = Bins(capacity)
    for _, items in sorted(bins_of.items()):
        bins.add(items, capacity - sum(sizes[i] for i in items))
    return bins


def _island(capacity: int, waste: float, number: int, epoch: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        deme, island = int(rows["deme"].iloc[0]), int(rows["island"].iloc[0])
        mine = rows[rows["source"] == island].sort_values(["length", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
        sizes, own, migrants = mine["length"].tolist(), None, None
        if epoch:
            place = {row: i for i, row in enumerate(mine["row"].tolist())}
            held, came = {}, {}
            for row, b in zip(mine["row"].tolist(), mine["bin"].tolist(), strict=True):
                held.setdefault(b, []).append(place[row])
            others = rows[rows["source"] != island]
            for row, b in zip(others["row"].tolist(), others["bin"].tolist(), strict=True):
                came.setdefault(b, []).append(place[row])
            own, migrants = _packed(held, sizes, capacity), _packed(came, sizes, capacity)
        bins = evolve(sizes, capacity, ((deme * ISLANDS + island) * EPOCHS + epoch) * 31 + number, waste=waste, own=own, migrants=migrants)
        bin_of, offset, elite = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
        for b, items in enumerate(bins.items):
            at, good = 0, bins.free[b] <= waste * capacity
            for i in items:
                bin_of[i], offset[i], elite[i] = b, at, good
                at += sizes[i]
        return mine.assign(bin=bin_of, offset=offset, elite=elite, bins=len(bins.items), waste=-bins.fitness())

    return run


def _evolved(dealt: DataFrame, capacity: int, waste: float, number: int) -> DataFrame:
    """The best island's packing of every deme: ``dealt`` with bin, offset and elite."""
    state = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    state = state.withColumns({"source": F.col("island"), "bin": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "elite": F.lit(False), "bins": F.lit(0).cast("long"), "waste": F.lit(0.0)})
    names = [c.split(" ")[0] for c in STATE.split(", ")]
    for epoch in range(EPOCHS):
        out = saved(state.select(*names).groupBy("deme", "island").applyInPandas(_island(capacity, waste, number, epoch), STATE), f"islands{number}")
        if epoch:
            discard(held)
        held = out
        state = out.unionByName(out.where("elite").withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int")))
    best = held.groupBy("deme").agg(F.min(F.struct("bins", "waste", "island")).alias("best")).select("deme", F.col("best.island").alias("island"))
    return saved(held.join(best, ["deme", "island"]).drop("island", "source", "bins", "waste"), f"best{number}")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, deme: int = DEME, rounds: int = ROUNDS, waste: float = WASTE) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    pieces = saved(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("row") + F.lit(1 << 60), "offset": F.lit(0).cast("long"), "elite": F.lit(True)}).drop("row")
    rest, done = pieces.where(F.col("length") < capacity), whole
    for number in range(1, rounds + 1):
        demes = max(1, -(-rest.count() // deme))
        last = number == rounds or demes == 1
        out = _evolved(rest.withColumn("deme", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(demes)).cast("long")), capacity, waste, number)
        named = out.withColumn("sequence_id", F.lit(number << 58) + F.col("deme") * (1 << 24) + F.col("bin"))
        done = done.unionByName((named if last else named.where("elite")).select(*done.columns))
        if last:
            break
        rest = out.where("NOT elite").select(*pieces.columns)
    return done.drop("elite")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return pack_pieces(texts.mapInArrow(_pieces(path, capacity), PIECES), capacity)
