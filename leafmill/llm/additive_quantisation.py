"""Approximate nearest neighbours by additive quantisation.

``CODEBOOKS`` codebooks of ``CODES`` full-dimensional words are fitted on the driver to at
most about ``SAMPLE`` vectors (drawn by a hash of vec_id): residual k-means first, then rounds of beam
encoding and least squares over all codebooks at once. Every vector is indexed: a
beam of ``BEAM`` partial sums picks its code words, and the squared norm of their sum is stored.

A search takes queries in blocks of ``BLOCK``. For each block every partition of the index
is read once: lookup tables of inner products and the stored norms score all codes. A query
carries the ``SHORTLIST`` best scores of the partition through its chunks of ``CHUNK`` rows; what
gets among them is reranked by exact double-precision distance while its chunk is at hand.
Each partition returns its best k of each query, which are merged.

Ties go to the smaller vec_id, also between equal codes. Vectors that are null, zero, hold
null or non-finite components, have no vec_id or another dimension than most take no
part. Rows that repeat a vec_id are candidates of their own, also of each other; a repeated
query is asked once, with its smallest vector, and only that row is no candidate. With fewer candidates than k all are returned; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

CODEBOOKS, CODES, BEAM, SAMPLE = 16, 256, 4, 10_000
BLOCK, CHUNK, SHORTLIST = 1024, 4096, 256


@dataclass
class Codebooks:
    words: np.ndarray  # codebook x code x dimension

    def __post_init__(self) -> None:
        self.norms = (self.words**2).sum(2)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each vector and the squared norm of the sum of its words."""
        m, k, d = self.words.shape
        codes, norms = np.zeros((len(x), m), np.uint8 if k <= 256 else np.uint16), np.zeros(len(x))
        step = max(1, 1_000_000 // (beam * k))
        for a in range(0, len(x), step):
            part = x[a : a + step]
            n, dots = len(part), np.einsum("nd,mkd->nmk", part, self.words, optimize=True)
            cost, taken, sums = np.zeros((n, 1)), np.zeros((n, 1, 0), np.int64), np.zeros((n, 1, d))
            for level in range(m):
                inner = (sums.reshape(-1, d) @ self.words[level].T).reshape(n, -1, k)
                new = (cost[:, :, None] + self.norms[level] - 2 * dots[:, None, level] + 2 * inner).reshape(n, -1)
                width = min(beam, new.shape[1])
                best = np.argpartition(new, width - 1, axis=1)[:, :width]
                cost = np.take_along_axis(new, best, 1)
                sums = np.take_along_axis(sums, (best // k)[:, :, None], 1) + self.words[level][best % k]
                taken = np.concatenate([np.take_along_axis(taken, (best // k)[:, :, None], 1), (best % k)[:, :, None]], 2)
            first = cost.argmin(1)
            codes[a : a + step] = taken[np.arange(n), first]
            norms[a : a + step] = (sums[np.arange(n), first] ** 2).sum(1)
        return codes, norms


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((centre * centre).sum(1) - 2 * x @ centre.T).argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.choice(len(x), k)])
    return centre


def train(x: np.ndarray, codebooks: int = CODEBOOKS, codes: int = CODES, rounds: int = 1, seed: int = 7) -> Codebooks:
    rng, rest, words = np.random.default_rng(seed), x.copy(), []
    for _ in range(codebooks):
        words.append(_kmeans(rest, codes, rng))
        rest = rest - words[-1][((words[-1] ** 2).sum(1) - 2 * rest @ words[-1].T).argmin(1)]
    books = Codebooks(np.stack(words))
    for _ in range(rounds):
        picked, _ = books.encode(x, beam=2)
        at, size = picked.astype(np.int64) + codes * np.arange(codebooks), codebooks * codes
        pairs = (at[:, :, None] * size + at[:, None, :]).reshape(-1)  # which words occur together
        gram = np.bincount(pairs, minlength=size * size).reshape(size, size) + 1e-2 * np.eye(size)
        total = 1e-2 * books.words.reshape(size, -1)
        np.add.at(total, at.reshape(-1), np.repeat(x, codebooks, axis=0))
        solved = np.linalg.solve(gram, total)
        books = Codebooks(solved.reshape(books.words.shape))
    return books


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda c: c != 0), F.lit(False))


def usable(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    if dimension is None:
        top = out.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
        dimension = top[0]["d"] if top else 0
    return out.where(F.size("embedding") == dimension)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _indexed(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, norms = books.encode(_matrix(batch.column(1)))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], ["vec_id", "embedding", "codes", "norm"])

    return run


def build_index(vectors: DataFrame, sample: int = SAMPLE) -> tuple[Codebooks | None, DataFrame]:
    """Codebooks, and an index row (vec_id, embedding, codes, norm, row) for every usable vector; row is a number of its own."""
    vectors = usable(vectors)
    n = vectors.count()
    share = min(1.0, sample / n) if n else 0
    picked = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000_000)) < int(share * 1_000_000_000)).select("vec_id", "embedding").limit(2 * sample).collect()
    if not n:
        return None, vectors.selectExpr("vec_id", "embedding", "cast(null as binary) codes", "cast(0 as double) norm", "0L row")
    if not picked:
        picked = vectors.limit(sample).collect()
    x = np.array([r["embedding"] for r in sorted(picked, key=lambda r: (r["vec_id"], r["embedding"]))], np.float64)
    books = train(x)
    return books, saved(vectors.mapInArrow(_indexed(books), "vec_id long, embedding array<double>, codes binary, norm double").withColumn("row", F.monotonically_increasing_id()), "index")


def _best(score: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
    """The positions of the ``width`` least scores of each row, least first; ties to the smaller id."""
    if score.shape[1] > width:
        cut = np.partition(score, width - 1, axis=1)[:, width - 1 : width]
        out = np.empty((len(score), width), np.int64)
        for i, row in enumerate(score <= cut):
            at = np.flatnonzero(row)
            out[i] = at[np.lexsort((ids[at] if ids.ndim == 1 else ids[i, at], score[i, at]))][:width]
        return out
    return np.lexsort((np.broadcast_to(ids, score.shape), score), axis=1)


def _searched(books, asked, k: int, shortlist: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, own_rows = asked.value
        words = books.value.words
        m = words.shape[0]
        table = np.einsum("qd,mkd->mqk", queries, words, optimize=True)
        best_d, best_i = np.full((len(queries), 0), np.inf), np.zeros((len(queries), 0), np.int64)
        least = np.full((len(queries), 0), np.inf)  # the best scores so far
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                ids, x = part.column(0).to_numpy(), _matrix(part.column(1))
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(ids), m)
                score = np.broadcast_to(part.column(3).to_numpy(), (len(queries), len(ids))).copy()
                for level in range(m):
                    score -= 2 * table[level][:, codes[:, level]]
                score[own_rows[:, None] == part.column(4).to_numpy()[None, :]] = np.inf
                near = _best(score, ids, min(shortlist, len(ids)))
                scores = np.take_along_axis(score, near, 1)
                least = np.concatenate([least, scores], 1)
                if least.shape[1] > shortlist:
                    least = np.partition(least, shortlist - 1, axis=1)[:, :shortlist]
                q, c = np.nonzero((scores <= least.max(1, keepdims=True)) & np.isfinite(scores))
                own, exact = ids[near], np.full(near.shape, np.inf)
                for i in range(0, len(q), 1 << 15):
                    qi, ci = q[i : i + (1 << 15)], c[i : i + (1 << 15)]
                    diff = x[near[qi, ci]] - queries[qi]
                    exact[qi, ci] = np.sqrt(np.einsum("rd,rd->r", diff, diff))
                best_d, best_i = np.concatenate([best_d, exact], 1), np.concatenate([best_i, own], 1)
                keep = _best(best_d, best_i, min(k, best_d.shape[1]))
                best_d, best_i = np.take_along_axis(best_d, keep, 1), np.take_along_axis(best_i, keep, 1)
        ok = np.isfinite(best_d)
        yield pa.record_batch([pa.array(np.repeat(query_ids, ok.sum(1))), pa.array(best_i[ok]), pa.array(best_d[ok])], ["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, books: Codebooks | None, queries: DataFrame, k: int = 10, block: int = BLOCK, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each of ``queries``, which are rows of ``index`` (vec_id, embedding, row)."""
    spark = index.sparkSession
    found = None
    asked = queries.groupBy("vec_id").agg(F.min(F.struct("embedding", "row")).alias("own")).select("vec_id", "own.embedding", "own.row")
    n = asked.count() if books else 0
    blocks = -(-n // block)
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect()
        if not rows:
            continue
        held = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64), np.array([r["row"] for r in rows])))
        run = _searched(spark.sparkContext.broadcast(books), held, k, shortlist)
        got = index.mapInArrow(run, "query_id long, vec_id long, score double")
        got = got.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
        got = got if blocks == 1 else saved(got, f"block{i}")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k nearest of every vector whose vec_id is divisible by ``every``."""
    books, index = build_index(vectors)
    return search(index, books, index.where(F.col("vec_id") % every == 0).select("vec_id", "embedding", "row"), k)
