"""Centroid clustering with Yinyang bounds: Lloyd's rounds in whole numbers, most distances never computed.

Vectors become rows of whole numbers ``floor(256 * x)``. The centroids are put into groups once, ten to
a group. A vector's row carries its cluster, an upper bound of the distance to that centroid and
one lower bound for each group, of the distances to the group's other centroids. When centroids have
moved, bounds give way by at most the way moved; a vector whose upper bound stays below all
its lower bounds keeps its cluster (global filter); else the distance to its own centroid is
computed, and only groups whose lower bound does not exceed it are scanned, exactly.
Squared distances are whole numbers and bounds are rounded outwards, so that every cluster is that
of an exhaustive search, ties included (smaller number).

A round is one scan without join or shuffle: rows go from one saved table to the next, and each task
adds what moved from cluster to cluster as at most two sums a centroid, which Spark combines to one row each.
The driver holds the centroids, and nothing that grows with the input.

Vectors without exactly ``dimensions`` components, or with null or non-finite ones, take no part. Rows
without a vec_id are clustered, but none starts as a centroid; rows that repeat a vec_id each count (the
lexicographically smaller vector comes first as a start). With fewer vectors than ``clusters``, there are
as many centroids as vectors with an id; without any, the result is empty. Components of ``LARGEST`` or more
(after scaling) are an error: distances would not fit their type. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Centroids in a group, and rounds of the grouping.
GROUP, GROUPING = 10, 5
#: Components smaller than this have squared distances below 2 ** 61 in 64 dimensions; below EXACT, products of doubles are exact.
LARGEST, EXACT = 1 << 26, 1 << 22
_NO = np.iinfo(np.int64).max

STATE = "vec_id long, x binary, cluster int, upper double, lower binary, moved int, n long, sums array<long>"


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def _rows(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = x.itemsize * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, width * (len(x) + 1), width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _scaled(dimensions: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = pa.compute.equal(pa.compute.list_value_length(batch.column(1)), dimensions).fill_null(False)
            some = batch.filter(fits)
            x = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)  # nulls are NaN
            good = np.isfinite(x).all(1)
            whole = np.floor(scale * x[good])
            if whole.size and np.abs(whole).max() >= LARGEST:
                raise ValueError(f"components must be below {LARGEST} after scaling")
            yield pa.record_batch([some.column(0).filter(pa.array(good)), _rows(whole.astype("<i4"))], ["vec_id", "x"])

    return run


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all of ``y``."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) < EXACT:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([_apart(x, c) for c in y], 1)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x.astype(np.int64) - y
    return (d * d).sum(1)


class Centroids:
    """The centroids of a round, their groups, and how far each has moved since the bounds were set."""

    def __init__(self, at: np.ndarray, groups: np.ndarray, moved: np.ndarray):
        self.at, self.moved = at, _up(np.sqrt(moved.astype(np.float64)))
        self.members = [np.flatnonzero(groups == g) for g in range(groups.max(initial=0) + 1)]
        self.group = groups
        self.farthest = np.array([self.moved[m].max(initial=0.0) for m in self.members])

    def to(self, at: np.ndarray) -> Centroids:
        return Centroids(at, self.group, _apart(at, self.at))


def _grouped(at: np.ndarray) -> np.ndarray:
    """The group of each centroid: a few rounds of clustering among the centroids themselves."""
    count = max(1, -(-len(at) // GROUP))
    middle = at[:count].astype(np.float64)
    group = np.zeros(len(at), np.int64)
    for _ in range(GROUPING):
        group = ((at[:, None, :] - middle) ** 2).sum(2).argmin(1)
        middle = np.stack([at[group == g].mean(0) if (group == g).any() else middle[g] for g in range(count)])
    return group


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New clusters, upper and lower bounds, and how many distances were computed. A cluster of -1 is not assigned yet."""
    old = cluster >= 0
    upper, lower, new = np.where(old, _up(upper + c.moved[cluster]), np.inf), _down(lower - c.farthest), cluster.copy()
    at = np.flatnonzero(upper >= lower.min(1))  # global filter
    best = np.full(len(at), _NO)
    best[old[at]] = _apart(x[at[old[at]]], c.at[cluster[at[old[at]]]])
    upper[at] = _up(np.sqrt(best.astype(np.float64)))
    still = upper[at] >= lower[at].min(1)
    counted, at, best = int(old[at].sum()), at[still], best[still]
    own, low, chosen, scanned = best.copy(), lower[at], cluster[at], []
    for g, members in enumerate(c.members):
        near = np.flatnonzero(low[:, g] <= _up(np.sqrt(best.astype(np.float64))))  # group filter
        if len(near) and len(members):
            d = _squared(x[at[near]], c.at[members])
            counted += d.size
            first = d.argmin(1)
            least = d[np.arange(len(d)), first]
            d[np.arange(len(d)), first] = _NO
            scanned.append((g, near, members[first], least, d.min(1)))
            better = (least < best[near]) | (least == best[near]) & (members[first] < chosen[near]) | (chosen[near] < 0)
            best[near[better]], chosen[near[better]] = least[better], members[first][better]
    left = np.flatnonzero((chosen != cluster[at]) & (cluster[at] >= 0))  # the centroid left is one of its group's others now
    of = c.group[cluster[at[left]]]
    low[left, of] = np.minimum(low[left, of], _down(np.sqrt(own[left].astype(np.float64))))
    for g, near, first, least, second in scanned:
        others = np.where(first == chosen[near], second, least)
        low[near, g] = np.where(others == _NO, np.inf, _down(np.sqrt(others.astype(np.float64))))
    new[at], lower[at], upper[at] = chosen, low, _up(np.sqrt(best.astype(np.float64)))
    return new, upper, lower, counted


def _sums(cluster: np.ndarray, x: np.ndarray, sign: int, total: dict[int, list]) -> None:
    for k in np.unique(cluster).tolist():
        mine = x[cluster == k]
        held = total.setdefault(k, [0, np.zeros(x.shape[1], np.int64)])
        held[0] += sign * len(mine)
        held[1] += sign * mine.sum(0, dtype=np.int64)


def _total_rows(total: dict[int, list]) -> list[pa.Array]:
    return [pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([s.tolist() for _, s in total.values()], pa.list_(pa.int64()))]


def _round(shared, dimensions: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with new clusters and bounds, and what moved: one row a centroid and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, total, names = shared.value, {}, ["vec_id", "x", "cluster", "upper", "lower", "moved", "n", "sums"]
        for batch in batches:
            n, groups = batch.num_rows, len(c.members)
            x = _matrix(batch.column(1), "<i4", dimensions)
            if batch.num_columns == 2:
                cluster, upper, lower = np.full(n, -1), np.full(n, np.inf), np.full((n, groups), -np.inf)
            else:
                cluster, upper = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy()
                lower = _matrix(batch.column(4), "<f8", groups)
            new, upper, lower, _ = assign(x, cluster, upper, lower, c)
            changed = new != cluster
            _sums(new[changed], x[changed], 1, total)
            _sums(cluster[changed & (cluster >= 0)], x[changed & (cluster >= 0)], -1, total)
            none = [pa.nulls(n, kind) for kind in (pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(new.astype(np.int32)), pa.array(upper), _rows(lower), *none], names)
        rows = _total_rows(total)
        none = [pa.nulls(len(rows[0]), kind) for kind in (pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.binary())]
        yield pa.record_batch([*none, *rows], names)

    return run


def _distances(shared, dimensions: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The squared distance of each row to its centroid, and their sum: one row a centroid and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, total, names = shared.value, {}, ["vec_id", "cluster", "distance", "moved", "n", "sums"]
        for batch in batches:
            cluster = batch.column(2).to_numpy().astype(np.int64)
            d = _apart(_matrix(batch.column(1), "<i4", dimensions), c.at[cluster])
            _sums(cluster, d[:, None], 1, total)
            none = [pa.nulls(len(d), kind) for kind in (pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(d), *none], names)
        rows = _total_rows(total)
        none = [pa.nulls(len(rows[0]), kind) for kind in (pa.int64(), pa.int32(), pa.int64())]
        yield pa.record_batch([*none, *rows], names)

    return run


def _collected(table: DataFrame, width: int) -> dict[int, tuple[int, ...]]:
    """n and the sums of each centroid: at most one row a centroid comes to the driver."""
    rows = table.where("moved IS NOT NULL").groupBy("moved").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    return {r["moved"]: tuple(r[1:]) for r in rows.collect()}


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    spark, out = vectors.sparkSession, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    table = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    table = saved(table.mapInArrow(_scaled(dimensions, scale), "vec_id long, x binary"), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    start = table.where("vec_id IS NOT NULL").orderBy(order, "x").limit(clusters).select("x").collect()
    if not start:
        discard(table)
        return spark.createDataFrame([], out)
    at = np.stack([np.frombuffer(r["x"], "<i4") for r in start]).astype(np.int64)
    c = Centroids(at, _grouped(at), np.zeros(len(at), np.int64))
    total = {k: [0] * (dimensions + 1) for k in range(len(at))}
    for number in range(rounds + 1):
        state = saved(table.mapInArrow(_round(spark.sparkContext.broadcast(c), dimensions), STATE), "assigned")
        discard(table)
        table = state.where("moved IS NULL").select("vec_id", "x", "cluster", "upper", "lower")
        table.saved_at = state.saved_at
        for k, sums in _collected(state, dimensions).items():
            total[k] = [a + b for a, b in zip(total[k], sums, strict=True)]
        if number == rounds:
            break
        new = c.to(np.array([[s // t[0] for s in t[1:]] if t[0] else c.at[k].tolist() for k, t in total.items()], np.int64))
        if (new.at == c.at).all():  # nothing would change any more
            break
        c = new
    last = saved(table.mapInArrow(_distances(spark.sparkContext.broadcast(c), dimensions), "vec_id long, cluster int, distance long, moved int, n long, sums array<long>"), "clustered")
    discard(table)
    inertia = {k: s for k, (_, s) in _collected(last, 1).items()}
    told = [(k, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, c.at[k].tolist())).encode()).hexdigest()) for k, s in inertia.items()]
    by = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row a centroid
    return last.where("moved IS NULL").select("vec_id", "cluster", "distance").join(F.broadcast(by), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same clusters by exhaustive search, in DuckDB's SQL."""
    parts = [
        f"x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda e: coalesce(isfinite(e), false))) = {dimensions})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM x WHERE vec_id IS NOT NULL ORDER BY h LIMIT {clusters}))",
    ]
    for r in range(rounds + 1):
        distance = f"list_sum(list_transform(range(1, {dimensions + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::BIGINT"
        parts.append(f"a{r} AS MATERIALIZED (SELECT * FROM (SELECT vec_id, x.v AS v, k, {distance} AS d FROM x, c{r} c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)")
        sums = f"SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {dimensions + 1}) t(i) GROUP BY k, i"
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT k, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS v FROM ({sums}) GROUP BY k) m ON c.k = m.k)")
    told = f"SELECT vec_id, a.k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k"
    return f"WITH {', '.join(parts)} {told}"
