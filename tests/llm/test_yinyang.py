"""Centroid clustering against exhaustive search and SQL."""

import hashlib
import math

import numpy as np
import pytest

from leafmill.llm import yinyang
from leafmill.llm.queries import op11_yinyang, oracle_sql


def brute(rows, clusters, rounds):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) by comparing everything with everything."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    at = [v for _, v in first[:clusters]]
    if not at:
        return []
    for r in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(at)) for _, v in kept]
        if r < rounds:
            for k in range(len(at)):
                mine = [v for (_, v), (_, of) in zip(kept, near, strict=True) if of == k]
                at[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else at[k]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return [(i, k, d, sum(e for e, j in near if j == k), sum(e for e, _ in near), name[k]) for (i, _), (d, k) in zip(kept, near, strict=True)]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def same(got, want):
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want))


def test_query_equals_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = op11_yinyang(spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()['op11_yinyang']})").fetchall()
    same(got, want)


def test_odd_rows_ties_and_repeats(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 0.2, (6, 64))
    rows = [(i, (middle[i % 6] + rng.normal(0, 0.02, 64)).tolist()) for i in range(90)]
    same_vector = [0.25] * 64
    rows += [(100 + i, same_vector) for i in range(40)]  # ties between equal centroids
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, same_vector)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63), (205, [math.nan] * 64), (206, [math.inf] * 64), (207, [0.0] * 64), (208, [-1e-9] * 64)]
    docs = table(spark, rows).selectExpr("*", "1 AS x", "2 AS cluster", "3 AS label").repartition(5)
    same(yinyang.cluster(docs), brute(rows, 40, 5))
    same(yinyang.cluster(docs, clusters=5, rounds=8), brute(rows, 5, 8))
    few = [(1, same_vector), (2, rows[0][1])]
    same(yinyang.cluster(table(spark, few)), brute(few, 40, 5))


def test_no_vectors(spark):
    assert yinyang.cluster(table(spark, [])).collect() == []
    assert yinyang.cluster(table(spark, [(1, None), (None, [1.0] * 64)])).collect() == []


def test_large_components(spark):
    rows = [(i, [float((i * 37 + j * 101) % 97) * 2500.0 * (-1) ** j for j in range(64)]) for i in range(30)]
    same(yinyang.cluster(table(spark, rows), clusters=7), brute(rows, 7, 5))
    with pytest.raises(Exception, match="components must be below"):
        yinyang.cluster(table(spark, [(1, [1e30] * 64)])).collect()


def test_bounds_are_exact_and_save_distances():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 30, (30, 64)))[rng.integers(0, 30, 4000)].astype(np.int32) + rng.integers(-8, 9, (4000, 64), np.int32)
    at = x[:40].astype(np.int64)
    c = yinyang.Centroids(at, yinyang._grouped(at), np.zeros(40, np.int64))
    cluster, upper, lower, counts = np.full(4000, -1), np.full(4000, np.inf), np.full((4000, len(c.members)), -np.inf), []
    for _ in range(8):
        cluster, upper, lower, counted = yinyang.assign(x, cluster, upper, lower, c)
        d = yinyang._squared(x, c.at)
        assert (cluster == d.argmin(1)).all()
        root = np.sqrt(d.astype(float))
        assert (upper >= root[np.arange(4000), cluster]).all()
        root[np.arange(4000), cluster] = np.inf
        assert all((lower[:, g] <= root[:, m].min(1)).all() for g, m in enumerate(c.members) if len(m))
        counts.append(counted)
        c = c.to(np.stack([x[cluster == k].sum(0, dtype=np.int64) // (cluster == k).sum() if (cluster == k).any() else c.at[k] for k in range(40)]))
    assert counts[0] == 160_000 and sum(counts[3:]) < 0.35 * 160_000 * 5
