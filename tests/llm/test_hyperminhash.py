"""Near copies by compressed registers: against brute force, SQL, and what the sketch promises."""

import random
import re

import numpy as np
import pytest

from leafmill.llm import hyperminhash as hmh
from leafmill.llm import ngram_join
from leafmill.llm.queries import op5_ngram_join, op12_hyperminhash, oracle_sql

from .conftest import odd_rows, prose


def sets_of(texts, words=3):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def brute(rows, percent=85):
    sets, root = sets_of([t for _, t in rows]), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids, default=None) if sets[i] else doc
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(map(str, out))


def edited(text, seed, edits):
    rng, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
    return " ".join(w)


def many_rows():
    passage, rows = prose(99, 120), []
    for k in range(4):
        base = chain = prose(k, 150)
        for s in range(25):
            rows.append((len(rows), edited(base, 100 * k + s, s % 8)))
        for s in range(8):
            chain = edited(chain, 900 + 10 * k + s, 3)
            rows.append((len(rows), chain))
    for s in range(30):
        rows.append((len(rows), passage + " " + prose(500 + s, 10 + 5 * s)))
    tiny = prose(77, 8)
    rows += [(len(rows), tiny), (len(rows) + 1, tiny + " more"), (len(rows) + 2, "short text"), (len(rows) + 3, "SHORT text"), (len(rows) + 4, tiny + " more words here now")]
    random.Random(5).shuffle(rows)
    return rows


def same(got, want):
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_odd_rows(odd, empty):
    same(hmh.join(odd), brute(odd_rows()))
    assert hmh.join(empty).collect() == []
    kept = hmh.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 4, 5, 6, 7, 9} and kept.where("doc_id IN (2, 8)").count() == 0


@pytest.mark.parametrize("pivots", [False, True])
def test_groups_chains_and_shared_passages(spark, monkeypatch, pivots):
    if pivots:  # hardly any meetings allowed at the end, so that pivots go round after round
        monkeypatch.setattr(ngram_join, "PAIRS_PER_ENTRY", 0.0)
        monkeypatch.setattr(ngram_join, "ROUNDS", 3)
        monkeypatch.setattr(hmh.Sketched, "most", 1)
    rows = many_rows()
    same(hmh.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), brute(rows))


@pytest.mark.parametrize("query", [op5_ngram_join, op12_hyperminhash])
def test_queries_equal_sql(spark, sf_dir, query):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = query(spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()[query.__name__]})").fetchall()
    same(got, sorted(map(str, want)))
    assert len({r[2] for r in want}) < len(want)


def test_registers_keep_order_and_ends():
    least = np.array([0, 1, 1 << 40, (1 << 62), (1 << 63) - 1, 1 << 63, (1 << 64) - 2, (1 << 64) - 1], np.uint64)
    got = hmh._compressed(least)
    assert got[-1] == hmh.EMPTY and (got[:-1] != hmh.EMPTY).all()
    assert (got[2:-1] >> hmh.MANTISSA).tolist() == [23, 1, 1, 0, 0] and (got[:2] >> hmh.MANTISSA).tolist() == [53, 53]
    assert got[4] & 1023 == 1023 and got[3] & 1023 == 0


def test_estimates_and_recall():
    """At the threshold the estimate is right on average, no pair misses all bands and the margin drops none."""
    rng = np.random.default_rng(8)
    for n, shared in ((400, 368), (60, 56), (6, 6)):  # similarity 0.852, 0.875, 6 of 7
        a, b = [], []
        for _ in range(400):
            both = rng.integers(0, 1 << 63, shared, np.uint64)
            a.append(np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n - shared, np.uint64)])))
            b.append(np.unique(np.concatenate([both, rng.integers(0, 1 << 63, max(1, n - shared), np.uint64)])))
        ra, rb = hmh.registers(a), hmh.registers(b)
        bands = (ra.reshape(-1, hmh.BANDS, hmh.BUCKETS) == rb.reshape(-1, hmh.BANDS, hmh.BUCKETS)).all(2)
        assert bands.any(1).all()
        share, told = hmh.estimate(ra, rb, np.full(400, n), np.full(400, n))
        true = shared / (2 * max(n, shared + 1) - shared) if n > shared else shared / (shared + 1)
        assert abs(share.mean() - true) < 0.01
        assert (share >= 0.85 - hmh.SIGMAS * np.sqrt(0.85 * 0.15 / told)).all()
    far, other = hmh.registers([rng.integers(0, 1 << 63, 300, np.uint64) for _ in range(300)]), hmh.registers([rng.integers(0, 1 << 63, 300, np.uint64) for _ in range(300)])
    assert abs(hmh.estimate(far, other, np.full(300, 300), np.full(300, 300))[0].mean()) < 0.001


def test_register_collisions_are_as_expected(monkeypatch):
    """With few mantissa bits chance collisions are frequent, and the correction takes them away."""
    monkeypatch.setattr(hmh, "MANTISSA", 2)
    rng = np.random.default_rng(9)
    sides = [hmh.registers([rng.integers(0, 1 << 63, 300, np.uint64) for _ in range(300)]) for _ in range(2)]
    assert (sides[0] == sides[1]).mean() > 0.03
    assert abs(hmh.estimate(*sides, np.full(300, 300), np.full(300, 300))[0].mean()) < 0.005
