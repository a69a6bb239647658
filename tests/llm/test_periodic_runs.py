"""Runs of repeated words against brute force and SQL."""

import hashlib
import random
import zlib

import pytest

from leafmill.llm import periodic_runs
from leafmill.llm.queries import op13_periodic_runs, oracle_sql

from .conftest import odd_rows


def brute(w):
    """Stretches of every distance, and of equal stretches the smallest distance."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= 12:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def answer(doc_id, text, plant=True):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *(top and (*top, 1000 * top[1] // top[2]) or (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def random_words(rng):
    w = [rng.choice("abcdefg"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(80))]
    if w and rng.random() < 0.5:
        a = rng.randrange(len(w))
        p = 1 + rng.randrange(len(w) - a)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


def test_runs_of_random_words():
    rng = random.Random(11)
    for _ in range(150):
        texts = [random_words(rng) for _ in range(rng.randrange(9))]
        assert [[tuple(r) for r in f.tolist()] for f in periodic_runs.runs(texts)] == [brute(w) for w in texts]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def test_words_with_very_many_runs():
    for w in (fibonacci(300), ["x"] * 200, list("ab" * 100 + "ba" * 60), list("abc" * 40 + "abd" * 40) * 2):
        assert [tuple(r) for r in periodic_runs.runs([w])[0].tolist()] == brute(w)


def test_long_texts_end_in_time():
    periodic = [f"w{i % 7}" for i in range(200_000)]
    assert periodic_runs.runs([periodic])[0].tolist() == [[0, 200_000, 7]]


def test_query_equals_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = op13_periodic_runs(spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()['op13_periodic_runs']})").fetchall()
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want))
    assert sum(r[1] > 0 for r in want) > 5


def test_odd_rows(spark, odd, empty):
    rows = [r for r in odd_rows() if len((r[1] or "").split()) < 5000]
    got = periodic_runs.detect(odd, plant=True).collect()
    assert len(got) == len(odd_rows())
    want = sorted(str(answer(*r)) for r in rows)
    assert sorted(str(tuple(r)) for r in got if r.doc_id != 9) == want
    assert periodic_runs.detect(empty).collect() == [] and periodic_runs.collapse(empty).collect() == []


def test_collapse_keeps_all_else(spark, odd):
    line = "one two three four "
    docs = spark.createDataFrame([(1, "  start  " + line * 9 + "end\n"), (2, " no  runs here "), (3, None), (None, line * 3)], "doc_id long, text string").selectExpr("doc_id", "'x' AS words", "text", "named_struct('a', doc_id) AS n_runs")
    got = {r.doc_id: r for r in periodic_runs.collapse(docs).collect()}
    assert periodic_runs.collapse(docs).schema == docs.schema
    assert got[1].text == "start one two three four end" and got[2].text == " no  runs here " and got[3].text is None and got[None].text == line.strip()
    assert got[1].n_runs.a == 1 and got[2].words == "x"
    same = {(r.doc_id, r.text) for r in periodic_runs.collapse(odd).collect()}
    assert same >= {(i, t) for i, t in odd_rows() if i not in (13, 15)}
