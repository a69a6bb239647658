"""N-gram join and components against brute force."""

import random
import re

import pytest

from leafmill.llm import ngram_join
from leafmill.llm.components import components
from leafmill.llm.shingles import shingle_sets

from .conftest import odd_rows, prose


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    sets, root = sets_of([t for _, t in rows]), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None) if sets[i] else doc))
    return sorted(map(str, out))


def test_odd_rows(odd, empty):
    assert sorted(str(tuple(r)) for r in ngram_join.join(odd).collect()) == brute(odd_rows())
    assert ngram_join.join(empty).collect() == []
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 4, 5, 6, 7, 9} and kept.where("doc_id IN (2, 3, 8)").count() == 0


def near(text, seed, edits):
    rng, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
    return " ".join(w)


def test_groups_chains_and_shared_passages(spark):
    passage, base, rows = prose(99, 120), [prose(s, 150) for s in range(4)], []
    for k, text in enumerate(base):
        for s in range(25):
            rows.append((len(rows), near(text, 100 * k + s, s % 6)))
        chain = text
        for s in range(8):
            chain = near(chain, 900 + 10 * k + s, 2)
            rows.append((len(rows), chain))
    for s in range(30):
        rows.append((len(rows), passage + " " + prose(500 + s, 10 + 5 * s)))
    rows += [(len(rows) + s, "short text here") for s in range(3)] + [(900 + s, f"four words in {s}") for s in range(3)]
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(str(tuple(r)) for r in ngram_join.join(docs).collect()) == brute(rows)


def test_pivot_rounds_are_exact(spark, monkeypatch):
    """With hardly any meetings allowed at the end, pivots go round after round."""
    rows = [(i, near(prose(7, 60), i, i % 5)) for i in range(40)] + [(100 + i, near(prose(8, 60), i, 3)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ENTRY", 0.0)
    monkeypatch.setattr(ngram_join, "ROUNDS", 3)
    monkeypatch.setattr(ngram_join, "SMALL", 1)
    assert sorted(str(tuple(r)) for r in ngram_join.join(docs).collect()) == brute(rows)


def test_shingle_counts():
    texts = [t for _, t in odd_rows()]
    assert [len(s) for s in shingle_sets(texts)] == [len(s) for s in sets_of(texts)]


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (5, 4), (9, 9)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], []])
def test_components(spark, edges):
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want, nodes = {}, sorted({x for e in edges if e[0] != e[1] for x in e})
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            x = todo.pop()
            new = {b for a, b in edges if a == x} | {a for a, b in edges if b == x}
            todo += new - seen
            seen |= new
        want[n] = min(seen)
    assert got == want


def test_rows_without_doc_id_link_and_bridge(spark):
    """Near copies without a doc_id, alone or between two documents that only they connect."""
    a, b = prose(21, 200).split(), prose(22, 200).split()
    rows = [(1, " ".join(b)), (None, " ".join([*b[:-1], "z"])), (None, " ".join(["q", *b[1:]]))]
    rows += [(11, " ".join([*(f"l{i}" for i in range(13)), *a[13:]])), (None, " ".join(a)), (10, " ".join([*a[:-13], *(f"r{i}" for i in range(13))]))]
    rows += [(None, prose(23, 100)), (None, near(prose(23, 100), 1, 1)), (None, near(prose(23, 100), 2, 1)), (30, prose(24, 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert sum("10)" in r for r in want) == 3  # 10 and 11 are in one component through a text without a doc_id
    assert sorted(str(tuple(r)) for r in ngram_join.join(docs).collect()) == want


def test_keep_one_keeps_one_row_of_each_component(spark):
    a, b, c, d = (prose(31 + s, 120) for s in range(4))
    rows = [(3, a, "x"), (12, near(a, 1, 1), "x"), (12, b, "x"), (20, c, "x"), (20, near(c, 2, 1), "x"), (21, near(c, 3, 1), "x")]
    rows += [(30, d, "x"), (30, d, "y"), (40, None, "x"), (40, None, "y"), (None, prose(41, 90), "x"), (None, near(prose(41, 90), 4, 1), "x"), (None, near(a, 5, 1), "x"), (None, prose(42, 90), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = [tuple(r) for r in ngram_join.keep_one(docs).collect()]
    assert set(kept) <= set(rows) and len(set(kept)) == len(kept) == 8
    assert {(3, a, "x"), (12, b, "x"), (40, None, "x"), (40, None, "y"), (None, prose(42, 90), "x")} <= set(kept)
    ids = [k[0] for k in kept]
    assert ids.count(20) == 1 and ids.count(30) == 1 and ids.count(None) == 2 and 21 not in ids


@pytest.mark.parametrize("edits", [(3, 4), (6, 9)])
def test_large_group_around_the_threshold(spark, edits):
    """Copies of one text whose edits leave them just inside or just outside the threshold, cut copies, and copies of copies."""
    base, rows = prose(51, 130), []
    for s in range(260):
        text = near(base, s, edits[s % 2])
        rows.append((s, text if s % 5 else " ".join(text.split()[: 110 + s % 20])))
    rows += [(1000 + s, near(rows[s * 7][1], 5000 + s, 1)) for s in range(30)] + [(2000, base)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got, want = sorted(str(tuple(r)) for r in ngram_join.join(docs).collect()), brute(rows)
    assert got == want and len({w.split(",")[2] for w in want}) > 3


def test_salted_shingles(spark, monkeypatch):
    """Every shingle counts as frequent: salted groups give the same components."""
    rows = [(i, near(prose(61 + i % 3, 50), i, i % 6)) for i in range(60)]
    monkeypatch.setattr(ngram_join, "HOT", 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(str(tuple(r)) for r in ngram_join.join(docs).collect()) == brute(rows)
