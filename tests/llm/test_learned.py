"""Classifiers and the vector index: held-out accuracy, recall, odd rows."""

import zlib

import numpy as np
import pytest

from leafmill.llm import additive_quantisation as aq
from leafmill.llm import language_id, quality
from leafmill.llm.common import documents

from .conftest import odd_rows


def folds(rows):
    return {r.doc_id: r.held_out for r in rows} == {i: i is None or zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in odd_rows()}


def test_language_accuracy(spark, sf_dir):
    docs = documents(spark, "/root/testdata/sf0.01")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in language_id.identify(docs).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd, empty):
    rows = language_id.identify(odd).collect()
    assert folds(rows) and len(rows) == len(odd_rows())
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {4, 5, 6, 13, 14}
    assert language_id.identify(empty).collect() == []
    assert {r.lang_pred for r in language_id.identify(odd.withColumn("lang", odd["source"])).collect()} == {"und"}


def test_temperature_and_sparsity():
    rows = [("the cat sat on the mat with that hat", "en"), ("der hund und die katze sind nicht hier", "de")] * 30
    model = language_id.train(rows, np.ones(language_id.FEATURES))
    assert model.langs == ["de", "en"] and model.temperature > 0
    assert 0 < (model.weights != 0).mean() < 0.01
    assert model.predict("that hat is on the cat")[0] == "en" and model.predict(None) == ("und", 1.0)


def test_quality_accuracy(spark, sf_dir):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.score(documents(spark, sf), labels).collect() if r.held_out and r.doc_id in truth]
    good, bad = ([r.predicted for r in rows if truth[r.doc_id] == y] for y in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)
    assert all((r.score >= 0.7) == (r.predicted == 1) for r in rows)


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (None, 0, 0), (7, None, 0), (9, 0, 1), (9, 1, 1), (10, 0, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.score(odd, labels).collect()
    assert folds(rows) and len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    none = labels.where("doc_id < 0")
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}
    assert {r.score for r in quality.score(odd, labels.where("doc_id = 1")).collect()} <= {0.5, 1.0}
    assert quality.score(empty, labels).collect() == []
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_scores_are_log_density_differences():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(3, 3)), rng.normal(size=(3, 3))
    cov = [m @ m.T + np.eye(3) for m in (a, b)]
    chol = [np.linalg.cholesky(c) for c in cov]
    model = quality.Model([np.zeros(3), np.ones(3)], [np.linalg.inv(c) for c in chol], [-np.log(np.diag(c)).sum() for c in chol], np.full(3, -9.0), np.full(3, 9.0))
    x = rng.normal(size=(5, 3))
    want = [-0.5 * (v - 1) @ np.linalg.inv(cov[1]) @ (v - 1) - 0.5 * np.log(np.linalg.det(cov[1])) + 0.5 * v @ np.linalg.inv(cov[0]) @ v + 0.5 * np.log(np.linalg.det(cov[0])) for v in x]
    assert np.allclose(model.margin(x), want)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=16)], 0) for i in range(1500)]
    rows += [(i, rows[100][1], 1) for i in range(1500, 1560)]
    rows += [(2000, None, 0), (2100, [0.0] * 16, 0), (2200, [None] + [1.0] * 15, 0), (2300, [float("nan")] * 16, 0), (2400, [float("inf")] * 16, 0), (2500, [], 0), (None, [1.0] * 16, 0), (2600, [1.0] * 3, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(4)


def test_nearest(vectors):
    rows = [r for r in vectors.collect() if r.vec_id is not None and r.vec_id < 2000]
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got, hits = {}, 0
    for r in aq.nearest(vectors).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1560, 100))
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        order = np.lexsort((ids, d))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and np.allclose([f[2] for f in found], [d[ids == f[1]][0] for f in found], rtol=1e-12)
        hits += len({f[1] for f in found} & set(ids[order].tolist()))
    assert hits >= 0.9 * 10 * len(got)
    assert [f[1] for f in got[100]] == list(range(1500, 1510))  # equal distances: the smaller vec_id


def test_few_and_none(spark, vectors):
    few = spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in aq.nearest(few).collect()] == [(100, 1, 1), (100, 2, 2)]
    assert aq.nearest(vectors.where("vec_id < 0")).collect() == []
    assert aq.nearest(vectors.where("vec_id = 100")).collect() == []


def test_search_in_blocks(vectors):
    books, index = aq.build_index(vectors)
    queries = index.where("vec_id % 100 = 0").select("vec_id", "embedding", "row")
    whole, parts = (sorted(tuple(r) for r in aq.search(index, books, queries, block=b).collect()) for b in (1024, 4))
    assert whole == parts


def test_recall_with_a_shortlist_of_a_large_batch(spark):
    """20,000 vectors in one partition, of which 128 a query are reranked as they come: the quantiser has to find them."""
    rng = np.random.default_rng(11)
    centre = rng.normal(size=(200, 24))
    x = centre[rng.integers(0, 200, 20_000)] + 0.6 * rng.normal(size=(20_000, 24))
    docs = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").coalesce(1)
    books, index = aq.build_index(docs, sample=4000)
    got = {}
    for r in aq.search(index, books, index.where("vec_id % 200 = 0").select("vec_id", "embedding", "row"), shortlist=128).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 200):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits / (10 * len(got)) >= 0.9


def test_a_copy_of_the_query_row_is_a_candidate(spark):
    v = [1.0, 2.0]
    rows = spark.createDataFrame([(100, v), (100, v), (3, [1.0, 2.5])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in aq.nearest(rows).orderBy("rank").collect()] == [(100, 1, 100, 0.0), (100, 2, 3, 0.5)]


def test_long_texts_count_features_first(monkeypatch):
    text = "some words \U00010400\U00010401 and more of them " * 3000
    rng = np.random.default_rng(1)
    model = language_id.Model(["a", "b"], rng.normal(size=(language_id.FEATURES, 2)).astype(np.float32), np.zeros(2))
    whole = model.logits(language_id.grams(text))
    monkeypatch.setattr(language_id, "COUNTED", 1 << 60)
    assert np.allclose(whole, model.logits(language_id.grams(text)), atol=1e-5)
