"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of 2 and 3 characters (letters in lower case, anything else a space) are hashed to
``FEATURES`` columns. Document frequencies are exact counts over all documents of the
learning folds. Weights are learnt by follow-the-regularised-leader with elastic-net
penalties on at most about ``SAMPLE`` labelled documents, about as many of each of the ``SAMPLE`` most frequent languages
(others are not learnt); a fifth of them sets the temperature of the softmax instead. Their n-grams are counted on
the executors: what comes to the driver is at most six bytes a feature and sampled document, never a text. Values are shares of a text's n-grams
times inverse document frequency, so a prediction is one gather and one sum over a
whole text.

Texts that are null or have no letter are ``und`` with score 1; if nothing can be learnt all
are ``und`` (score 0 where the text has letters). Rows without a doc_id are held out.
Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import COUNT_ROWS, count_rows, held_out, summed

FEATURES, SAMPLE, EPOCHS = 1 << 16, 4000, 3
ALPHA, BETA, L1, L2, SCALE = 0.5, 0.1, 0.02, 0.01, 100.0
UNKNOWN = "und"
#: Texts with so many n-grams have them counted by feature before weights are looked up, which bounds the memory.
COUNTED = 1 << 14
_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code points of the basic plane: letters as themselves, the rest as spaces."""
    if not _table:
        _table.append(np.array([c if chr(c).isalpha() else 32 for c in range(1 << 16)], np.uint32))
    return _table[0]


def grams(text: str) -> np.ndarray | None:
    """Hashed n-grams at all positions; None without a letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    high = points >= 1 << 16
    p = _letters()[np.where(high, 32, points)]
    if high.any():
        kinds, which = np.unique(points[high], return_inverse=True)
        p[high] = np.where(np.array([chr(c).isalpha() for c in kinds.tolist()])[which], points[high], 32)
    if (p == 32).all():
        return None
    p = p[np.concatenate([[True], (p[1:] != 32) | (p[:-1] != 32)])].astype(np.uint32)  # one space between words
    two = p[:-1] * np.uint32(0x9E3779B1) + p[1:] * np.uint32(0x85EBCA77)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + p[2:] * np.uint32(0x27D4EB2F)
    both = np.concatenate([two * np.uint32(0x165667B1), three])
    return ((both ^ (both >> np.uint32(13))) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, documents = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            if (g := grams(text.as_py() or "")) is not None:
                seen = np.zeros(FEATURES, bool)
                seen[g] = True
                total += seen
                documents += 1
    yield count_rows(np.concatenate([total, np.array([documents] + [0] * 63)]))


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # by feature and language, idf and scale included
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, g: np.ndarray) -> np.ndarray:
        if len(g) < COUNTED:
            return self.bias + self.weights[g].sum(0, dtype=np.float64) / len(g)
        n = np.bincount(g, minlength=len(self.weights))
        f = np.flatnonzero(n)
        return self.bias + n[f] @ self.weights[f].astype(np.float64) / len(g)

    def predict(self, text: str | None) -> tuple[str, float]:
        g = grams(text or "")
        if g is None:
            return UNKNOWN, 1.0
        if not self.langs:
            return UNKNOWN, 0.0
        z = self.logits(g) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def _solve(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def counted(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The features of a text and how often it has each; None without a letter."""
    if (g := grams(text)) is None:
        return None
    f, n = np.unique(g, return_counts=True)
    return f.astype(np.uint16), n.astype(np.uint32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counted(t.as_py()) for t in batch.column(1)]
        some = pa.array([c is not None for c in found])
        columns = [pa.array([c[i].tobytes() for c in found if c is not None], pa.binary()) for i in (0, 1)]
        yield pa.record_batch([batch.column(0).filter(some), batch.column(2).filter(some), *columns], ["doc_id", "lang", "features", "counts"])


def train(rows: list[tuple[str, str]], idf: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Learn from (text, lang) rows, in the order given; every fifth row sets the temperature."""
    return learn([(c, lang) for text, lang in rows if (c := counted(text)) is not None], idf, epochs)


def learn(rows: list[tuple[tuple[np.ndarray, np.ndarray], str]], idf: np.ndarray, epochs: int = EPOCHS) -> Model:
    """The same from rows whose n-grams are counted."""
    data = [(f.astype(np.int64), SCALE * idf[f] * n / n.sum(), lang) for (f, n), lang in rows]
    langs = sorted({lang for *_, lang in data})
    if not langs:
        return Model([], np.zeros((0, 0)), np.zeros(0))
    k = len(langs)
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))
    taught, tune = [d for i, d in enumerate(data) if i % 5] or data, data[::5]
    order = np.random.default_rng(4)
    for _ in range(epochs):
        for i in order.permutation(len(taught)):
            f, v, lang = taught[i]
            at, x = np.append(f, FEATURES), np.append(v, 1.0)
            w = _solve(z[at], n[at])
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[langs.index(lang)] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = _solve(z, n)
    model = Model(langs, (SCALE * idf[:, None] * w[:-1]).astype(np.float32), w[-1])
    scores = np.array([w[-1] + v @ w[:-1][f] for f, v, _ in tune])
    truth = np.array([langs.index(lang) for *_, lang in tune])

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]))

    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``docs`` (doc_id, text, lang), learning folds alone."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df = summed(rows.select("text").mapInArrow(_frequencies, COUNT_ROWS), FEATURES + 64)
    idf = np.log((1 + df[FEATURES]) / (1 + df[:FEATURES])) + 1
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    each = max(1, sample // max(1, len(sizes)))
    shares = [(lang, int(min(1.0, each / n) * 1_000_000_000)) for lang, n in sizes.items()]  # by a hash of doc_id; at most ``sample`` rows
    table = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share long"))
    picked = rows.join(table, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000)) < F.col("share")).select("doc_id", "text", "lang").limit(2 * sample)
    got = picked.mapInArrow(_counts, "doc_id long, lang string, features binary, counts binary").collect()
    ordered = sorted(got, key=lambda r: (r["doc_id"], bytes(r["features"]), bytes(r["counts"])))
    return learn([((np.frombuffer(r["features"], np.uint16), np.frombuffer(r["counts"], np.uint32)), r["lang"]) for r in ordered], idf)


def _predicted(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    out = docs.select("doc_id", "text").mapInArrow(_predicted(fit(docs, sample)), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
