"""Quality classifier: regularised quadratic discriminant over document statistics.

Each whole text gives a short vector of transformed statistics (smoothed log rates of
character classes, repetition of words and lines, compressibility). Class means and
covariances come from exact sums over all labelled rows of the learning folds; each
covariance is shrunk towards its scaled diagonal. A score is the difference of the two
classes' log densities, from Mahalanobis distances with cached Cholesky factors, put
through a logistic curve that is calibrated on at most ``CALIBRATION`` labelled rows.

Null texts count as empty; an empty text has statistics of its own and is scored like any
other. Labels without quality or doc_id teach nothing; a doc_id with several labels counts
by their mean, half rounding up. Without labels of both classes the score is the share of
label 1 (0.5 without any). Rows without a doc_id are held out. Repeated rows give repeated
results; other columns are ignored or, in the filter, passed through unchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out, saved

CALIBRATION, SHRINKAGE, THRESHOLD = 20_000, 0.1, 0.7
STATS = 15
_BYTES = np.arange(256)
_is = lambda s: np.isin(_BYTES, list(s.encode()))
#: Bytes of each class, one column per class.
_CLASSES = np.stack([
    (_BYTES >= 97) & (_BYTES <= 122), (_BYTES >= 65) & (_BYTES <= 90), _BYTES >= 128, (_BYTES >= 48) & (_BYTES <= 57), _is(" \t"), _is("\n\r"),
    _is(".,;:'\"()-?"), _is("!"), _is("|"), _is("#$%&*@^~_=+<>{}[]\\/`"), _BYTES < 32,
], axis=1).astype(np.float64)


def _one(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    lower, upper, other, digit, space, line, mark, shout, bar, symbol, _ = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES).tolist()
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    w = len(words)
    rate = lambda c, of: float(np.log((c + 1) / (of + 40)))
    twice = sum(map(str.__eq__, words, words[1:]))
    return [
        float(np.log(n + 8)), rate(upper, n), rate(other, n), rate(digit, n), rate(space, n), rate(line, n), rate(mark, n), rate(shout, n), rate(bar, n), rate(symbol, n),
        rate(twice, w), float(np.log((len(set(words)) + 8) / (w + 8))), float(np.log((len(set(lines)) + 2) / (len(lines) + 2))),
        float(np.log((len(zlib.compress(raw, 1)) + 40) / (n + 40))), float(np.log((lower + upper + other + 8) / (w + 8))),
    ]


def statistics(texts: list[str | None]) -> np.ndarray:
    return np.array([_one(t or "") for t in texts], np.float64).reshape(-1, STATS)


@dataclass
class Model:
    """Class means, inverse Cholesky factors and log terms; empty where a class was not seen."""

    mean: list[np.ndarray]
    whiten: list[np.ndarray]
    offset: list[float]
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, self.low, self.high)
        d = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for m, w, o in zip(self.mean, self.whiten, self.offset, strict=True)]
        return np.clip(d[1] - d[0], -200, 200)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.mean:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 0.1, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        w = p * (1 - p)
        hess = np.array([[(w * margin * margin).sum() + 1e-2, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(hess, [((y - p) * margin).sum(), (y - p).sum()])
        a, b = float(np.clip(a + 0.7 * step[0], 1e-3, 5)), float(np.clip(b + 0.7 * step[1], -20, 20))
    return a, b


def fit(stats: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE, calibration: int = CALIBRATION) -> Model:
    """Learn from ``stats`` (doc_id, x) and ``labels`` (doc_id, quality), learning folds alone."""
    truth = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    rows = stats.where(~held_out(F.col("doc_id"))).join(truth, "doc_id")
    x = [F.col("x")[i] for i in range(STATS)]
    sums = [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(STATS) for j in range(i, STATS)]
    got = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.min(c).alias(f"l{i}") for i, c in enumerate(x)], *[F.max(c).alias(f"h{i}") for i, c in enumerate(x)], *sums).collect()
    by = {r["y"]: r for r in got}
    total = sum(r["n"] for r in got)
    if len(by) < 2 or min(r["n"] for r in got) < 2:
        return Model([], [], [], prior=by[1]["n"] / total if 1 in by else 0.0 if total else 0.5)
    mean, whiten, offset = [], [], []
    for y in (0, 1):
        r, n = by[y], by[y]["n"]
        m = np.array([r[f"m{i}"] for i in range(STATS)]) / n
        s = np.zeros((STATS, STATS))
        for i in range(STATS):
            for j in range(i, STATS):
                s[i, j] = s[j, i] = r[f"s{i}_{j}"] / n - m[i] * m[j]
        diag = np.maximum(np.diag(s), 1e-3)
        s = (1 - shrinkage) * s + np.diag(shrinkage * diag + 1e-3)
        chol = np.linalg.cholesky(s)
        mean.append(m)
        whiten.append(np.linalg.inv(chol))
        offset.append(float(np.log(n / total) - np.log(np.diag(chol)).sum()))
    low, high = (np.array([f(by[y][f"{k}{i}"] for y in (0, 1)) for i in range(STATS)]) for k, f in (("l", min), ("h", max)))
    model = Model(mean, whiten, offset, low, high)
    part = min(1.0, calibration / total)
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part * 1_000_000).select("y", "x").limit(2 * calibration).collect()
    y = np.array([r["y"] for r in sample], float)
    model.slope, model.shift = _calibrate(model.margin(np.array([r["x"] for r in sample])), y)
    return model


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column(1).to_pylist())
        yield pa.record_batch([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "x"])


def document_stats(docs: DataFrame) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(texts.mapInArrow(_stats, "doc_id long, x array<double>"), "stats")


def _scored(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, STATS)
            yield pa.record_batch([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    stats = document_stats(docs)
    out = stats.mapInArrow(_scored(fit(stats, labels)), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; columns as they are.

    Statistics are taken once and saved beside the rows; only texts cross into Python for them, and only they for the scores.
    """
    x, text = fresh(docs, "_x"), F.col("text").cast("string")
    measured = saved(docs.withColumn(x, F.arrow_udf(_measured, "array<double>")(text)), "measured")
    model = fit(measured.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(x).alias("x")), labels)

    def scored(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATS)), pa.float64())

    return measured.where(F.arrow_udf(scored, "double")(F.col(x)) >= threshold).drop(x)


def _measured(texts: pa.Array) -> pa.Array:
    x = statistics(texts.to_pylist())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, STATS), pa.int32()), pa.array(x.ravel())) if len(x) else pa.array([], pa.list_(pa.float64()))

