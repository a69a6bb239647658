"""Gradient-boosted trees fitted on the driver over a small array and compiled to columns.

Logistic loss, Newton leaves, exact splits over the distinct values of each feature.
The fitted trees are a list of nested tuples, so they can be evaluated as a Catalyst
expression (``as_column``) without any Python on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A leaf value, or (feature, threshold, left where value <= threshold, right).
Tree = float | tuple


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> Tree:
    gain, best = 1e-6, None
    total, weight = g.sum(), h.sum()
    score = total * total / (weight + ridge)
    for j in range(x.shape[1]) if depth else ():
        order = np.argsort(x[:, j], kind="stable")
        v, gl, hl = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
        for i in np.flatnonzero(v[1:] > v[:-1]):
            won = gl[i] ** 2 / (hl[i] + ridge) + (total - gl[i]) ** 2 / (weight - hl[i] + ridge) - score
            if won > gain:
                gain, best = won, (j, float((v[i] + v[i + 1]) / 2))
    if best is None:
        return float(total / (weight + ridge))
    left = x[:, best[0]] <= best[1]
    return (*best, _grow(x[left], g[left], h[left], depth - 1, ridge), _grow(x[~left], g[~left], h[~left], depth - 1, ridge))


def evaluate(tree: Tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, cut, left, right = tree
    return np.where(x[:, j] <= cut, evaluate(left, x), evaluate(right, x))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 16, depth: int = 3, rate: float = 0.4, ridge: float = 1.0) -> list[Tree]:
    margin, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, rate * (y - p), p * (1 - p), depth, ridge)
        margin += evaluate(tree, x)
        out.append(tree)
    return out


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic curve over held-out margins."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        w = p * (1 - p) + 1e-4
        hess = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, [((y - p) * margin).sum() - 1e-3 * (a - 1), (y - p).sum()])
        a, b = float(np.clip(a + 0.5 * da, 0.05, 20)), float(np.clip(b + 0.5 * db, -20, 20))
    return a, b


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest calibrated score at and above which ``precision`` holds."""
    order = np.argsort(-p, kind="stable")
    good = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ok = np.flatnonzero(good >= precision)
    return float(p[order][ok[-1]]) if len(ok) else 1.1


def as_column(trees: list[Tree], feature: Callable[[int], Column]) -> Column:
    def one(tree: Tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        j, cut, left, right = tree
        return F.when(feature(j) <= cut, one(left)).otherwise(one(right))

    total = one(trees[0])
    for tree in trees[1:]:
        total = total + one(tree)
    return total
