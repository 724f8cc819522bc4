"""A random forest of binary trees: each tree is grown in a Spark task on its own bootstrap rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

TREES, DEPTH, LEAF, SEED = 48, 10, 3, 31


def _best_split(x: np.ndarray, y: np.ndarray, columns: np.ndarray) -> tuple[float, int, float]:
    """Lowest weighted Gini impurity over midpoints of the given columns: (impurity, column, cut)."""
    best = (np.inf, -1, 0.0)
    n = len(y)
    for c in columns:
        order = np.argsort(x[:, c], kind="stable")
        v, t = x[order, c], y[order]
        ones = np.cumsum(t)[:-1]
        k = np.arange(1, n)
        p, q = ones / k, (ones[-1] + t[-1] - ones) / (n - k)
        cost = np.where((v[1:] > v[:-1]) & (k >= LEAF) & (n - k >= LEAF), k * p * (1 - p) + (n - k) * q * (1 - q), np.inf)
        at = int(np.argmin(cost))
        if cost[at] < best[0] - 1e-12:
            best = (float(cost[at]), int(c), float((v[at] + v[at + 1]) / 2))
    return best


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH) -> np.ndarray:
    """Rows (column or -1, cut, left, right, share of ones); row 0 is the root."""
    rows: list[list[float]] = []
    todo = [(np.arange(len(y)), depth, -1, 0)]
    while todo:
        own, left, parent, side = todo.pop()
        me = len(rows)
        rows.append([-1, 0.0, 0, 0, float(y[own].mean()) if len(own) else 0.5])
        if parent >= 0:
            rows[parent][2 + side] = me
        if left == 0 or len(own) < 2 * LEAF or y[own].min() == y[own].max():
            continue
        tried = rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False)
        cost, c, cut = _best_split(x[own], y[own], tried)
        if np.isfinite(cost):
            rows[me][:2] = [c, cut]
            low = x[own, c] <= cut
            todo += [(own[low], left - 1, me, 0), (own[~low], left - 1, me, 1)]
    return np.array(rows)


def train_forest(spark: SparkSession, x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = SEED) -> list[np.ndarray]:
    """``x`` and ``y`` are a bounded sample, which goes to the tasks with their closures."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b["id"]:
                rng = np.random.default_rng(seed * 1000 + int(k))
                rows = rng.integers(0, len(y), len(y))
                yield pd.DataFrame({"id": [k], "tree": [grow(x[rows], y[rows], rng).ravel().tolist()]})

    grown = spark.range(0, trees, 1, min(trees, 12)).mapInPandas(work, "id long, tree array<double>").orderBy("id").collect()
    return [np.array(r["tree"]).reshape(-1, 5) for r in grown]


def predict(forest: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Mean share of ones over the trees."""
    total = np.zeros(len(x))
    for t in forest:
        at = np.zeros(len(x), np.int64)
        while True:
            column = t[at, 0].astype(np.int64)
            inner = column >= 0
            if not inner.any():
                break
            low = x[np.arange(len(x)), np.maximum(column, 0)] <= t[at, 1]
            at = np.where(inner, np.where(low, t[at, 2], t[at, 3]).astype(np.int64), at)
        total += t[at, 4]
    return total / max(1, len(forest))
