"""Regularised quadratic discriminant over transformed document statistics.

Statistics of whole texts are computed once, in numpy by batches, and written. Class means and covariances
come from sums of all labelled rows, added up by Spark; the covariances are shrunk towards the pooled one and
towards its diagonal, and factorised once (Cholesky). A score is the difference of two Mahalanobis
log-densities, passed through a logistic curve that is fitted on a histogram of the training rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornfels.llm.common import crc_of_id, free_names, platt, read_table, restored, sigmoid, stashed
from hornfels.storage import materialise

STATISTICS = (
    "log_bytes", "log_words", "word_length", "longest", "upper", "digit", "symbol", "pipe", "bang", "stop", "other_ascii",
    "non_ascii", "lines", "adjacent", "distinct", "dup_lines", "entropy",
)
POOL, DIAGONAL = 0.1, 0.05
#: Width of a bin of the calibration histogram, on the scale of asinh(log-density difference).
BIN = 0.05

_CLASSES = np.full(256, 10, np.uint8)
for _k, _chars in enumerate((b" \t\r\x0b\x0c", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b"#*$%&<>", b"|", b"!", b".,;:?")):
    _CLASSES[list(_chars)] = _k
_CLASSES[128:] = 9


def statistics_of(text: str) -> list[float]:
    """One row of STATISTICS. An empty text has zeros and the lowest logarithms."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(data, minlength=256)
    kinds = np.bincount(_CLASSES, weights=counts, minlength=11)
    words = text.split()
    n, size = len(words), max(1.0, float(data.size))
    solid = max(1.0, float(data.size - kinds[0] - kinds[1]))
    lines = [x for x in text.split("\n") if x]
    p = counts[counts > 0] / size
    root = np.sqrt(kinds[[3, 4, 5, 6, 7, 8, 10, 9]] / solid)
    adjacent = sum(map(str.__eq__, words, words[1:])) / n if n else 0.0
    return [
        float(np.log1p(data.size)), float(np.log1p(n)), float(np.log1p(solid / max(1, n))), float(np.log1p(max(map(len, words), default=0))),
        *map(float, root), float(np.sqrt(len(lines) / max(1, n))), adjacent**0.5, float(np.arcsin(np.sqrt(len(set(words)) / n if n else 1.0))),
        (1 - len(set(lines)) / len(lines) if lines else 0.0) ** 0.5, float(-(p * np.log2(p)).sum()) if data.size else 0.0,
    ]


def statistics(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """The ``keep`` columns and ``stats``, an array in the order of STATISTICS; null text counts as empty.

    A row each, repeats included; ``stats`` has an underscore behind it where ``keep`` has that name.
    """

    def measure(values: pd.Series) -> pd.Series:
        return pd.Series([statistics_of(v or "") for v in values])

    rows = docs.select(*stashed(keep), F.pandas_udf(measure, "array<double>")(F.col(text)).alias("stats"))
    return restored(rows, keep, "stats")


@dataclass(frozen=True)
class Discriminant:
    mean: np.ndarray  # (2, d)
    factor: np.ndarray  # (2, d, d): inverses of the Cholesky factors
    offset: np.ndarray  # (2,): log prior less half the log determinant
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, with priors."""
        logs = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.mean, self.factor, self.offset, strict=True)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * np.arcsinh(self.difference(x)) + self.shift)


def fit_discriminant(n: np.ndarray, total: np.ndarray, square: np.ndarray, pool: float = POOL, diagonal: float = DIAGONAL) -> Discriminant:
    """From each class's count, sums and sums of products. A class without rows gets the pooled moments."""
    d = total.shape[1]
    everything = max(1.0, n.sum())
    centre = total.sum(0) / everything
    scatter = square.sum(0) / everything - np.outer(centre, centre)
    mean = np.array([t / c if c else centre for t, c in zip(total, n, strict=True)])
    own = np.array([s / c - np.outer(m, m) if c > d else scatter for s, c, m in zip(square, n, mean, strict=True)])
    within = (own * n[:, None, None]).sum(0) / everything if n.sum() else np.eye(d)
    factor, offset = [], []
    for k in range(2):
        cov = (1 - pool) * own[k] + pool * within
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + 1e-6 * np.eye(d)
        low = np.linalg.cholesky(cov)
        factor.append(np.linalg.inv(low))
        offset.append(np.log((n[k] + 1) / (everything + 2)) - np.log(np.diag(low)).sum())
    return Discriminant(mean, np.array(factor), np.array(offset))


def train(stats: DataFrame, label: str = "label") -> Discriminant:
    """Fits on all rows of ``stats`` whose label is 0 or 1; what reaches the driver has a fixed size.

    The labelled rows are written once, for the sums and for the histogram.
    """
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = materialise(stats.where(F.col(label).isin(0, 1)).select(label, "stats"), "labelled")
    flat = rows.select(label, *[F.col("stats")[i].alias(f"x{i}") for i in range(d)])
    sums = flat.groupBy(label).agg(
        F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(d)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in pairs]
    )
    n, total, square = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in sums.collect():
        k = int(r[label])
        n[k], total[k] = r["n"], [r[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            square[k, i, j] = square[k, j, i] = r[f"q{i}_{j}"]
    model = fit_discriminant(n, total, square)

    def bins(values: pd.Series) -> pd.Series:
        return pd.Series(np.round(np.arcsinh(model.difference(np.stack(values.to_list()))) / BIN)) if len(values) else pd.Series([], dtype="float64")

    counts = rows.select(F.pandas_udf(bins, "double")("stats").alias("bin"), F.col(label).cast("int").alias("y")).groupBy("bin", "y").count().collect()
    if len({r["y"] for r in counts}) < 2:
        return model
    slope, shift = platt(np.array([r["bin"] * BIN for r in counts]), np.array([r["y"] for r in counts]), np.array([r["count"] for r in counts], float))
    return Discriminant(model.mean, model.factor, model.offset, max(slope, 1e-3), shift)


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """Adds ``score``, 0 to 1; with underscores behind its name where ``stats`` has such a column."""

    def of(values: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(values.to_list()))) if len(values) else pd.Series([], dtype="float64")

    return stats.withColumn(*free_names(stats.columns, "score"), F.pandas_udf(of, "double")("stats"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; rows of remainder 0 are held out of training. An id with several labels counts by each."""
    held = crc_of_id(F.col("doc_id")) % 5 == 0
    stats = materialise(statistics(read_table(spark, sf_dir, "documents"), "text", "doc_id").withColumn("held_out", held), "stats")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~held)
    model = train(stats.join(labels, "doc_id"))
    return score(stats, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
