"""Evidence from traces, labels and similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positive_edges(log: DataFrame, flag: Column) -> DataFrame:
    """Distinct (src, dst) that some run's log flags; columns pid, seq, src, dst."""
    return log.where(flag).select("src", "dst").distinct()


def negative_counts(log: DataFrame, flag: Column, seen: Column) -> DataFrame:
    """(src, dst) and in how many runs it was not flagged although its source had been seen earlier in that run.

    ``seen`` says whether a row shows its own source; a window over the run's rows carries that on.
    """
    before = Window.partitionBy("pid", "src").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = log.withColumn("_seen", F.max(seen.cast("int")).over(before)).where(~flag & (F.col("_seen") == 1))
    return rows.select("pid", "src", "dst").distinct().groupBy("src", "dst").agg(F.count("*").alias("n"))


def confidences(log: DataFrame, flag: Column) -> DataFrame:
    """(src, dst) and the share of all runs that flag it."""
    runs = log.select("pid").distinct().agg(F.count("*").alias("runs"))
    hits = log.where(flag).select("pid", "src", "dst").distinct().groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = runs.first()["runs"] or 1
    return hits.select("src", "dst", (F.col("n") / F.lit(float(total))).alias("confidence"))


def negative_confidence(counts: DataFrame, p: float) -> DataFrame:
    """1 - (1 - p)^n for each row's ``n``; p is the mean positive confidence."""
    return counts.withColumn("confidence", 1 - F.pow(F.lit(1 - p), F.col("n")))


def logistic(x: Column, offset: float = 0.414, slope: float = 2.167) -> Column:
    """Probability by a logistic curve; the defaults are fixed values of the calibration."""
    return 1 / (1 + F.exp(-(F.lit(offset) + F.lit(slope) * x)))


def log_loss(p: Column, truth: Column) -> Column:
    return -F.when(truth, F.log(p)).otherwise(F.log(1 - p))


def fit_logistic(rows: DataFrame, x: str, truth: str, rounds: int = 25) -> tuple[float, float]:
    """Offset and slope by Newton's method; each step is one aggregation whose five sums reach the driver. Without rows both are 0."""
    a = b = 0.0
    for _ in range(rounds):
        p = logistic(F.col(x), a, b)
        w, e = p * (1 - p), F.col(truth).cast("double") - p
        r = rows.agg(F.sum(w).alias("h0"), F.sum(w * F.col(x)).alias("h1"), F.sum(w * F.col(x) ** 2).alias("h2"), F.sum(e).alias("g0"), F.sum(e * F.col(x)).alias("g1")).first()
        if r["h0"] is None:
            return a, b
        step = np.linalg.solve(np.array([[r["h0"], r["h1"]], [r["h1"], r["h2"]]]) + 1e-9 * np.eye(2), [r["g0"], r["g1"]])
        a, b = a + float(step[0]), b + float(step[1])
        if np.abs(step).max() < 1e-10:
            return a, b
    raise RuntimeError(f"the curve did not settle in {rounds} rounds; classes that a threshold tells apart have none")


def cosine(a: str, b: str) -> Column:
    """Similarity of two embedding columns, by Arrow batches; null where one is null or zero."""

    def work(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for u, v in zip(x, y, strict=True):
            if u is None or v is None:
                out.append(None)
                continue
            n = float(np.linalg.norm(u) * np.linalg.norm(v))
            out.append(float(np.dot(u, v)) / n if n else None)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(work, "double")(F.col(a), F.col(b))


def odds_of_cosine(c: Column) -> Column:
    """exp(3c - 2): fixed values of the conversion."""
    return F.exp(3 * c - 2)
