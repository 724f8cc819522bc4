"""Ranked lists and their measures. Ranks come from range partitions and their sizes, not from one window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornfels.storage import materialise


def ranked(rows: DataFrame, order: list[Column], truth: str | None = None) -> DataFrame:
    """Adds ``rank`` from 1 in ``order``, which must be total, and ``trues``: the true rows up to here.

    Rows are range-partitioned once and written, so that places are the same in both passes; a task holds
    one range, and the sums over ranges have a row a partition.
    """
    placed = rows.withColumn("_true", (F.col(truth).cast("boolean") if truth else F.lit(False)).cast("long"))
    placed = materialise(placed.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    sums = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(F.coalesce("_true", F.lit(0))).alias("_t"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"))
    own = Window.partitionBy("_part").orderBy(*order)
    out = placed.withColumn("_r", F.row_number().over(own)).withColumn("_c", F.sum(F.coalesce("_true", F.lit(0))).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(sums, "_part").withColumns({"rank": F.col("_n0") + F.col("_r"), "trues": F.col("_t0") + F.col("_c")})
    return out.select(*rows.columns, "rank", *(["trues"] if truth else []))


def alarm_order(label: str, confidence: str, tuple_: str) -> list[Column]:
    """Labelled true first, then unlabelled, then false; by confidence, NaN as 0 but before a real 0; ties by tuple."""
    c = F.col(confidence)
    return [F.desc(F.coalesce(F.col(label), F.lit(0))), F.desc(F.when(F.isnan(c), 0.0).otherwise(c)), F.desc(F.isnan(c)), F.asc(tuple_)]


def measures(alarms: DataFrame, truth: str = "truth") -> DataFrame:
    """One row of measures of ``ranked`` alarms.

    A true alarm of rank r is the trues-th true one, so r - trues false ones stand above it.
    """
    t = F.col(truth)
    above = F.sum(F.when(t, F.col("rank") - F.col("trues")))
    n_true, n_false = F.sum(t.cast("long")), F.sum((~t).cast("long"))
    return alarms.agg(
        F.coalesce(above, F.lit(0)).alias("inversions"), (n_true * n_false).alias("peak"), F.sum(F.when(t, F.log(F.lit(2.0)) / F.log(F.col("rank") + 1.0))).alias("dcg"),
        (1 - above / F.when(n_true * n_false > 0, n_true * n_false)).alias("auc"), F.avg(F.when(t, F.col("rank"))).alias("mean_rank"), F.max(F.when(t, F.col("rank"))).alias("lowest_rank"),
    )


def median_rank(alarms: DataFrame, truth: str = "truth") -> DataFrame:
    """Median of the true alarms' ranks, the mean of the middle two if they are even in number."""
    n = alarms.agg(F.sum(F.col(truth).cast("long"))).first()[0] or 0
    return alarms.where(F.col(truth) & F.col("trues").isin((n + 1) // 2, n // 2 + 1)).agg(F.avg("rank").alias("median_rank"))


def curve(alarms: DataFrame, truth: str = "truth") -> DataFrame:
    """For each rank: false and true alarms so far, and the share of true ones."""
    return alarms.select("rank", (F.col("rank") - F.col("trues")).alias("falses"), "trues", (F.col("trues") / F.col("rank")).alias("precision"))


def threshold_accuracy(rows: DataFrame, confidence: str, truth: str) -> DataFrame:
    """p = 1 to 99 and the share of rows that are right if confidence in per cent of p or more means true."""
    share = rows.groupBy((F.floor(F.col(confidence) * 100)).cast("int").alias("c")).agg(F.sum(F.col(truth).cast("long")).alias("t"), F.count("*").alias("n"))
    steps = share.select(F.explode(F.sequence(F.lit(1), F.lit(99))).alias("p"), "c", "t", "n")
    right = F.when(F.col("c") >= F.col("p"), F.col("t")).otherwise(F.col("n") - F.col("t"))
    return steps.groupBy("p").agg((F.sum(right) / F.sum("n")).alias("accuracy"))


def confusion(rows: DataFrame, said: Column, truth: Column) -> DataFrame:
    """Counts of tp, fp, fn, tn; precision and recall are 1 where nothing was said or is true."""
    n = lambda c: F.sum(c.cast("long"))
    sums = rows.agg(n(said & truth).alias("tp"), n(said & ~truth).alias("fp"), n(~said & truth).alias("fn"), n(~said & ~truth).alias("tn"))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.col(a) / (F.col(a) + F.col(b)))
    return sums.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})
