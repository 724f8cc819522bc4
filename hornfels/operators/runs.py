"""Statistics across runs and benchmarks: quantiles of ranks with timeouts, padded curves, ratios, ancestors in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_quantiles(ranks: DataFrame, runs: DataFrame) -> DataFrame:
    """For each ``bench``: complete runs and their mean median and mean 90th-percentile rank, null if none is complete.

    ranks(bench, run, rank) of true alarms, runs(bench, run, expected): a run is complete if it ranks as many as
    expected. Of ``n`` ranks in order the median is at place floor(n / 2 + 0.5) and the percentile at
    floor(n - n / 10 + 0.5), from 1. A window holds the true alarms of one run.
    """
    own = Window.partitionBy("bench", "run")
    placed = ranks.withColumn("k", F.row_number().over(own.orderBy("rank"))).withColumn("n", F.count("*").over(own))
    at = lambda x: F.greatest(F.lit(1), F.floor(x)).cast("long")
    of = placed.groupBy("bench", "run").agg(
        F.max("n").alias("n"), F.max(F.when(F.col("k") == at(F.col("n") / 2 + 0.5), F.col("rank"))).alias("median"),
        F.max(F.when(F.col("k") == at(F.col("n") - F.col("n") / 10 + 0.5), F.col("rank"))).alias("high"),
    )
    whole = runs.join(of, ["bench", "run"], "left").withColumn("done", F.col("n") == F.col("expected"))
    done = lambda c: F.avg(F.when(F.col("done"), F.col(c)))
    return whole.groupBy("bench").agg(F.count(F.when(F.col("done"), 1)).alias("complete"), done("median").alias("median"), done("high").alias("high"))


def padded_curve(curve: DataFrame, n_true: int, n_false: int) -> DataFrame:
    """Corners (falses, trues) of a curve (rank, falses, trues) completed by all alarms it lacks: true ones first, then false ones."""
    last = curve.agg(F.coalesce(F.max("trues"), F.lit(0)).alias("t"), F.coalesce(F.max("falses"), F.lit(0)).alias("f"))
    ends = last.select(F.explode(F.array(F.struct(F.col("f").alias("falses"), F.greatest(F.col("t"), F.lit(n_true)).alias("trues")), F.struct(F.greatest(F.col("f"), F.lit(n_false)).alias("falses"), F.greatest(F.col("t"), F.lit(n_true)).alias("trues")))).alias("x"))
    return curve.select(F.col("falses").cast("long"), F.col("trues").cast("long")).union(ends.select(F.col("x.falses").cast("long"), F.col("x.trues").cast("long"))).distinct()


def padded_auc(alarms: DataFrame, n_true: int, n_false: int, truth: str = "truth") -> DataFrame:
    """Area under the padded curve of ``ranked`` alarms, as a share of all pairs; an aggregate, without the curve."""
    t = F.col(truth)
    sums = alarms.agg(F.coalesce(F.sum(t.cast("long")), F.lit(0)).alias("t"), F.coalesce(F.sum((~t).cast("long")), F.lit(0)).alias("f"), F.coalesce(F.sum(F.when(~t, F.col("trues"))), F.lit(0)).alias("under"))
    all_true, all_false = F.greatest(F.col("t"), F.lit(n_true)), F.greatest(F.col("f"), F.lit(n_false))
    return sums.select(((F.col("under") + (all_false - F.col("f")) * all_true) / F.when(all_true * all_false > 0, all_true * all_false)).alias("auc"))


def anti_yield(curve: DataFrame) -> DataFrame:
    """rank and the share of false alarms among those inspected so far."""
    return curve.select("rank", (F.col("falses") / F.col("rank")).alias("false_share"))


def against_baseline(values: DataFrame, baseline: str) -> DataFrame:
    """bench, kind and the ratio of its ``value`` to that of the kind ``baseline``; null where that is null or zero."""
    base = values.where(F.col("kind") == baseline).select("bench", F.col("value").alias("_b"))
    return values.join(base, "bench", "left").select("bench", "kind", (F.col("value") / F.when(F.col("_b") != 0, F.col("_b"))).alias("ratio"))


def short_number(x: Column) -> Column:
    """Three significant digits with k or m for thousands and millions."""
    scaled = F.when(F.abs(x) >= 1e6, x / 1e6).when(F.abs(x) >= 1e3, x / 1e3).otherwise(x)
    digits = F.when(F.abs(scaled) >= 100, F.round(scaled, 0)).when(F.abs(scaled) >= 10, F.round(scaled, 1)).otherwise(F.round(scaled, 2))
    text = F.regexp_replace(F.regexp_replace(digits.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.concat(text, F.when(F.abs(x) >= 1e6, F.lit("m")).when(F.abs(x) >= 1e3, F.lit("k")).otherwise(F.lit("")))


def bench_summary(steps: DataFrame) -> DataFrame:
    """For each ``bench``: mean rank of true alarms at step 0, steps taken, and true alarms found of those there are.

    steps(bench, step, tuple, rank, truth) has a row for each alarm and step; an alarm is found once it ranks first.
    """
    first = F.col("step") == 0
    return steps.groupBy("bench").agg(
        F.avg(F.when(first & F.col("truth"), F.col("rank"))).alias("true_rank"), (F.max("step") + 1).alias("iterations"),
        F.count_distinct(F.when(F.col("truth") & (F.col("rank") == 1), F.col("tuple"))).alias("found"), F.count(F.when(first & F.col("truth"), 1)).alias("bugs"),
    )


def component_sizes(roots: DataFrame, links: DataFrame, bugs: DataFrame) -> DataFrame:
    """root, nodes, edges and bugs of each component; roots(node, root), links(u, v), bugs(node)."""
    size = roots.groupBy("root").agg(F.count("*").alias("nodes"))
    edges = links.select("u", "v").distinct().join(roots.withColumnRenamed("node", "u"), "u").groupBy("root").agg(F.count("*").alias("edges"))
    bad = roots.join(bugs.select("node").distinct(), "node", "left_semi").groupBy("root").agg(F.count("*").alias("bugs"))
    return size.join(edges, "root", "left").join(bad, "root", "left").select("root", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("bugs", F.lit(0)).alias("bugs"))


def common_ancestors(ancestors: DataFrame, alarms: DataFrame) -> DataFrame:
    """(a, b, shared, lacking) for pairs of ``alarms`` that share an ancestor or are equal: ancestors of both, and of b alone.

    ancestors(tuple, ancestor). Pairs meet on their ancestors; alarms without one in common have no row.
    """
    own = ancestors.join(alarms.select("tuple").distinct(), "tuple", "left_semi").select("tuple", "ancestor").distinct()
    size = own.groupBy(F.col("tuple").alias("b")).agg(F.count("*").alias("n"))
    both = own.toDF("a", "x").join(own.toDF("b", "x"), "x").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return both.join(size, "b").select("a", "b", "shared", (F.col("n") - F.col("shared")).alias("lacking"))


def sampled_runs(runs: DataFrame, ratio: float, seed: int) -> DataFrame:
    """int(ratio * n) + 1 of the ``run``s, at most all, by a seeded hash: the same in every rerun."""
    n = runs.select("run").distinct().count()
    return runs.select("run").distinct().orderBy(F.xxhash64(F.lit(seed), "run"), "run").limit(min(n, int(ratio * n) + 1))


def noisy_labels(labels: DataFrame, keep: float, seed: int) -> DataFrame:
    """``tuple`` and ``value``, kept with probability ``keep`` and else drawn anew at the share of true ones, by a seeded hash."""
    share = labels.agg(F.avg(F.col("value").cast("double"))).first()[0] or 0.0
    unit = lambda s: (F.shiftrightunsigned(F.xxhash64(F.lit(s), "tuple"), 11) / F.lit(float(1 << 53))).cast("double")
    return labels.select("tuple", F.when(unit(seed) < keep, F.col("value")).otherwise(unit(seed + 1) < F.lit(share)).alias("value"))
