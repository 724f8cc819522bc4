"""Algebra of formulas in disjunctive form, many at once.

A table of terms has ``formula`` and ``lits``, a sorted array of (var, val) without repeats: a row is a conjunction of ``var = val``.
A formula without rows is false, an empty array is true. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hornfels.storage import keep, materialise, scratch

#: Terms of a formula that are compared within its row, and rows that a task gets.
FEW, ROWS = 64, 250_000


def terms(literals: DataFrame) -> DataFrame:
    """Terms of a table with formula, term, var and val, a row a literal; var null for a term without literals."""
    lit = F.when(F.col("var").isNotNull(), F.struct("var", "val"))
    return conjunctions(literals.groupBy("formula", "term").agg(F.collect_set(lit).alias("lits")))


def conjunctions(rows: DataFrame) -> DataFrame:
    """Terms of a table with ``formula`` and ``lits`` in any order, a row a term."""
    return absorbed(_consistent(rows.select("formula", F.array_sort(F.array_distinct("lits")).alias("lits"))))


def _consistent(rows: DataFrame) -> DataFrame:
    return rows.where(F.size(F.array_distinct("lits.var")) == F.size("lits"))


def absorbed(rows: DataFrame) -> DataFrame:
    """Terms that no shorter term of their formula implies.

    Terms of a formula with FEW at most are one row, within which they are compared. A term of a larger one looks for longer
    ones by that of its literals which the fewest terms of the formula have, so that a literal that all terms share pairs
    nothing. Formulas are dealt to as many tasks as rows ask for, so that a task's memory does not follow the table.
    """
    with scratch(rows.sparkSession):
        rows = materialise(rows.select("formula", "lits"), "lits")
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS + 1)
        dealt = rows.repartition(parts, "formula").distinct()
        size = F.count("*").over(Window.partitionBy("formula"))
        dealt = materialise(dealt.withColumn("size", size), "terms")
        small = dealt.where(F.col("size") <= FEW).groupBy("formula").agg(F.collect_list("lits").alias("all"))
        shorter = lambda t, s: (F.size(s) < F.size(t)) & (F.size(F.array_except(s, t)) == 0)
        least = F.filter("all", lambda t: ~F.exists("all", lambda s: shorter(t, s)))
        return keep(small.select("formula", F.explode(least).alias("lits")).unionByName(_absorbed(dealt.where(F.col("size") > FEW))), "terms")


def _absorbed(rows: DataFrame) -> DataFrame:
    rows = rows.select("formula", "lits")
    true = rows.where(F.size("lits") == 0)
    some = rows.join(true.select("formula"), "formula", "left_anti")
    each = some.select("formula", "lits", F.explode("lits").alias("lit"))
    often = each.groupBy("formula", "lit").agg(F.count("*").alias("n"))
    rare = each.join(often, ["formula", "lit"]).groupBy("formula", "lits").agg(F.min(F.struct("n", "lit")).alias("r"))
    short = rare.select("formula", F.col("r.lit").alias("lit"), F.col("lits").alias("part"))
    implied = each.join(short, ["formula", "lit"]).where((F.size("part") < F.size("lits")) & (F.size(F.array_except("part", "lits")) == 0))
    return some.join(implied.select("formula", "lits").distinct(), ["formula", "lits"], "left_anti").unionByName(true)


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """The disjunction of both formulas of each name."""
    return absorbed(a.select("formula", "lits").unionByName(b.select("formula", "lits")))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """The conjunction of both formulas of each name: every term of one with every term of the other, by definition; contradictions go."""
    pairs = a.select("formula", "lits").join(b.select("formula", F.col("lits").alias("more")), "formula")
    return absorbed(_consistent(pairs.select("formula", F.sort_array(F.array_union("lits", "more")).alias("lits")).distinct()))


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("formula").orderBy(F.size("lits"), "lits")))


def truncated(rows: DataFrame, size: int) -> DataFrame:
    """The first ``size`` terms of each formula, shorter ones first; ``cut`` says that there are more."""
    placed = _placed(rows.select("formula", "lits"))
    more = placed.where(F.col("place") == size + 1).select("formula", F.lit(True).alias("cut"))
    return placed.where(F.col("place") <= size).drop("place").join(more, "formula", "left").withColumn("cut", F.coalesce("cut", F.lit(False)))


def pruned(rows: DataFrame, size: int, kept: DataFrame) -> DataFrame:
    """At most ``size`` terms of each formula, of which one holds in ``kept`` (formula and lits, a row a formula).

    The first terms stay; where none of them holds in the given conjunction, the last one gives way to the first that does. A
    formula of which no term does becomes false.
    """
    placed = _placed(rows.select("formula", "lits"))
    holds = placed.join(kept.select("formula", F.col("lits").alias("given")), "formula").where(F.size(F.array_except("lits", "given")) == 0)
    first = holds.groupBy("formula").agg(F.min("place").alias("m"))
    return placed.join(first, "formula").where((F.col("place") < size) | (F.col("place") == F.greatest("m", F.lit(size)))).select("formula", "lits")
