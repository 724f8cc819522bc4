"""Provenance: the grounded instances of rules as a table of clauses.

A clause table has ``clause_id``, ``rule``, ``head`` and one row for each body literal in ``lit``; a clause
without body has one row whose ``lit`` is null. Tuples are written ``name(v1,v2)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornfels.operators.fixpoint import union_all


def written(name: str, *terms: str | int) -> Column:
    """A tuple as text; strings are variables, numbers constants."""
    return F.concat(F.lit(f"{name}("), F.concat_ws(",", *[F.col(t).cast("string") if isinstance(t, str) else F.lit(str(t)) for t in terms]), F.lit(")"))


def named(rule: str, *variables: str) -> Column:
    """A clause's name: the rule and all its variables."""
    return F.concat(F.lit(f"{rule}["), F.concat_ws(",", *[F.col(c).cast("string") for c in sorted(variables)]), F.lit("]"))


def wide(rows: DataFrame, rule: str, head: Column, body: list[Column], distinct: bool = False) -> DataFrame:
    """``instrument`` with a row a clause, its literals in the array ``lits``."""
    rows = rows if distinct else rows.distinct()
    return rows.select(named(rule, *rows.columns).alias("clause_id"), F.lit(rule).alias("rule"), head.alias("head"), F.array(*body).alias("lits"))


def instrument(rows: DataFrame, rule: str, head: Column, body: list[Column], distinct: bool = False) -> DataFrame:
    """Clauses of one rule from its joined body with all variables; negated literals are left out of ``body`` by convention.

    A clause is named by the rule and all its variables, so equal instances are one clause; ``distinct`` says that ``rows`` have none.
    """
    return wide(rows, rule, head, body, distinct).select("clause_id", "rule", "head", F.explode_outer("lits").alias("lit"))


def lookup(clauses: DataFrame, tuples: DataFrame) -> DataFrame:
    """All clauses that derive the given ``tuple``s."""
    return clauses.join(tuples.select(F.col("tuple").alias("head")).distinct(), "head", "left_semi")


def rule_counts(clauses: DataFrame) -> DataFrame:
    return clauses.select("clause_id", "rule").distinct().groupBy("rule").agg(F.count("*").alias("n"))


def without_last_duplicates(clauses: DataFrame) -> DataFrame:
    """Of clauses with the same head and literals under several rules the last rule's name stays."""
    sets = clauses.groupBy("clause_id", "rule", "head").agg(F.sort_array(F.collect_set("lit")).alias("lits"))
    last = sets.groupBy("head", "lits").agg(F.max_by(F.struct("clause_id", "rule"), F.struct("rule", "clause_id")).alias("c"))
    return last.select("c.clause_id", "c.rule", "head", F.explode_outer("lits").alias("lit"))


def last_names(rules: dict[str, DataFrame]) -> DataFrame:
    """``without_last_duplicates`` before clauses are written: the variables of each instance and its last ``rule``.

    ``rules`` has the joined body of each rule, all with the same variables in the same head and literals. Instances are compared
    by their variables, which are all that is sorted or sent, and text is made of those that stay only.
    """
    names = sorted(rules)
    variables = rules[names[0]].columns
    rows = union_all([rules[name].select(*variables, F.lit(k).alias("_rule")) for k, name in enumerate(names)])
    last = rows.groupBy(*variables).agg(F.max("_rule").alias("_rule"))
    return last.select(*variables, F.element_at(F.lit(names), F.col("_rule") + 1).alias("rule"))
