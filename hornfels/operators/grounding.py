"""Grounding of only those weighted clauses that assignments violate."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornfels.operators.markov import evaluation
from hornfels.storage import materialise


def lazily(first: DataFrame, violated: Callable[[DataFrame], DataFrame], solver: Callable[[DataFrame], DataFrame], rounds: int = 100) -> tuple[DataFrame, DataFrame, int]:
    """An assignment of least cost that grounds no more than it must: its true ``tuple``s, the clauses grounded, the rounds.

    ``first`` has ground clauses to begin with. ``violated`` gets the true tuples and returns all ground clauses that these
    violate, by joins and anti joins with the assignment; ids name a clause alike in every round. ``solver`` gets ground clauses and
    returns true tuples. A round solves what is grounded and adds what the solution violates. It ends

    * when nothing new is violated: the last assignment is best;
    * when the last but one assignment violated nothing hard outside, and its cost with all it violated is what the clauses
      grounded since cost at least: then that one is best.

    Both hold for solvers that are exact. Clauses that are still violated after ``rounds`` are an error.
    """
    columns = ["clause_id", "weight", "tuple", "positive"]
    ground = materialise(first.select(columns), "ground")
    before, bound = None, math.inf
    for k in range(1, rounds + 1):
        true = materialise(solver(ground).select("tuple").distinct(), "true")
        cost = evaluation(ground, true).first()
        if before is not None and cost["violations"] == 0 and math.isclose(cost["cost"], bound, rel_tol=1e-12, abs_tol=1e-12):
            return before, ground, k
        new = materialise(violated(true).select(columns).join(ground.select("clause_id").distinct(), "clause_id", "left_anti"), "new")
        if new.isEmpty():
            return true, ground, k
        added = new.select("clause_id", "weight").distinct().agg(F.max(F.isnull("weight")).alias("hard"), F.sum(F.abs("weight")).alias("w")).first()
        before, bound = true, math.inf if added["hard"] or cost["violations"] else cost["cost"] + added["w"]
        ground = materialise(ground.unionByName(new), "ground")
    raise RuntimeError(f"clauses are still violated after {rounds} rounds")
