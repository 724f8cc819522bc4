"""Weighted clauses over Boolean tuples: evaluation, and search for an assignment of low cost.

A table of ground clauses has ``clause_id``, ``weight`` (null for hard) and a row for each literal: ``tuple``
and ``positive``. An assignment is the table of its true ``tuple``s.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornfels.operators.components import components
from hornfels.operators.elimination import eliminate
from hornfels.operators.fixpoint import union_all
from hornfels.storage import materialise

#: Tuples up to which a component is solved exactly, and flips of the search beyond, where that is asked for.
EXACT, FLIPS, SEED = 14, 20_000, 41


def satisfied(clauses: DataFrame, true: DataFrame) -> DataFrame:
    """clause_id, weight and ``ok``: some positive literal is true or some negative one is not."""
    marked = clauses.join(true.select("tuple", F.lit(True).alias("_t")).distinct(), "tuple", "left")
    good = F.coalesce("_t", F.lit(False)) == F.col("positive")
    return marked.groupBy("clause_id", "weight").agg(F.max(good).alias("ok"))


def evaluation(clauses: DataFrame, true: DataFrame) -> DataFrame:
    """One row: hard violations, cost (violated positive or satisfied negative weights) and objective (satisfied soft weight)."""
    s = satisfied(clauses, true)
    w, ok = F.col("weight"), F.col("ok")
    bad = ((w > 0) & ~ok) | ((w < 0) & ok)
    return s.agg(
        F.sum((w.isNull() & ~ok).cast("long")).alias("violations"), F.coalesce(F.sum(F.when(bad, F.abs(w))), F.lit(0.0)).alias("cost"),
        F.coalesce(F.sum(F.when(w.isNotNull() & ok, w)), F.lit(0.0)).alias("objective"),
    )


def _penalty(x: np.ndarray, clauses: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Cost of each row of assignments ``x``."""
    total = np.zeros(len(x))
    for atoms, positive, weight in clauses:
        ok = (x[:, atoms] == positive).any(1)
        total += np.where(ok, max(0.0, -weight), max(0.0, weight))
    return total


def _search(n: int, clauses: list[tuple[np.ndarray, np.ndarray, float]], rng: np.random.Generator, flips: int) -> np.ndarray:
    if n <= EXACT:
        x = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(bool)
        return x[int(np.argmin(_penalty(x, clauses)))]
    x = np.zeros(n, bool)
    own: list[list[int]] = [[] for _ in range(n)]
    for k, (atoms, _, _) in enumerate(clauses):
        for a in atoms:
            own[a].append(k)
    part = lambda a: _penalty(x[None], [clauses[k] for k in own[a]])[0]
    cost = _penalty(x[None], clauses)[0]
    best, low = x.copy(), cost
    for _ in range(flips):
        bad = [k for k, (atoms, pos, w) in enumerate(clauses) if (x[atoms] == pos).any() != (w > 0)]
        if not bad:
            break
        atoms = clauses[bad[rng.integers(len(bad))]][0]
        moves = []
        for a in atoms:
            before = part(a)
            x[a] ^= True
            moves.append(part(a) - before)
            x[a] ^= True
        pick = int(rng.integers(len(atoms))) if rng.random() < 0.1 else int(np.argmin(moves))
        x[atoms[pick]] ^= True
        cost += moves[pick]
        if cost < low - 1e-12:
            best, low = x.copy(), cost
    return best


def decided(clauses: DataFrame, hard: float = 1e6, rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """What needs no search: (tuple, value) that are surely best, and the ``clauses`` that are then still open.

    A tuple is decided if its unit clauses for a value weigh as much as all clauses for the other one: whatever the
    others are, the value costs no more. Its clauses are met or lose a literal, and the next round decides more.
    Rounds are joins over the clause table.
    """
    left = clauses.select("clause_id", F.coalesce("weight", F.lit(hard)).alias("weight"), "tuple", "positive").where("weight <> 0").distinct()
    left = materialise(left, "open")
    parts = [materialise(left.select("tuple", F.lit(True).alias("value")).limit(0), "decided")]
    for _ in range(rounds):
        size = left.groupBy("clause_id").agg(F.count("*").alias("k"))
        for_true = (F.col("weight") > 0) == F.col("positive")
        w = F.abs("weight")
        votes = left.join(size, "clause_id").groupBy("tuple").agg(
            F.sum(F.when(for_true & (F.col("k") == 1), w).otherwise(0.0)).alias("unit_true"), F.sum(F.when(~for_true & (F.col("k") == 1), w).otherwise(0.0)).alias("unit_false"),
            F.sum(F.when(for_true, w).otherwise(0.0)).alias("all_true"), F.sum(F.when(~for_true, w).otherwise(0.0)).alias("all_false"),
        )
        value = F.when(F.col("unit_true") >= F.col("all_false"), F.lit(True)).when(F.col("unit_false") >= F.col("all_true"), F.lit(False))
        new = materialise(votes.select("tuple", value.alias("value")).where("value is not null"), "decided")
        if new.isEmpty():
            return union_all(parts), left
        parts.append(new)
        marked = left.join(new, "tuple", "left")
        met = marked.where("value = positive").select("clause_id").distinct()
        left = materialise(marked.where("value is null").drop("value").join(met, "clause_id", "left_anti").select("clause_id", "weight", "tuple", "positive"), "open")
    raise RuntimeError(f"still deciding after {rounds} rounds")


def solve(clauses: DataFrame, hard: float = 1e6, flips: int = 0, width: int = 0) -> DataFrame:
    """True ``tuple``s of an assignment of least cost; a hard clause weighs ``hard``.

    What ``decided`` settles needs no search. The open clauses fall into components that share no tuple; each of
    EXACT tuples at most is enumerated by a task. A larger one is an error, unless ``width`` allows to eliminate its tuples
    by tables of that many, which is exact, or ``flips`` allows a seeded random walk of that many steps, whose assignment
    may not be the best one.
    """
    known, left = decided(clauses, hard)
    if left.isEmpty():
        return known.where("value").select("tuple")
    first = left.groupBy("clause_id").agg(F.min("tuple").alias("v"))
    group = materialise(components(left.join(first, "clause_id").select(F.col("tuple").alias("u"), "v")).toDF("tuple", "part"), "parts")
    done = known.where("value").select("tuple")
    if width:
        large = group.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > EXACT).select("part")
        far = materialise(group.join(large, "part", "left_semi"), "large")
        done = done.unionByName(eliminate(left.join(far.select("tuple"), "tuple", "left_semi"), width, hard).where("value").select("tuple"))
        group = group.join(far.select("tuple"), "tuple", "left_anti")
    elif not flips:
        large = group.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > EXACT).orderBy(F.desc("n")).first()
        if large:
            raise ValueError(f"the component of {large['part']} has {large['n']} open tuples, more than {EXACT}; allow a width to eliminate them or flips for a search")
    rows = left.join(group, "tuple").select("part", "clause_id", "weight", "tuple", "positive")

    def work(p: pd.DataFrame) -> pd.DataFrame:
        names = sorted(p["tuple"].unique())
        number = {t: k for k, t in enumerate(names)}
        made = [(g["tuple"].map(number).to_numpy(), g["positive"].to_numpy(bool), float(g["weight"].iloc[0])) for _, g in sorted(p.groupby("clause_id"))]
        x = _search(len(names), made, np.random.default_rng(SEED), flips)
        return pd.DataFrame({"tuple": [t for t, on in zip(names, x, strict=True) if on]}, dtype="str")

    return done.unionByName(rows.groupBy("part").applyInPandas(work, "tuple string"))


def expected_violations(clauses: DataFrame, true: DataFrame) -> DataFrame:
    """``rule`` and how many of its ground clauses the assignment violates; clauses have a column rule besides."""
    named = clauses.select("clause_id", "rule").distinct()
    s = satisfied(clauses.drop("rule"), true)
    return named.join(s, "clause_id").groupBy("rule").agg(F.sum((~F.col("ok")).cast("long")).alias("violated"))


def learn_weights(clauses: DataFrame, seen: DataFrame, weights: dict[str, float], rate: float = 1e-3, rounds: int = 20, hard: float = 1e6) -> dict[str, float]:
    """Rules' weights by a perceptron: each round solves with the weights of now and moves them by the difference in violations.

    clauses(clause_id, rule, tuple, positive) are ground, ``seen`` has the true tuples of the training data. A row a
    rule reaches the driver. Weights that still move after ``rounds`` are an error.
    """
    target = {r["rule"]: r["violated"] for r in expected_violations(clauses.withColumn("weight", F.lit(1.0)), seen).collect()}
    now = dict(weights)
    for _ in range(rounds):
        table = F.create_map(*[F.lit(x) for kv in now.items() for x in kv])
        weighted = materialise(clauses.withColumn("weight", table[F.col("rule")]), "weighted")
        got = {r["rule"]: r["violated"] for r in expected_violations(weighted, materialise(solve(weighted.drop("rule"), hard), "solved")).collect()}
        new = {k: weight_step(w, got.get(k, 0), target.get(k, 0), rate) for k, w in now.items()}
        if new == now:
            return now
        now = new
    raise RuntimeError(f"weights did not settle in {rounds} rounds")


def next_best(clauses: DataFrame, found: list[DataFrame], tuples: DataFrame, hard: float = 1e6) -> DataFrame:
    """The best assignment of ``tuples`` (column tuple) unlike all of ``found``: each is blocked by one hard clause.

    Blocking clauses join the tuples into one component, so these must be few (see solve).
    """
    blocked = clauses.select("clause_id", "weight", "tuple", "positive")
    for k, true in enumerate(found):
        on = tuples.select("tuple").distinct().join(true.select("tuple", F.lit(False).alias("positive")).distinct(), "tuple", "left")
        blocked = blocked.unionByName(on.select(F.lit(f"block{k}").alias("clause_id"), F.lit(None).cast("double").alias("weight"), "tuple", F.coalesce("positive", F.lit(True)).alias("positive")))
    return solve(blocked, hard)


def weight_step(weight: float, expected: float, seen: float, rate: float = 1e-3) -> float:
    """One step of learning a rule's weight from the expected and the seen number of violated instances."""
    return weight + rate * (expected - seen) * (1 if weight >= 0 else -1)
