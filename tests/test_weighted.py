"""Elimination and lazy grounding against enumeration of all assignments."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from hornfels.operators import grounding, markov
from hornfels.operators.elimination import eliminate

SCHEMA = "clause_id string, weight double, tuple string, positive boolean"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def cost_of(rows, true, hard=1e6):
    total = 0.0
    for _, group in itertools.groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        group = list(group)
        w = hard if group[0][1] is None else group[0][1]
        ok = any((t in true) == p for _, _, t, p in group)
        total += max(0.0, -w) if ok else max(0.0, w)
    return total


def least(rows):
    names = sorted({r[2] for r in rows})
    return min(cost_of(rows, {t for t, on in zip(names, bits, strict=True) if on}) for bits in itertools.product((False, True), repeat=len(names)))


def random_rows(seed, tuples=9, clauses=16):
    rng = random.Random(seed)
    rows = []
    for k in range(clauses):
        w = None if rng.random() < 0.15 else rng.choice([-2.0, -0.5, 0.0, 0.75, 1.0, 1.5, 3.0])
        rows += [(f"c{k}", w, f"x{rng.randrange(tuples)}", rng.random() < 0.5) for _ in range(rng.randint(1, 3))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_elimination_finds_the_least_cost(spark, seed):
    rows = random_rows(seed)
    rows += rows[:2]  # repeated rows are one literal
    got = eliminate(frame(spark, rows)).collect()
    used = {r[2] for r in rows if r[1] is None or r[1] != 0}
    assert {r.tuple for r in got} == used and len(got) == len(used)
    assert cost_of(rows, {r.tuple for r in got if r.value}) == pytest.approx(least(rows))


def test_long_chains_rings_and_hubs_are_solved_beyond_enumeration(spark):
    ring = [(f"{s}{k}", 1.0, f"x{(k + d) % 31:02}", p) for k in range(31) for s, p in (("a", True), ("b", False)) for d in (0, 1)]
    solved = markov.solve(frame(spark, ring), width=3)
    # on an odd ring two neighbours must agree once
    assert markov.evaluation(frame(spark, ring), solved).first().cost == 1.0
    hub = [(f"e{k}", 1.0, t, p) for k in range(40) for t, p in (("hub", False), (f"leaf{k}", True))]
    hub += [(f"l{k}", 0.5, f"leaf{k}", False) for k in range(40)] + [("hub", 30.0, "hub", True)]
    assert markov.evaluation(frame(spark, hub), frame(spark, hub).join(eliminate(frame(spark, hub), 2).where("value"), "tuple").select("tuple").distinct()).first().cost == 20.0


def test_elimination_says_what_it_cannot_do(spark):
    full = [(f"{a}-{b}", 1.0, f"x{x}", True) for a in range(6) for b in range(a) for x in (a, b)]
    with pytest.raises(ValueError, match="neighbours"):
        eliminate(frame(spark, full), 4)
    with pytest.raises(ValueError, match="width"):
        eliminate(frame(spark, [("long", 1.0, f"x{k}", True) for k in range(9)]), 4)
    assert eliminate(frame(spark, [])).count() == 0
    both = [("c", 5.0, "x", True), ("c", 5.0, "x", False), ("n", 1.0, None, True)]
    assert [tuple(r) for r in eliminate(frame(spark, both)).collect()] == [("x", False)]
    clash = [("p", None, "x", True), ("q", None, "x", False)]
    assert markov.evaluation(frame(spark, clash), eliminate(frame(spark, clash)).where("value")).first().violations == 1


@pytest.mark.parametrize("seed", [5])
def test_lazy_grounding_costs_what_all_clauses_do(spark, seed):
    rows = random_rows(seed, 8, 14)
    rows = list({(c, t): (c, w, t, p) for c, w, t, p in rows}.values())
    whole = frame(spark, rows).where("coalesce(weight, 1) <> 0")

    def violated(true):
        s = markov.satisfied(whole, true)
        bad = s.where("(not ok and coalesce(weight, 1) > 0) or (ok and weight < 0)")
        return whole.join(bad.select("clause_id"), "clause_id", "left_semi").select(*whole.columns)

    true, ground, rounds = grounding.lazily(whole.limit(0), violated, markov.solve)
    found = {r.tuple for r in true.collect()}
    assert cost_of(rows, found) == pytest.approx(least(rows)) and rounds > 1
    assert ground.join(whole, ["clause_id", "tuple", "positive"], "left_anti").count() == 0
    with pytest.raises(RuntimeError, match="rounds"):
        grounding.lazily(whole.limit(0), violated, lambda g: g.where(F.lit(False)), rounds=1)
