"""Labels carried over clauses, and relations in one fixpoint, against plain loops."""

import random

import pytest

from hornfels.operators import labels
from hornfels.operators.fixpoint import together

SCHEMA = "clause_id string, head string, lit string, negated boolean, must boolean, may boolean"


def expected(clauses, seeds):
    """Round by round over {id: (head, [(lit, negated)], must, may)}."""
    value, when, conflict = {}, {}, set()

    def tell(found, k):
        new = {}
        for t, v in found:
            new.setdefault(t, set()).add(v)
        for t, vs in new.items():
            value[t], when[t] = (vs.pop(), k) if len(vs) == 1 else (None, k)
            if value[t] is None:
                conflict.add(t)
        return bool(new)

    def state(c):
        lits = [None if value.get(t) is None else value[t] != n for t, n in clauses[c][1]]
        return sum(x is None for x in lits), sum(x is False for x in lits)

    tell(seeds, 0)
    k = 0
    while True:
        k += 1
        found, now = [], {c: state(c) for c in clauses}
        for h in {c[0] for c in clauses.values()}:
            own = [c for c in clauses if clauses[c][0] == h]
            forced = any(clauses[c][2] and now[c] == (0, 0) for c in own)
            fail = all(now[c][1] > 0 for c in own)
            if h not in value:
                if forced:
                    found.append((h, True))
                elif fail and any(clauses[c][3] for c in own):
                    found.append((h, False))
                continue
            if (value[h] is False and forced) or (value[h] is True and fail):
                conflict.add(h)
            open_ = [c for c in own if clauses[c][3] and now[c][0] > 0 and now[c][1] == 0]
            if value[h] is True and len(open_) == 1 and not any(clauses[c][3] and now[c] == (0, 0) for c in own):
                found += [(t, not n) for t, n in clauses[open_[0]][1] if t not in value]
            if value[h] is False:
                for c in own:
                    if clauses[c][2] and now[c] == (1, 0):
                        found += [(t, n) for t, n in clauses[c][1] if t not in value]
        if not tell(found, k):
            return {(t, value[t], when[t], t in conflict) for t in value}


@pytest.mark.parametrize("seed", range(3))
def test_labels_of_random_programs(spark, seed):
    rng = random.Random(seed)
    clauses = {}
    for k in range(40):
        head = rng.randrange(8, 30)
        body = rng.sample(range(head), rng.choice([0, 1, 1, 2, 2, 3]) if k % 11 == 0 else rng.choice([1, 1, 2, 2, 3]))
        kind = rng.choice([(True, True), (True, False), (False, True)])
        clauses[f"c{k}"] = (f"t{head}", [(f"t{b}", rng.random() < 0.2) for b in body], *kind)
    seeds = [(f"t{rng.randrange(30)}", rng.random() < 0.5) for _ in range(9)]
    rows = [(c, h, t, n, must, may) for c, (h, body, must, may) in clauses.items() for t, n in body or [(None, False)]]
    got = labels.propagate(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(seeds, "tuple string, value boolean"))
    assert {tuple(r) for r in got.collect()} == expected(clauses, seeds)


def test_conflicts_are_told(spark):
    rows = [("a", "h", "x", False, True, True), ("b", "g", "y", False, True, True)]
    seeds = [("h", False), ("x", True), ("g", True), ("y", False), ("z", True), ("z", False)]
    got = labels.propagate(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(seeds, "tuple string, value boolean"))
    assert {(r.tuple, r.value, r.conflict) for r in got.collect()} == {("h", False, True), ("x", True, False), ("g", True, True), ("y", False, False), ("z", None, True)}
    none = labels.propagate(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "tuple string, value boolean"))
    assert none.count() == 0


def test_eager_labels_follow_whatever_the_others_are(spark):
    rows = [("a", "h", "x", False, True, False), ("a", "h", "y", False, True, False)]
    seeds = spark.createDataFrame([("h", False), ("x", False)], "tuple string, value boolean")
    of = lambda eager: {r.tuple: r.value for r in labels.propagate(spark.createDataFrame(rows, SCHEMA), seeds, eager).collect()}
    assert of(False) == {"h": False, "x": False} and of(True) == {"h": False, "x": False, "y": False}


def test_two_relations_in_one_fixpoint(spark):
    """even(y) :- odd(x), next(x, y). pair(x, y) :- even(x), odd(y), next(x, y). odd likewise."""
    step_ = spark.createDataFrame([(k, k + 1) for k in range(12)], "x int, y int")
    even, odd = spark.createDataFrame([(0,)], "n int"), spark.createDataFrame([], "n int")
    on = lambda d: d.join(step_, d["n"] == step_["x"]).select(step_["y"].alias("n"))

    def step(new, known):
        both = [(new["even"], known["odd"]), (known["even"], new["odd"])]
        pairs = [e.toDF("x").join(step_, "x").join(o.toDF("y"), "y").select("x", "y") for e, o in both]
        return {"even": [on(new["odd"])], "odd": [on(new["even"])], "pair": pairs}

    out = together({"even": even, "odd": odd, "pair": step_.limit(0)}, step)
    assert {r.n for r in out["even"].collect()} == set(range(0, 13, 2)) and {r.n for r in out["odd"].collect()} == set(range(1, 13, 2))
    assert {tuple(r) for r in out["pair"].collect()} == {(k, k + 1) for k in range(0, 12, 2)}
