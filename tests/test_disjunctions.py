"""Disjunctive forms against the truth of all assignments."""

import itertools
import random

from hornfels.operators import disjunctions as D

VARS, VALS = "abc", "01"


def true_in(terms):
    worlds = [dict(zip(VARS, vs, strict=True)) for vs in itertools.product(VALS, repeat=3)]
    return {k for k, w in enumerate(worlds) if any(all(w[v] == x for v, x in t) for t in terms)}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.formula, set()).add(tuple(map(tuple, r.lits)))
    return out


def minimal(terms):
    return not any(set(s) < set(t) for s in terms for t in terms)


def test_and_or_are_those_of_worlds(spark):
    rng = random.Random(1)
    made = [[(f, t, v, rng.choice(VALS)) for f in range(6) for t in range(rng.randint(1, 4)) for v in rng.sample(VARS, rng.randint(1, 3))] for _ in range(2)]
    made[0] += [(6, 0, None, None), (6, 1, "a", "1"), (7, 0, "a", "0"), (7, 0, "a", "1")]  # a true formula and a contradiction
    made[1] += [(6, 0, "b", "1"), (7, 0, "c", "1"), (8, 0, "c", "0")]
    a, b = (D.terms(spark.createDataFrame(m, "formula int, term int, var string, val string")) for m in made)
    fa, fb, conj, disj = found(a), found(b), found(D.both(a, b)), found(D.either(a, b))
    assert fa[6] == {()} and 7 not in fa
    for f in range(9):
        x, y = true_in(fa.get(f, ())), true_in(fb.get(f, ()))
        assert true_in(conj.get(f, ())) == x & y and true_in(disj.get(f, ())) == x | y
        assert minimal(conj.get(f, ())) and minimal(disj.get(f, ()))


def test_cutting_says_so_and_keeps_what_it_must(spark):
    lits = lambda s: [tuple(x.split("=")) for x in s.split("&")] if s else []
    rows = spark.createDataFrame([(1, lits(s)) for s in ("a=1", "b=1", "c=0", "c=1&d=1")] + [(2, lits("a=1")), (3, lits(""))], "formula int, lits array<struct<var: string, val: string>>")
    cut = D.truncated(rows, 2).collect()
    assert {(r.formula, r.cut) for r in cut} == {(1, True), (2, False), (3, False)} and len(cut) == 4
    given = spark.createDataFrame([(1, lits("c=1&d=1&e=1")), (2, lits("b=1")), (3, lits("z=1"))], rows.schema)
    assert found(D.pruned(rows, 2, given)) == {1: {(("a", "1"),), (("c", "1"), ("d", "1"))}, 3: {()}}
    assert found(D.pruned(rows, 1, given))[1] == {(("c", "1"), ("d", "1"))}
    assert D.absorbed(rows.limit(0)).count() == 0


def test_formulas_of_any_size_lose_the_same_terms(spark, monkeypatch):
    """Within a row or by the index of literals, in one task or many; literals may come unsorted and twice."""
    rng = random.Random(3)
    made = [(f, [(v, rng.choice(VALS)) for v in rng.choices("abcdef", k=rng.randint(1, 4))]) for f in range(12) for _ in range(1 + 3 * f)] + [(1, [])]
    rows = spark.createDataFrame(made, "formula int, lits array<struct<var: string, val: string>>")
    want = {}
    for f, t in made:
        if len({v for v, _ in t}) == len(set(t)):
            want.setdefault(f, set()).add(tuple(sorted(set(t))))
    want = {f: {t for t in ts if not any(set(s) < set(t) for s in ts)} for f, ts in want.items()}
    for few, most in ((0, 10**6), (5, 7), (10**6, 1)):
        monkeypatch.setattr(D, "FEW", few)
        monkeypatch.setattr(D, "ROWS", most)
        assert found(D.conjunctions(rows)) == want
