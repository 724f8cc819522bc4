"""Least derivations, needs and wildcard patterns against loops."""

import itertools
import random

from pyspark.sql import functions as F

from hornfels.operators import clauses as C
from hornfels.operators import provenance as P
from hornfels.operators import relational as R
from hornfels.plans import derivations as D


def test_derivations_and_needs_of_a_cyclic_program(spark):
    rng = random.Random(11)
    program = {f"k{i:02d}": (f"t{rng.randrange(5, 18)}", {f"t{rng.randrange(18)}" for _ in range(rng.choice([1, 2, 2, 3]))}) for i in range(34)} | {"k99": ("t16", set())}
    table = spark.createDataFrame([(c, "R", h, t) for c, (h, b) in program.items() for t in sorted(b) or [None]], "clause_id string, rule string, head string, lit string")
    heads = {h for h, _ in program.values()}

    def born(gone=frozenset()):
        dob = {t: 0 for _, b in program.values() for t in b if t not in heads and t not in gone}
        for k in itertools.count(1):
            new = {h for h, b in program.values() if h not in dob and h not in gone and all(t in dob for t in b)}
            if not new:
                return dob
            dob |= dict.fromkeys(new, k)

    dob = born()
    root = max(dob, key=lambda t: (dob[t], t))
    want, todo, seen = set(), [root], set()
    while todo:
        t = todo.pop()
        if t in seen:
            continue
        seen.add(t)
        able = [c for c, (h, b) in sorted(program.items()) if h == t and all(x in dob and dob[x] < dob[t] for x in b) and max([dob[x] for x in b], default=0) + 1 == dob[t]]
        lits = sorted(program[able[0]][1]) if able else [None]
        want |= {(t, dob[t], able[0] if able else None, "R" if able else None, x) for x in lits or [None]}
        todo += [x for x in lits if x]
    roots = spark.createDataFrame([(root,), ("nothing",)], "tuple string")
    assert {tuple(r) for r in C.least_derivation(table, roots).collect()} == want and len(seen) > 3
    for gone in ({"t0"}, {"t7", "t16"}):
        need = spark.createDataFrame([(t,) for t in gone], "tuple string")
        assert {r[0] for r in C.needing(table, need).collect()} == set(dob) - set(born(gone))


def test_patterns_match_as_loops_do(spark):
    tuples = [(a, b, a + b) for a in range(4) for b in [0, 1, None] if b is not None] + [(1, None, 5)]
    asked = [(1, 2, None), (2, None, 1), (3, None, None), (4, 3, 1), (5, 9, None), (6, 1, None)]
    p, r = spark.createDataFrame(asked, "id int, a int, b int"), spark.createDataFrame(tuples, "a int, b int, c int")
    want = [(i, *t) for i, a, b in asked for t in tuples if a in (None, t[0]) and b in (None, t[1])]
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted((tuple(x) for x in R.matching(p, r, "a", "b").collect()), key=key) == sorted(want, key=key)
    assert R.matching(p.limit(0), r, "a", "b").count() == 0


def test_coreachable_makes_no_pass_over_all_pairs(spark):
    """Repeated literals change nothing, and the plan of a round has no aggregation of the clauses themselves."""
    from unittest import mock

    from hornfels.operators import clauses as C

    rows = spark.createDataFrame([("a", "R", "x", "y"), ("b", "R", "x", "y"), ("c", "R", "y", "z"), ("d", "R", "w", "x"), ("e", "R", "z", None)], "clause_id string, rule string, head string, lit string")
    out = spark.createDataFrame([("x",)], "tuple string")
    plans = []

    def spied(base, step, *more):
        plans.append(step(base, base)._jdf.queryExecution().optimizedPlan().toString())
        return fixpoint(base, step, *more)

    from hornfels.operators.fixpoint import fixpoint

    with mock.patch.object(C, "fixpoint", spied):
        assert sorted(r["tuple"] for r in C.coreachable(rows, out).collect()) == ["x", "y", "z"]
    assert "Aggregate" not in plans[0]


PLAIN = [(f"a[{i}]", "A", f"p({i % 4})", lit) for i in range(200) for lit in (f"e({i})", f"f({i})")]
LINKED = [("b[0]", "B", "q(0)", "p(0)"), ("b[0]", "B", "q(0)", "e(1)"), ("c[0]", "C", "p(9)", "q(0)"), ("c[1]", "C", "p(0)", "p(9)"), ("d[0]", "D", "r(0)", "p(7)")]


def _written(monkeypatch, spark):
    """The clauses in question, and the list that rows written by the operators go to."""
    from hornfels.operators import clauses as C
    from hornfels.operators import inference as I

    rows = []
    for module, name in ((C, "materialise"), (C, "keep"), (I, "materialise")):
        real = getattr(module, name)

        def spied(df, label, *by, real=real):
            out = real(df, label, *by)
            rows.append(out.count())
            return out

        monkeypatch.setattr(module, name, spied)
    return spark.createDataFrame(PLAIN + LINKED, "clause_id string, rule string, head string, lit string"), rows


DOB = {"p(0)": 1, "p(1)": 1, "p(2)": 1, "p(3)": 1, "q(0)": 2, "p(9)": 3, "p(7)": 0, "r(0)": 1} | {f"{k}({i})": 0 for k in "ef" for i in range(200)}


def test_births_write_no_clause_over_inputs_only(spark, monkeypatch):
    table, rows = _written(monkeypatch, spark)
    got = C.births(table)
    assert {tuple(r) for r in got.collect()} == set(DOB.items())
    assert sum(rows) < 100  # 400 literals and 200 clauses before


def test_forward_keeps_clauses_over_inputs_as_they_are(spark, monkeypatch):
    table, rows = _written(monkeypatch, spark)
    dob = C.births(table)
    assert {r.clause_id for r in C.forward(table, dob).collect()} == {c for c, *_ in PLAIN + LINKED} - {"c[1]"}
    assert sum(rows) < 120


def test_marginals_write_no_clause_over_inputs_only(spark, monkeypatch):
    import pytest

    from hornfels.operators import inference as I

    table, rows = _written(monkeypatch, spark)
    dob = C.births(table)
    p = {r.tuple: r.p for r in I.and_or(C.forward(table, dob), dob, F.lit(0.01)).collect()}
    first = 1 - 0.99**50
    want = {f"p({k})": first for k in range(4)} | {"q(0)": 0.01 * first, "p(9)": 0.01 * 0.01 * first, "r(0)": 0.01}
    assert p == pytest.approx(want)
    assert sum(rows) < 200


def test_least_derivation_of_a_linked_program(spark, monkeypatch):
    table, rows = _written(monkeypatch, spark)
    got = {tuple(r) for r in C.least_derivation(table, spark.createDataFrame([("p(9)",), ("e(5)",), ("r(0)",), ("z(0)",)], "tuple string")).collect()}
    tree = {("p(9)", 3, "c[0]", "C", "q(0)"), ("q(0)", 2, "b[0]", "B", "p(0)"), ("q(0)", 2, "b[0]", "B", "e(1)"), ("p(0)", 1, "a[0]", "A", "e(0)"), ("p(0)", 1, "a[0]", "A", "f(0)")}
    inputs = {(t, 0, None, None, None) for t in ("e(0)", "f(0)", "e(1)", "e(5)", "p(7)")}
    assert got == tree | inputs | {("r(0)", 1, "d[0]", "D", "p(7)")}
    assert sum(rows) < 250  # 400 literals four times before; p(0)'s 50 clauses alone are looked at


def test_needs_read_clauses_over_inputs_once(spark, monkeypatch):
    table, rows = _written(monkeypatch, spark)
    need = lambda *t: {r[0] for r in C.needing(table, spark.createDataFrame([(x,) for x in t], "tuple string")).collect()}
    assert need(*[f"e({i})" for i in range(0, 200, 4)]) == {f"e({i})" for i in range(0, 200, 4)} | {"p(0)", "q(0)", "p(9)"}
    assert sum(rows) < 400
    assert need("e(1)", "e(2)", "nothing") == {"e(1)", "e(2)", "q(0)", "p(9)"}
    assert need("p(7)") == {"p(7)", "r(0)"}
    assert need("p(1)") == {"p(1)"}  # the inputs of its own clauses stay


def test_narrow_goes_on_with_its_steps_only(spark, monkeypatch):
    table, rows = _written(monkeypatch, spark)
    single = spark.createDataFrame([(f"s[{i}]", "S", f"s({i})", f"e({i})") for i in range(300)], table.schema)
    out = C.narrow(table.union(single), 5)
    made = sum(rows)
    widths = {r["head"]: r["n"] for r in out.select("clause_id", "head").distinct().groupBy("head").agg(F.count("*").alias("n")).collect()}
    assert max(widths.values()) <= 5 and out.where("rule <> 'Rnarrow'").count() == len(PLAIN + LINKED) + 300
    assert made < 500  # the 300 were written again in every round


def test_fellows_are_each_pair_once(spark):
    """Ids of one group and of several, repeated rows and nulls; groups of many blocks."""
    rng = random.Random(3)
    rows = [(i, g) for i in range(60) for g in rng.sample(range(4), 1 if i % 3 else 3)]
    rows += [rows[0], rows[3], (None, 1), (61, None)]
    known = [(i, g) for i, g in rows if i is not None and g is not None]
    want = sorted({(i, j) for i, g in known for j, h in known if g == h and i != j})
    for block in (7, 1500):
        out = R.fellows(spark.createDataFrame(rows, "s long, n long"), block)
        assert sorted(tuple(r) for r in out.collect()) == want
    assert R.fellows(spark.createDataFrame([], "s long, n long")).count() == 0


def test_generations_without_cycles_make_no_pairs_in_rounds(spark, monkeypatch):
    """A graph with several parents, and one with a cycle, against pairs that derive pairs."""
    from hornfels.operators import graph as G

    rounds = []
    real = G.fixpoint
    monkeypatch.setattr(G, "fixpoint", lambda base, *more: rounds.append(base.columns) or real(base, *more))
    rng = random.Random(6)
    for edges in ([(f"n{rng.randrange(i)}", f"n{i}") for i in range(1, 14)] + [("n0", "n5"), ("m", "n7"), ("m", "n9")], [(0, 1), (0, 2), (1, 3), (2, 4), (3, 1), (4, 4)]):
        want = {(x, y) for p, x in edges for q, y in edges if p == q and x != y}
        while more := {(x, y) for p, x in edges for q, y in edges if (p, q) in want and x != y} - want:
            want |= more
        got = [tuple(r) for r in G.same_generation(spark.createDataFrame(edges, ["u", "v"])).collect()]
        assert sorted(got) == sorted(want)
    assert rounds == [["node", "top", "k"], ["u", "v"]]


def test_last_duplicates_writes_no_clauses(spark, monkeypatch):
    """Instances are compared by their variables where the join left them: nothing is written, and no text is sent or sorted."""
    monkeypatch.setattr(D, "materialise", None)
    out = D.last_duplicates(spark, "/root/testdata/sf0.001")
    sent = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x or " Sort " in x]
    assert sent and not any(x in line for line in sent for x in ("head", "clause_id", "lit"))
    assert out.where("rule <> 'R9'").isEmpty()


def test_last_names_are_those_of_the_written_clauses(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "x long, y long")
    rules = {"R2": frame((1, 2), (3, 4), (3, 4)), "R10": frame((1, 2), (5, 6)), "R1": frame((3, 4), (None, 7))}
    last = P.last_names(rules)
    assert {tuple(r) for r in last.collect()} == {(1, 2, "R2"), (3, 4, "R2"), (5, 6, "R10"), (None, 7, "R1")} and last.count() == 4
    head, body = P.written("h", "x"), [P.written("a", "x", "y"), P.written("b", "y")]
    whole = [P.instrument(rows.where("x is not null"), name, head, body) for name, rows in rules.items()]
    kept = P.without_last_duplicates(whole[0].union(whole[1]).union(whole[2]))
    assert {(r.head, r.rule) for r in kept.collect()} == {("h(1)", "R2"), ("h(3)", "R2"), ("h(5)", "R10")}


def test_false_tuples_are_pushed_through_mixed_heads(spark):
    """Against a loop: heads have clauses over inputs, over derived tuples and both; a row a literal or a clause gives the same."""
    rng = random.Random(8)
    program = {f"a{k}": ("A", f"p({rng.randrange(14)})", {f"i({rng.randrange(9)})" for _ in range(2)}) for k in range(40)}
    program |= {f"b{k}": ("B", f"q({rng.randrange(8)})", {f"p({rng.randrange(14)})", f"i({rng.randrange(9)})"}) for k in range(14)}
    program |= {f"c{k}": ("C", f"q({rng.randrange(8)})", {f"q({rng.randrange(8)})"}) for k in range(4)}
    program |= {f"d{k}": ("D", f"q({rng.randrange(8)})", {f"i({rng.randrange(9)})"}) for k in range(5)} | {"e": ("E", "q(0)", set())}
    said = {f"i({k})": k % 2 == 1 for k in range(9)} | {"p(3)": False, "p(4)": True}
    false = {t for t, v in said.items() if not v}
    while new := {h for _, h, _ in program.values() if all(b & false for _, g, b in program.values() if g == h)} - false:
        false |= new
    long = spark.createDataFrame([(c, r, h, t) for c, (r, h, b) in program.items() for t in sorted(b) or [None]], "clause_id string, rule string, head string, lit string")
    feedback = spark.createDataFrame(sorted(said.items()), "tuple string, value boolean")
    wide = spark.createDataFrame([(c, r, h, sorted(b)) for c, (r, h, b) in program.items()], "clause_id string, rule string, head string, lits array<string>")
    for clauses in (wide, long):
        got = [r.tuple for r in C.push_false(clauses, feedback).collect()]
        assert sorted(got) == sorted(false) and any(t.startswith("q") for t in false)


def test_standing_heads_over_inputs_are_not_written(spark, monkeypatch):
    rows = []
    real = C.materialise
    monkeypatch.setattr(C, "materialise", lambda df, label: rows.append((label, out.count())) or out if (out := real(df, label)) is not None else None)
    wide = spark.createDataFrame([(f"k{i}", "R", f"h({i % 50})", [f"x({i})", "y(0)"]) for i in range(200)], "clause_id string, rule string, head string, lits array<string>")
    said = spark.createDataFrame([(f"x({i})", False) for i in range(0, 200, 50)], "tuple string, value boolean")
    assert "h(0)" in {r.tuple for r in C.push_false(wide, said).collect()}
    assert dict(rows)["count"] == 1 and max(n for _, n in rows) <= 1


def test_rounds_see_no_clauses_over_heads_of_the_first(spark, monkeypatch):
    """Clauses over heads born in round 1 bear theirs in round 2 without being numbered, but for those of inputs, unborn heads or no body."""
    program = {f"a{k}": ("A", f"p({k})", [f"i({k})"]) for k in range(6)} | {f"b{k}": ("B", f"q({k % 4})", [f"p({k})", "j(0)"]) for k in range(9)}
    program |= {"b9": ("B", "q(7)", []), "b10": ("B", "q(8)", ["j(1)"]), "c": ("C", "r(0)", ["q(2)"]), "d": ("C", "q(5)", ["r(0)"]), "e": ("C", "q(6)", ["q(9)"])}
    table = spark.createDataFrame([(c, r, h, t) for c, (r, h, b) in program.items() for t in b or [None]], "clause_id string, rule string, head string, lit string")
    dob = {**{f"p({k})": 1 for k in range(6)}, **{f"p({k})": 0 for k in (6, 7, 8)}, **{f"i({k})": 0 for k in range(6)}, "j(0)": 0, "j(1)": 0, "q(9)": 0}
    dob |= {"q(7)": 1, "q(8)": 1, "q(0)": 1, "q(1)": 2, "q(2)": 1, "q(3)": 1, "r(0)": 2, "q(5)": 3, "q(6)": 1}
    seen = []
    real = C._numbered
    monkeypatch.setattr(C, "_numbered", lambda linked, *a: seen.append({r.clause_id for r in linked.collect()}) or real(linked, *a))
    got = {r.tuple: r.dob for r in C.births(table).collect()}
    assert got == dob
    assert seen == [{"b6", "b7", "b8", "b9", "b10", "c", "d", "e"}]
    late = {r.clause_id for r in C.forward(table, C.births(table)).collect()}
    assert late == {c for c, (_, h, b) in program.items() if all(dob[t] < dob[h] for t in b)}
