"""Program analyses, label feedback and rule learning, against loops in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from hornfels.operators import analyses as A
from hornfels.operators import clauses as C
from hornfels.operators import graph as G
from hornfels.operators import inference as I


def test_points_to_against_a_loop(spark):
    rng = random.Random(4)
    names = [f"v{k}" for k in range(8)]
    new = {(rng.choice(names), f"h{k}") for k in range(5)}
    assign = {(rng.choice(names), rng.choice(names)) for _ in range(5)}
    load = {(rng.choice(names), rng.choice(names), rng.choice("fg")) for _ in range(5)}
    store = {(rng.choice(names), rng.choice("fg"), rng.choice(names)) for _ in range(5)}
    vh, hfh = set(new), set()
    while True:
        v2 = vh | {(v, h) for v, w in assign for x, h in vh if x == w} | {(v, h) for v, w, f in load for x, b in vh if x == w for c, g, h in hfh if (c, g) == (b, f)}
        h2 = hfh | {(b, f, h) for v, f, w in store for x, b in vh if x == v for y, h in vh if y == w}
        if (v2, h2) == (vh, hfh):
            break
        vh, hfh = v2, h2
    frame = lambda rows, cols: spark.createDataFrame(sorted(rows), ", ".join(f"{c} string" for c in cols))
    a, b = A.points_to(frame(new, "vh"), frame(assign, "vw"), frame(load, "vwf"), frame(store, "vfw"))
    assert {tuple(r) for r in a.collect()} == vh
    assert {tuple(r) for r in b.collect()} == hfh
    same = {(x, y) for x, h in vh for y, k in vh if h == k and x < y}
    assert {tuple(r) for r in A.aliases(frame(vh, "vh")).collect()} == same


def test_escape_races_deadlocks_and_flows(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    hfh = rows([("a", "f", "b"), ("b", "f", "c"), ("x", "f", "y")], "b string, f string, h string")
    assert {r.h for r in A.escaping(rows([("a",)], "h string"), hfh).collect()} == {"a", "b", "c"}
    access = rows([("e1", 1, "h", True), ("e2", 2, "h", False), ("e3", 2, "h", True), ("e4", 2, "g", True)], "e string, t int, h string, write boolean")
    locks = rows([("e1", "l"), ("e3", "l")], "e string, l string")
    parallel = rows([(1, 2), (2, 1)], "t int, s int")
    assert {tuple(r) for r in A.races(access, locks, parallel).collect()} == {("e1", "e2")}
    locks = [(1, 1, "p", "q"), (1, 2, "q", "p"), (2, 3, "q", "p"), (3, 4, "r", "z"), (3, 4, "g", "z"), (4, 5, "z", "r"), (4, 5, "g", "r"), (5, 6, "z", "r")]
    holds = rows(locks, "t int, a int, l string, m string")
    both = lambda *x: rows([y for a, b in x for y in ((a, b), (b, a))], "t int, s int")
    # thread 1 alone in both orders is none; r and z are guarded by g in 3 and 4, not in 5
    assert {tuple(r) for r in A.deadlocks(holds, both((1, 2), (3, 4), (3, 5))).collect()} == {(1, 2, "p", "q"), (3, 5, "r", "z")}
    assert A.deadlocks(holds, both((3, 4))).count() == 0
    assert A.deadlocks(holds, both((1, 2)), rows([("p",)], "l string")).count() == 0
    e = rows([(1, 2), (2, 3), (1, 4), (4, 5)], "u int, v int")
    node = lambda *x: rows([(k,) for k in x], "node int")
    assert {tuple(r) for r in A.flows(node(1), e, node(3, 5), node(4)).collect()} == {(1, 3)}
    assert {r.node for r in A.backward_slice(e, node(4)).collect()} == {4, 5}


RULES = [("R1", "c", "a"), ("R1", "d", "b"), ("R2", "e", "c"), ("R2", "e", "d"), ("R2", "f", "d")]


@pytest.fixture
def clauses(spark):
    return spark.createDataFrame([(f"{r}{h}{b}", r, h, b) for r, h, b in RULES], "clause_id string, rule string, head string, lit string")


def test_labels_act_forward_and_the_carousel_asks(spark, clauses):
    dob = C.births(clauses)
    p = lambda df: {r.tuple: r.p for r in df.collect()}
    assert p(I.and_or(clauses, dob, F.lit(0.5))) == pytest.approx({"c": 0.5, "d": 0.5, "e": 1 - 0.75**2, "f": 0.25})
    labels = spark.createDataFrame([("c", True), ("d", False)], "tuple string, value boolean")
    assert p(I.clamped(clauses, dob, F.lit(0.5), labels)) == pytest.approx({"c": 1.0, "d": 0.0, "e": 0.5, "f": 0.0})
    alarms = spark.createDataFrame([("e", True), ("f", False)], "tuple string, truth boolean")
    asked = I.carousel(clauses, dob, F.lit(0.5), alarms, 5).orderBy("step").collect()
    assert [(r.tuple, r.truth) for r in asked] == [("e", True), ("f", False)]


def test_rules_are_learned(spark):
    rng = random.Random(12)
    rows, true = [], []
    for k in range(300):
        rows += [(f"x{k}", "A", f"h{k}", f"i{k}"), (f"y{k}", "B", f"h{k}", f"j{k}")]
        on = [rng.random() < 0.7, rng.random() < 0.7]
        true += [t for t, o in zip((f"i{k}", f"j{k}"), on, strict=True) if o]
        if (on[0] and rng.random() < 0.8) or (on[1] and rng.random() < 0.3):
            true.append(f"h{k}")
    table = spark.createDataFrame(rows, "clause_id string, rule string, head string, lit string")
    seen = spark.createDataFrame([(t,) for t in true], "tuple string")
    with pytest.raises(RuntimeError, match="settle"):
        I.fit_rules(table, seen, rounds=1)
    got = I.fit_rules(table, seen, tolerance=1e-3)
    assert got["A"] == pytest.approx(0.8, abs=0.09) and got["B"] == pytest.approx(0.3, abs=0.09)


def test_paths_and_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 1), (3, 3), (3, 4)], "u long, v long")
    assert {tuple(r["cycle"]) for r in G.simple_cycles(e, 4).collect()} == {(1, 2, 3), (1, 2), (3,)}
    paths = G.simple_paths(e, spark.createDataFrame([(1,)], "node long"), 5)
    assert {tuple(r.path) for r in paths.collect()} == {(1, 2), (1, 2, 3), (1, 2, 3, 4)}
    d = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (0, 3)], "u long, v long")
    ends = {(r.u, r.v): (r["first"], r["last"]) for r in G.path_ranges(d).collect()}
    assert [ends[k, 3] for k in (0, 1, 2)] == [(0, 1), (1, 2), (2, 3)]


def test_groups_stand_for_pairs_of_threads(spark):
    """Threads of a group run at once: the same deadlocks and races as with the pairs, which are not formed."""
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    holds = rows([(1, 1, "p", "q"), (1, 2, "q", "p"), (2, 3, "q", "p"), (3, 4, "r", "z"), (4, 5, "z", "r"), (5, 6, "z", "r")], "t int, a int, l string, m string")
    groups = rows([(1, 7), (2, 7), (3, 8), (4, 9), (5, 8), (5, 8)], "c int, n int")
    assert {tuple(r) for r in A.deadlocks(holds, None, groups=groups).collect()} == {(1, 2, "p", "q"), (3, 5, "r", "z")}
    access = rows([("e1", 1, "h", True), ("e2", 2, "h", False), ("e3", 2, "h", True), ("e4", 3, "h", True)], "e string, t int, h string, write boolean")
    locks = rows([("e1", "l"), ("e3", "l")], "e string, l string")
    assert {tuple(r) for r in A.races(access, locks, None, groups).collect()} == {("e1", "e2")}


def test_variables_that_nothing_reads_meet_no_statement(spark, monkeypatch):
    """The last round's objects, of a variable that no statement reads, are looked up among the uses and joined with no fact."""
    seen = []
    real = A.materialise
    monkeypatch.setattr(A, "materialise", lambda df, label, *by: seen.append((label, out := real(df, label, *by))) or out)
    facts = lambda rows, cols: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    vh, hfh = A.points_to(facts([("a", "x"), ("b", "y")], "vh"), facts([("c", "a")], "vw"), facts([("d", "c", "f"), ("d", "c", "f")], "vwf"), facts([("c", "f", "b"), ("c", "f", "b")], "vfw"))
    assert {tuple(r) for r in vh.collect()} == {("a", "x"), ("b", "y"), ("c", "x"), ("d", "y")} and vh.count() == 4
    assert [tuple(r) for r in hfh.collect()] == [("x", "f", "y")]
    used = next(df for label, df in seen if label == "used")
    assert {tuple(r) for r in used.collect()} == {("a", 1), ("b", 4), ("c", 10)}
