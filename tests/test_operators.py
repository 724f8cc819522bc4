"""Operators on small graphs, clause tables, factor graphs and texts, against values worked out by hand or by enumeration."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hornfels.operators import clauses as C
from hornfels.operators import evidence, inference, markov, provenance, ranking, relational
from hornfels.operators import graph as G
from hornfels.sources import text as T
from hornfels.streaming import derive


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "u long, v long")


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_closures_agree_and_terminate_on_cycles(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 4), (3, 5), (4, 2))
    want = {(1, 2), (1, 3), (1, 4), (1, 5)} | {(a, b) for a in (2, 3, 4) for b in (2, 3, 4, 5)}
    assert pairs(G.closure(e)) == pairs(G.closure_by_doubling(e)) == want
    assert pairs(G.closure_no_self(e)) == {p for p in want if p[0] != p[1]}
    assert pairs(G.scc(e)) == {(1, 1), (2, 2), (3, 2), (4, 2), (5, 5)}
    assert {r.node for r in G.in_cycles(e).collect()} == {2, 3, 4}
    assert G.closure(e.limit(0)).count() == 0


def test_paths_levels_and_dominators(spark):
    e = edges(spark, (0, 1), (0, 2), (1, 3), (2, 3), (3, 4))
    assert pairs(G.path_counts(e)) == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 2)}
    assert pairs(G.levels(e)) == {(0, 0), (1, 1), (2, 1), (3, 2), (4, 3)}
    root = spark.createDataFrame([(0,)], "node long")
    assert pairs(G.dominators(e, root)) == {(n, n) for n in range(5)} | {(n, 0) for n in range(5)} | {(4, 3)}
    assert {(r.u, r.v, r.dist) for r in G.shortest(e).collect()} >= {(0, 3, 2), (0, 4, 3)}
    with pytest.raises(RuntimeError):
        G.levels(edges(spark, (1, 2), (2, 1)), 5)


RULES = [("R1", "c", "ab"), ("R2", "d", "c"), ("R3", "c", "d"), ("R4", "d", "b"), ("R5", "e", "d"), ("R6", "z", "a")]


@pytest.fixture
def clauses(spark):
    return spark.createDataFrame([(r, r, h, lit) for r, h, b in RULES for lit in b], "clause_id string, rule string, head string, lit string")


def test_clause_graph(spark, clauses):
    assert {r.tuple for r in C.inputs(clauses).collect()} == {"a", "b"}
    dob = C.births(clauses)
    assert pairs(dob) == {("a", 0), ("b", 0), ("c", 1), ("d", 1), ("e", 2), ("z", 1)}
    kept = C.forward(clauses, dob)
    assert {r.clause_id for r in kept.collect()} == {"R1", "R4", "R5", "R6"}
    out = spark.createDataFrame([("e",)], "tuple string")
    assert {r.tuple for r in C.coreachable(kept, out).collect()} == {"b", "d", "e"}
    act = C.active(kept, out)
    assert {r.clause_id for r in act.collect()} == {"R4", "R5"}
    p = {r.tuple: r.p for r in inference.and_or(act, C.births(act), F.lit(0.9)).collect()}
    assert p == pytest.approx({"d": 0.9, "e": 0.81})
    merged, prob = C.compress_chains(act, C.heads(act).select("clause_id", F.lit(0.9).alias("p")), out)
    assert [(r["head"], r["lit"]) for r in merged.collect()] == [("e", "b")]
    assert prob.first()["p"] == pytest.approx(0.81)


def test_clauses_without_body_and_elision(spark, clauses):
    full = C.derive_inputs(clauses)
    assert {(r["rule"], r["head"]) for r in full.where("lit is null").collect()} == {("Edb_a", "a"), ("Edb_b", "b")}
    assert pairs(C.births(full)) == {("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 3), ("z", 2)}
    bare = C.elide_inputs(clauses)
    assert {(r.clause_id, r.lit) for r in bare.collect()} == {("R1", None), ("R4", None), ("R6", None), ("R2", "c"), ("R3", "d"), ("R5", "d")}


def test_feedback_is_pushed_forward(spark, clauses):
    some = clauses.where("rule in ('R4', 'R2', 'R5')")
    said = spark.createDataFrame([("b", False), ("d", True), ("c", False)], "tuple string, value boolean")
    assert {r.tuple for r in C.push_false(some, said).collect()} == {"b", "c", "d", "e"}
    assert pairs(C.consistent_feedback(some, said)) == {("b", False), ("c", False)}


def test_wide_heads_are_split(spark):
    rows = [(f"k{i}", "R", "h", f"x{i}") for i in range(105)]
    out = C.narrow(spark.createDataFrame(rows, "clause_id string, rule string, head string, lit string"), 10)
    widths = out.select("clause_id", "head").distinct().groupBy("head").count().agg(F.max("count")).first()[0]
    assert widths <= 10 and {r.lit for r in out.where("rule = 'R'").collect()} == {f"x{i}" for i in range(105)}
    assert C.coreachable(out, spark.createDataFrame([("h",)], "tuple string")).where("tuple like 'x%'").count() == 105


def test_last_rule_name_of_duplicates_stays(spark):
    rows = [("1", "R1", "h", "a"), ("1", "R1", "h", "b"), ("2", "R2", "h", "b"), ("2", "R2", "h", "a")]
    out = provenance.without_last_duplicates(spark.createDataFrame(rows, "clause_id string, rule string, head string, lit string"))
    assert {r["rule"] for r in out.collect()} == {"R2"} and out.count() == 2


def test_atoms(spark):
    r = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (2, 2, 6)], "a long, b long, c long")
    assert pairs(relational.atom(r, "x", "x", None)) == {(1,), (2,)}
    assert pairs(relational.atom(r, "x", "y", 5)) == {(1, 1), (1, 2)}
    with pytest.raises(ValueError, match="links"):
        relational.body(relational.atom(r, "x", None, None), relational.atom(r, "y", None, None))


def _exact(entries, cards):
    names = sorted(cards)
    total = {(v, s): 0.0 for v in names for s in range(cards[v])}
    for states in itertools.product(*[range(cards[v]) for v in names]):
        now, w = dict(zip(names, states, strict=True)), 1.0
        for scope, table in entries:
            w *= table[tuple(now[v] for v in scope)]
        for v in names:
            total[v, now[v]] += w
    return {k: x / sum(total[k[0], s] for s in range(cards[k[0]])) for k, x in total.items()}


def test_belief_propagation_is_exact_on_trees(spark):
    rng = np.random.default_rng(8)
    scopes = [("a", "b"), ("b", "c"), ("b", "d"), ("d",), ("d", "e", "f")]
    entries = [(s, {k: float(rng.random() + 0.1) for k in itertools.product(range(2), repeat=len(s))}) for s in scopes]
    rows = [(f"f{k}", str(states), value, v, s) for k, (scope, table) in enumerate(entries) for states, value in table.items() for v, s in zip(scope, states, strict=True)]
    got = inference.belief_propagation(spark.createDataFrame(rows, "factor string, entry string, value double, var string, state int"), rounds=8)
    want = _exact(entries, dict.fromkeys("abcdef", 2))
    assert {(r.var, r.state): r.p for r in got.collect()} == pytest.approx(want, abs=1e-6)


def test_ranking(spark):
    rows = [("t1", 0.9, True), ("t2", 0.8, False), ("t3", 0.8, True), ("t4", float("nan"), False), ("t5", 0.0, True)]
    alarms = spark.createDataFrame([(*r, None) for r in rows], "t string, c double, truth boolean, label int")
    out = ranking.ranked(alarms, ranking.alarm_order("label", "c", "t"), "truth")
    assert [r.t for r in out.orderBy("rank").collect()] == ["t1", "t2", "t3", "t4", "t5"]
    m = ranking.measures(out).first()
    assert (m.inversions, m.peak, m.lowest_rank, m.mean_rank, m.auc) == (3, 6, 5, 3.0, 0.5)
    assert m.dcg == pytest.approx(1.886853, abs=1e-6)
    assert ranking.median_rank(out).first()[0] == 3.0


def test_solver_finds_the_best_of_small_components(spark):
    rng = random.Random(6)
    rows = [(f"c{k}", w, f"{g}{a}", rng.random() < 0.5) for k in range(24) for g, w in [(rng.choice("pq"), rng.choice([1.0, 2.0, -0.5, None]))] for a in rng.sample(range(6), 2)]
    clauses = spark.createDataFrame(rows, "clause_id string, weight double, tuple string, positive boolean")
    got = {r.tuple for r in markov.solve(clauses).collect()}

    def cost(true):
        total = 0.0
        for k in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == k]
            ok, w = any((r[2] in true) == r[3] for r in own), own[0][1] if own[0][1] is not None else 1e6
            total += max(0, -w) if ok else max(0, w)
        return total

    names = sorted({r[2] for r in rows})
    best = min(cost({n for n, on in zip(names, x, strict=True) if on}) for x in itertools.product((0, 1), repeat=len(names)))
    assert cost(got) == pytest.approx(best)
    e = markov.evaluation(clauses, markov.solve(clauses)).first()
    assert e.cost + 1e6 * e.violations == pytest.approx(best)


def test_evidence(spark):
    log = spark.createDataFrame([(1, 1, "a", "b", 5.0), (1, 2, "a", "b", 50.0), (1, 3, "a", "c", 95.0), (2, 1, "a", "b", 50.0)], "pid int, seq int, src string, dst string, value double")
    assert pairs(evidence.positive_edges(log, F.col("value") > 90)) == {("a", "c")}
    assert pairs(evidence.negative_counts(log, F.col("value") > 90, F.col("value") < 10)) == {("a", "b", 1)}
    assert evidence.negative_confidence(spark.createDataFrame([(3,)], "n int"), 0.5).first()[1] == pytest.approx(0.875)
    rows = spark.createDataFrame([(float(x), float(x) + 0.3 * (-1) ** k > 0) for k, x in enumerate(np.linspace(-1, 1, 40))], "x double, y boolean")
    a, b = evidence.fit_logistic(rows, "x", "y")
    assert b > 2 and abs(a) < 1
    vec = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "p array<double>, q array<double>")
    assert [r[0] for r in vec.select(evidence.cosine("p", "q")).collect()] == [pytest.approx(0.5**0.5), None]


def test_text_formats(spark, tmp_path, clauses):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert pairs(T.tuples_from(lines("* 1-2", "# no", "", "x 1", "2-1 1", "1 2 3"), ["a", "b"], [3, 3])) == {(a, b) for a in range(3) for b in (1, 2)}
    T.write_tuples(edges(spark, (1, 2), (3, 4)), str(tmp_path / "t"))
    assert pairs(T.read_tuples(spark, str(tmp_path / "t"), ["u", "v"])) == {(1, 2), (3, 4)}
    got = T.clauses_from(lines("R1: NOT p(1,2), NOT q(3), r(1,3)", "R2: s(4)", "no clause"))
    assert {(r["rule"], r["head"], r["lit"]) for r in got.collect()} == {("R1", "r(1,3)", "p(1,2)"), ("R1", "r(1,3)", "q(3)"), ("R2", "s(4)", None)}
    T.write_clauses(clauses, str(tmp_path / "c"))
    back = T.read_clauses(spark, str(tmp_path / "c"))
    assert {(r["rule"], r["head"], r["lit"]) for r in back.collect()} == {(r["rule"], r["head"], r["lit"]) for r in clauses.collect()}
    assert pairs(T.observations_from(lines("t(1)\t0.5", "bad", "u\tx"))) == {("t(1)", 0.5)}
    assert pairs(T.feedback_from(lines("O t(1) true", "O u false", "Q x"))) == {("t(1)", True), ("u", False)}
    log = spark.createDataFrame([(1, 1, "x"), (1, 2, "end"), (2, 1, "x"), (3, 1, "x"), (3, 3, "end")], "pid int, seq int, kind string")
    assert {r.pid for r in T.whole_runs(log, "pid", "seq", F.col("kind") == "end").collect()} == {1}


def test_streamed_closure_equals_the_batch_one(spark, tmp_path):
    rng = random.Random(2)
    all_edges = [(rng.randrange(14), rng.randrange(14)) for _ in range(24)]
    for k in range(3):
        edges(spark, *all_edges[8 * k : 8 * k + 8]).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("u long, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    inc = derive.IncrementalClosure(spark)
    inc.follow(stream, str(tmp_path / "state"))
    assert len(inc.parts) == 3
    assert pairs(inc.paths()) == pairs(G.closure(edges(spark, *all_edges)))
    assert inc.paths().count() == len(pairs(inc.paths()))


def test_watermarked_counts_drop_nothing_in_time(spark, tmp_path):
    rows = spark.range(200).selectExpr("timestamp_seconds(id * 3600) as ts", "cast(id % 2 as string) as k")
    rows.coalesce(1).write.parquet(str(tmp_path / "x"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "x"))
    got = derive.run_available(derive.windowed_counts(stream, "ts", "k", late="1 day"), "counts")
    assert {r.n for r in got.collect()} == {12} and got.count() >= 12
