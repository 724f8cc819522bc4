"""Components, dominators, births, bridges, networks and statistics against plain loops or enumeration."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from hornfels.functions import scalar
from hornfels.operators import analyses, clauses, feedback, graph, inference, markov, network, relational, runs


def frame(spark, rows, schema):
    return spark.createDataFrame(list(rows), schema)


def pairs(df):
    return {tuple(r) for r in df.collect()}


def random_edges(seed, n=12, m=22):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def reachable(edges, start, without=None):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for u, v in edges:
            if u == x and (u, v) != without and v not in seen:
                seen.add(v)
                todo.append(v)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_components_cycles_and_dominators(spark, seed):
    e = random_edges(seed)
    nodes = {x for p in e for x in p}
    reach = {x: reachable(e, x) for x in nodes}
    scc = {x: min(y for y in nodes if y in reach[x] and x in reach[y]) for x in nodes}
    df = frame(spark, e, "u long, v long")
    assert pairs(graph.scc(df)) == set(scc.items())
    on = {(u, v) for u, v in e if scc[u] == scc[v]}
    assert pairs(graph.cycle_edges(df)) == on
    assert {r.node for r in graph.in_cycles(df).collect()} == {u for u, _ in on}
    level = dict(pairs(graph.scc_levels(df)))
    assert set(level) == set(scc.values()) and all(level[scc[u]] < level[scc[v]] for u, v in e if scc[u] != scc[v])
    root = min(nodes)
    below = reach[root]
    doms = {(v, d) for v in below for d in below if d == v or v not in _past(e, root, d)}
    got = graph.dominators(df, frame(spark, [(root,)], "node long"))
    assert pairs(got) == doms
    strict = {(v, d) for v, d in doms if v != d}
    fronts = {(d, v) for u, v in e if u in below for x, d in doms if x == u and (v, d) not in strict}
    assert pairs(graph.dominance_frontier(df, got)) == fronts
    back = pairs(graph.back_edges(df))
    left = [p for p in e if p not in back]
    assert back <= on and all(u != v and u not in reachable(left, v) for u, v in left)
    counts = dict(pairs(graph.path_counts(df, back=frame(spark, sorted(back), "u long, v long"))))
    want = {}
    for v in sorted(nodes, key=lambda x: sum(x in reachable(left, y) for y in nodes)):
        want[v] = sum(want[u] for u, w in left if w == v) or 1
    assert {k: int(v) for k, v in counts.items()} == want


def _past(edges, root, gone):
    """What is reached from the root without ``gone``."""
    return reachable([p for p in edges if gone not in p], root) if gone != root else set()


def test_bounds_are_errors(spark):
    e = frame(spark, [(k, k + 1) for k in range(6)], "u long, v long")
    assert graph.shortest(e, 6).count() == 21
    with pytest.raises(RuntimeError):
        graph.shortest(e, 5)
    ring = [(f"f{k}", s, v, x, t) for k in range(3) for s, v, pair in (("a", 1.0, (0, 1)), ("b", 1.0, (1, 0))) for x, t in ((f"v{k}", pair[0]), (f"v{(k + 1) % 3}", pair[1]))]
    ring += [("w", "0", 0.9, "v0", 0), ("w", "1", 0.1, "v0", 1)]
    entries = frame(spark, ring, "factor string, entry string, value double, var string, state int")
    with pytest.raises(RuntimeError):
        inference.belief_propagation(entries, rounds=2)
    assert inference.belief_propagation(entries, rounds=2, strict=False).count() == 6


@pytest.mark.parametrize("seed", [3, 4])
def test_births_of_a_cyclic_program(spark, seed):
    rng = random.Random(seed)
    rules = [(f"c{k}", f"t{rng.randrange(9)}", sorted({f"{rng.choice('ti')}{rng.randrange(9)}" for _ in range(rng.randrange(3))})) for k in range(16)]
    rows = [(c, "R", h, b) for c, h, body in rules for b in (body or [None])]
    dob = {b: 0 for _, _, body in rules for b in body if not any(h == b for _, h, _ in rules)}
    k = 0
    while True:
        k += 1
        new = {h for _, h, body in rules if h not in dob and all(b in dob for b in body)}
        if not new:
            break
        dob |= dict.fromkeys(new, k)
    table = frame(spark, rows, "clause_id string, rule string, head string, lit string")
    got = clauses.births(table)
    assert pairs(got) == set(dob.items())
    want = {c for c, h, body in rules if h in dob and all(b in dob and dob[b] < dob[h] for b in body)}
    assert {r.clause_id for r in clauses.forward(table, got).collect()} == want


def test_bridges_of_found_paths(spark):
    flow = random_edges(7, 9, 14)
    ends = [(u, v) for u, v in itertools.product(range(9), repeat=2) if u != v and v in reachable(flow, u)][::9]
    known = set(ends)
    while True:
        sure = set()
        for s, t in known:
            if t in reachable(flow, s):
                sure |= {(u, v) for u, v in flow if u in reachable(flow, s) and t in reachable(flow, v) and t not in reachable(flow, s, (u, v))}
        now = known | sure
        while more := {(a, d) for a, b in now for c, d in now if b == c} - now:
            now |= more
        if now == known:
            break
        known = now
    got = feedback.bridges(frame(spark, flow, "u long, v long"), frame(spark, ends, "u long, v long"))
    assert pairs(got) == known


def test_feedback_is_placed_once(spark):
    schema = "src string, dst string, confidence double"
    yes, no = frame(spark, [("a", "b", 0.5), ("a", "c", 0.75)], schema), frame(spark, [("a", "b", 0.9), ("b", "c", 0.25)], schema)
    nodes = frame(spark, [("a", "n1"), ("a", "n2"), ("b", "n3"), ("c", "n3"), ("c", "skip")], "line string, node string")
    left = feedback.positive_wins(yes, no)
    assert pairs(left.select("src", "dst")) == {("b", "c")}
    skip = frame(spark, [("skip",), ("n1",)], "node string")
    fan = lambda d: feedback.fanned_out(d, nodes, skip, frame(spark, [("n1",)], "node string"))
    got = feedback.emitted(fan(yes), fan(left)).orderBy("place").collect()
    assert [(r.place, r.tuple, r.value, r.confidence) for r in got] == [(1, "DUPath(n1,n3)", True, 0.75), (2, "DUPath(n2,n3)", True, 0.75), (3, "DUPath(n3,n3)", False, 0.25)]
    union = frame(spark, [(1, "x", "y"), (1, "y", "z"), (1, "x", "l"), (1, "l", "z"), (2, "y", "q")], "pid int, node string, part string")
    labels = frame(spark, [(1, "l", "L"), (1, "z", "Z"), (2, "q", "Q")], "pid int, node string, label string")
    assert pairs(feedback.label_sources(union, labels, frame(spark, [(1, "x"), (2, "y")], "pid int, node string"))) == {(1, "x", "L"), (1, "x", "Z"), (2, "y", "Q")}


RULES = [("A1", "R1", "p", "i"), ("A2", "R2", "p", "j"), ("A3", "R3", "q", "p"), ("A4", "R1", "r", "p"), ("A4", "R1", "r", "q")]


def test_network_against_enumeration(spark):
    """Marginals with evidence on a small network without loops, by all assignments of the clauses and inputs."""
    rules = [x for x in RULES if x[0] != "A4"]
    table = frame(spark, rules, "clause_id string, rule string, head string, lit string")
    soft = frame(spark, [("i", 0.7), ("j", 0.4)], "tuple string, agreement double")
    p = {"R1": 0.8, "R2": 0.6, "R3": 0.9}
    rate = F.create_map(*[F.lit(x) for kv in p.items() for x in kv])[F.col("rule")]
    total, sums = 0.0, dict.fromkeys("ijpq", 0.0)
    for i, j, a, b, c in itertools.product((0, 1), repeat=5):
        w = 1.0
        for on, chance in ((i, 0.2), (j, 0.2), (a, p["R1"]), (b, p["R2"]), (c, p["R3"])):
            w *= chance if on else 1 - chance
        w *= (0.7 if i else 0.3) * (0.4 if j else 0.6)
        now = {"i": i, "j": j, "p": (i and a) or (j and b)}
        now["q"] = now["p"] and c
        if now["q"]:  # the label
            total += w
            for k in sums:
                sums[k] += w * now[k]
    labels = frame(spark, [("q", True)], "tuple string, value boolean")
    got = dict(pairs(network.marginals(table, rate, labels, soft)))
    assert got == pytest.approx({k: v / total for k, v in sums.items()}, abs=1e-6)
    nodes, arcs, names = network.network(frame(spark, RULES, "clause_id string, rule string, head string, lit string"))
    assert dict(pairs(names)) == {"p": "p", "q": "A3", "r": "A4"}
    assert pairs(arcs) == {("p", "A1"), ("p", "A2"), ("A3", "p"), ("A4", "p"), ("A4", "A3")}
    assert pairs(nodes.select("node", "kind")) == {("A1", "*"), ("A2", "*"), ("A3", "*"), ("A4", "*"), ("p", "+")}
    with pytest.raises(ValueError, match="parents"):
        network.factors(nodes, arcs, F.lit(0.5), most=1)


def test_hidden_rules_are_learned(spark):
    """c<k> :- h<k> (R2), h<k> :- i<k> (R1): only c<k> is seen, R1 sure by a label on every other h."""
    rows, seen = [], []
    for k in range(20):
        rows += [(f"a{k}", "R1", f"h{k}", f"i{k}"), (f"b{k}", "R2", f"c{k}", f"h{k}")]
        seen += [(f"h{k}", True), (f"c{k}", k < 15)]
    got = network.fit_rules_hidden(frame(spark, rows, "clause_id string, rule string, head string, lit string"), frame(spark, seen, "tuple string, value boolean"))
    assert got["R2"] == pytest.approx(0.75, abs=0.01) and got["R1"] == pytest.approx(0.999)


def test_runs(spark):
    ranks = frame(spark, [("b", 1, r) for r in (2, 4, 9)] + [("b", 2, r) for r in (1, 8)] + [("c", 1, 5)], "bench string, run int, rank int")
    done = frame(spark, [("b", 1, 3), ("b", 2, 3), ("c", 1, 2)], "bench string, run int, expected int")
    assert pairs(runs.rank_quantiles(ranks, done)) == {("b", 1, 4.0, 9.0), ("c", 0, None, None)}
    curve = frame(spark, [(1, 0, 1), (2, 1, 1)], "rank int, falses int, trues int")
    assert pairs(runs.padded_curve(curve, 3, 4)) == {(0, 1), (1, 1), (1, 3), (4, 3)}
    alarms = frame(spark, [(1, True, 1), (2, False, 1)], "rank int, truth boolean, trues int")
    assert runs.padded_auc(alarms, 3, 4).first().auc == pytest.approx((1 + 3 * 3) / 12)
    numbers = frame(spark, [(1234.0,), (5.25e6,), (12.0,), (0.5,), (250000.0,)], "x double")
    assert [r[0] for r in numbers.select(runs.short_number(F.col("x"))).collect()] == ["1.23k", "5.25m", "12", "0.5", "250k"]
    steps = frame(spark, [("b", 0, "t", 3, True), ("b", 0, "f", 1, False), ("b", 1, "t", 1, True), ("b", 1, "f", 2, False)], "bench string, step int, tuple string, rank int, truth boolean")
    assert pairs(runs.bench_summary(steps)) == {("b", 3.0, 2, 1, 1)}
    some = frame(spark, [(k,) for k in range(10)], "run int")
    assert runs.sampled_runs(some, 0.35, 1).count() == 4 and runs.sampled_runs(some, 1.0, 1).count() == 10
    assert pairs(runs.sampled_runs(some, 0.35, 1)) == pairs(runs.sampled_runs(some.repartition(3), 0.35, 1))
    labels = frame(spark, [(f"t{k}", k % 4 == 0) for k in range(2000)], "tuple string, value boolean")
    assert pairs(runs.noisy_labels(labels, 1.0, 5)) == pairs(labels)
    assert abs(runs.noisy_labels(labels, 0.0, 5).where("value").count() - 500) < 80


def test_solver_decides_and_refuses(spark):
    schema = "clause_id string, weight double, tuple string, positive boolean"
    chain = [(f"c{k}", 1.0, f"x{k}", False) for k in range(60)] + [(f"c{k}", 1.0, f"x{k + 1}", True) for k in range(60)] + [("start", None, "x0", True)]
    known, left = markov.decided(frame(spark, chain, schema))
    assert left.count() == 0 and {r.tuple for r in known.where("value").collect()} == {f"x{k}" for k in range(61)}
    odd = [(f"{s}{k}", 1.0, f"x{(k + d) % 19}", p) for k in range(19) for s, p in (("a", True), ("b", False)) for d in (0, 1)]
    with pytest.raises(ValueError, match="open tuples"):
        markov.solve(frame(spark, odd, schema)).collect()
    assert markov.solve(frame(spark, odd, schema), flips=500).count() <= 19
    pair = frame(spark, [("a", 2.0, "x", True), ("b", 1.0, "y", True), ("h", None, "x", False), ("h", None, "y", False)], schema)
    best = markov.solve(pair)
    assert pairs(best) == {("x",)}
    assert pairs(markov.next_best(pair, [best], frame(spark, [("x",), ("y",)], "tuple string"))) == {("y",)}


def test_analyses_of_threads_and_types(spark):
    starts = frame(spark, [("m", "a"), ("m", "b"), ("b", "c"), ("m", "d")], "t string, s string")
    joins = frame(spark, [("m", "d")], "t string, s string")
    got = {tuple(sorted(p)) for p in pairs(analyses.parallel(starts, joins))}
    assert got == {("a", "m"), ("b", "m"), ("c", "m"), ("b", "c"), ("a", "b"), ("a", "c")}
    vh = frame(spark, [("v", "h1"), ("v", "h2"), ("w", "h1")], "v string, h string")
    objects = frame(spark, [("h1", "T"), ("h2", "S")], "h string, type string")
    sub = frame(spark, [("T", "T"), ("S", "S"), ("T", "S")], "sub string, type string")
    casts = frame(spark, [("k1", "v", "T"), ("k2", "v", "S"), ("k3", "w", "T")], "cast string, v string, type string")
    assert pairs(analyses.unsafe_casts(vh, objects, sub, casts)) == {("k1",)}
    methods = frame(spark, [("T", "f", "T.f"), ("S", "f", "S.f")], "type string, name string, method string")
    targets = analyses.call_targets(vh, objects, methods, frame(spark, [("c1", "v", "f"), ("c2", "w", "f")], "call string, v string, name string"))
    assert pairs(analyses.site_kinds(targets)) == {("c1", True), ("c2", False)}
    assert pairs(analyses.null_dereferences(frame(spark, [("u1", "v"), ("u2", "z")], "use string, v string"), vh)) == {("u2",)}


def test_packed_domains_and_scalars(spark):
    assert relational.equivalence(a=3, b=2) == [("a", 3, 0), ("b", 2, 4)]
    assert pairs(relational.packed(spark, a=2, b=1)) == {("a", 0, 0), ("a", 1, 1), ("b", 0, 3)}
    s = frame(spark, [("O'NEIL-mac x2y", "aXbX")], "a string, b string")
    assert tuple(s.select(scalar.initcap(F.col("a")), scalar.regex_replace(F.col("b"), "X", "-")).first()) == ("O'Neil-Mac X2y", "a-bX")
    assert s.select(scalar.regex_replace(F.col("b"), "X", r"$1\n")).first()[0] == r"a$1\nbX"
    halves = frame(spark, [(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in halves.select(scalar.round_even(F.col("x"))).collect()] == [0.0, 2.0, 2.0]


def test_path_ranges_on_a_cyclic_graph(spark):
    """Without its back edges a graph's paths are numbered as those of the graph that is left."""
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 1), (3, 4)], "u int, v int")
    back = spark.createDataFrame([(3, 1)], "u int, v int")
    got = {(r.u, r.v): (int(r["first"]), int(r["last"])) for r in graph.path_ranges(e, back).collect()}
    assert got.keys() == {(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)}
    assert {got[1, 3], got[2, 3]} == {(0, 1), (1, 2)} and got[0, 2] == (0, 1) and got[3, 4] == (0, 2)


@pytest.mark.parametrize("seed", [3])
def test_closure_by_classes_and_dominators_of_a_dense_graph(spark, seed):
    """A component of many nodes beside a path: each pair is made once, and what dominates is found past all cycles."""
    e = [*random_edges(seed, 8, 30), (7, 20), (20, 21), (21, 21), (22, 0)]
    df = frame(spark, e, "u long, v long")
    nodes = {x for p in e for x in p}
    found = graph.closure_by_classes(df).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == {(u, w) for u in nodes for a, v in e if a == u for w in reachable(e, v)}
    below = reachable(e, 22)
    doms = {(v, d) for v in below for d in below if d == v or v not in _past(e, 22, d)}
    assert pairs(graph.dominators(df, frame(spark, [(22,)], "node long"))) == doms


def test_bridges_of_a_wide_hub(spark):
    """Edges on the ways are found from either end: many leaves below a hub, and many sources above one."""
    flow = [(0, k) for k in range(1, 30)] + [(k, 100) for k in range(50, 80)] + [(1, 200), (300, 50)]
    out = feedback.bridges(frame(spark, flow, "u long, v long"), frame(spark, [(0, 200), (300, 100)], "u long, v long"))
    assert pairs(out) == {(0, 200), (0, 1), (1, 200), (300, 100), (300, 50), (50, 100)}


def test_components_leave_without_edges_between_colours(spark, monkeypatch):
    """Rounds see numbered nodes, and later ones no edge between colours; names are those of the least nodes."""
    seen = []
    real = graph._without_ends
    monkeypatch.setattr(graph, "_without_ends", lambda edges, rounds: seen.append(edges) or real(edges, rounds))
    rings = [(f"{r}{k}", f"{r}{(k + 1) % 3}") for r in "dcba" for k in range(3)]
    edges = rings + [(f"{x}0", f"{y}1") for x, y in ("dc", "cb", "ba", "da")] + [("z", "d0"), ("a2", "y"), ("q", "q")]
    got = {r.node: r.scc for r in graph.scc(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {f"{r}{k}": f"{r}0" for r in "abcd" for k in range(3)} | {x: x for x in "zyq"}
    assert all(e.schema["u"].dataType.typeName() == "long" for e in seen)
