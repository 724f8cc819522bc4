"""Contexts and matched calls against plain loops over call strings and stacks."""

import random

import pytest

from hornfels.operators import analyses, calls

FACTS = {
    "entry": "m", "variable": "v m", "new": "v h", "assign": "v w", "load": "v w f", "store": "v f w", "static": "i m n", "virtual": "i m v s",
    "dispatch": "h s n", "argument": "i z v", "parameter": "n z v", "result": "i v", "returned": "n v",
}


def program(spark, **facts):
    frames = {k: spark.createDataFrame([tuple(map(str, r)) for r in facts.get(k, [])], ", ".join(f"{c} string" for c in cols.split())) for k, cols in FACTS.items()}
    return calls.Program(**frames)


def plain(facts, k, heap):
    """All rules over and over, on sets."""
    f = {name: {tuple(map(str, r)) for r in facts.get(name, [])} for name in FACTS}
    reach, call, points, fields = {((), m) for (m,) in f["entry"]}, set(), set(), set()
    while True:
        size = len(reach) + len(call) + len(points) + len(fields)
        push = lambda i, c: ((i, *c)[:k]) if k else ()
        points |= {(c, v, c[:heap], h) for c, m in reach for v, h in f["new"] if (v, m) in f["variable"]}
        points |= {(c, v, g, h) for c, w, g, h in points for v, x in f["assign"] if x == w}
        fields |= {(e, b, fld, g, h) for c, v, e, b in points for x, fld, w in f["store"] if x == v for c2, w2, g, h in points if (c2, w2) == (c, w)}
        points |= {(c, v, g, h) for c, w, e, b in points for v, x, fld in f["load"] if x == w for e2, b2, f2, g, h in fields if (e2, b2, f2) == (e, b, fld)}
        call |= {(c, i, push(i, c), n) for c, m in reach for i, x, n in f["static"] if x == m}
        call |= {(c, i, push(i, c), n) for c, m in reach for i, x, v, s in f["virtual"] if x == m for c2, v2, _, h in points if (c2, v2) == (c, v) for h2, s2, n in f["dispatch"] if (h2, s2) == (h, s)}
        reach |= {(d, n) for _, _, d, n in call}
        points |= {(d, p, g, h) for c, i, d, n in call for j, z, a in f["argument"] if j == i for n2, z2, p in f["parameter"] if (n2, z2) == (n, z) for c2, v, g, h in points if (c2, v) == (c, a)}
        points |= {(c, r, g, h) for c, i, d, n in call for j, r in f["result"] if j == i for n2, x in f["returned"] if n2 == n for d2, v, g, h in points if (d2, v) == (d, x)}
        if size == len(reach) + len(call) + len(points) + len(fields):
            return {"reach": reach, "calls": call, "points": points, "fields": fields}


EXAMPLE = {
    "entry": [("main",)],
    "variable": [("a", "main"), ("b", "main"), ("x", "main"), ("y", "main"), ("p", "id"), ("q", "wrap"), ("r", "wrap"), ("this", "A.go"), ("that", "B.go"), ("o", "A.go"), ("z", "main"), ("u", "rec")],
    "new": [("a", "hA"), ("b", "hB"), ("o", "hO")],
    "static": [("i1", "main", "wrap"), ("i2", "main", "wrap"), ("i3", "wrap", "id"), ("i5", "main", "rec"), ("i6", "rec", "rec")],
    "virtual": [("i4", "main", "x", "go")],
    "dispatch": [("hA", "go", "A.go"), ("hB", "go", "B.go")],
    "argument": [("i1", 0, "a"), ("i2", 0, "b"), ("i3", 0, "q"), ("i4", 0, "x"), ("i5", 0, "a"), ("i6", 0, "u")],
    "parameter": [("wrap", 0, "q"), ("id", 0, "p"), ("A.go", 0, "this"), ("B.go", 0, "that"), ("rec", 0, "u")],
    "result": [("i1", "x"), ("i2", "y"), ("i3", "r")],
    "returned": [("wrap", "r"), ("id", "p")],
    "store": [("this", "f", "o"), ("a", "g", "b")],
    "load": [("z", "a", "f"), ("z", "x", "g")],
}


@pytest.mark.parametrize("k", [0, 2])
def test_points_to_by_call_strings(spark, k):
    got = calls.points_to(program(spark, **EXAMPLE), k)
    want = plain(EXAMPLE, k, max(0, k - 1))
    for name, rows in want.items():
        assert {tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in got[name].collect()} == rows, name
    targets = {r.n for r in got["calls"].where("i = 'i4'").collect()}
    assert targets == ({"A.go"} if k == 2 else {"A.go", "B.go"})  # two sites deep the wrapped identity keeps a and b apart


def test_variables_that_nothing_reads_stay_out_of_the_rounds(spark, monkeypatch):
    """They have one source or several, objects of their own, loads, and parameters, each alone and together; none is in the rounds."""
    more = {
        "variable": [*EXAMPLE["variable"], *[(v, "main") for v in ("s1", "s2", "s3", "s4", "s5")], ("q2", "wrap")],
        "assign": [("s1", "a"), ("s2", "a"), ("s2", "b"), ("s3", "x"), ("s5", "s0")],
        "new": [*EXAMPLE["new"], ("s3", "hS"), ("s4", "hS")],
        "load": [*EXAMPLE["load"], ("s2", "x", "g")],
        "result": [*EXAMPLE["result"], ("i1", "s2")],
        "parameter": [*EXAMPLE["parameter"], ("wrap", 0, "q2")],
    }
    seen = []
    real = calls.together
    monkeypatch.setattr(calls, "together", lambda *a: seen.append(out := real(*a)) or out)
    got = calls.points_to(program(spark, **EXAMPLE | more), 1)
    want = plain(EXAMPLE | more, 1, 0)["points"]
    rows = [tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in got["points"].collect()]
    assert len(rows) == len(want) and set(rows) == want
    unread = {"s1", "s2", "s3", "s4", "s5", "y", "z", "q2", "that"}
    assert {v for _, v, _, _ in want} & unread == unread - {"s5"} and not {r.v for r in seen[0]["points"].collect()} & unread


def test_no_calls_and_no_contexts_is_the_plain_analysis(spark):
    rng = random.Random(6)
    v = [f"v{k}" for k in range(8)]
    facts = {
        "entry": [("main",)], "variable": [(x, "main") for x in v], "new": [(x, f"h{rng.randrange(4)}") for x in v[:5]], "assign": [(rng.choice(v), rng.choice(v)) for _ in range(6)],
        "load": [(rng.choice(v), rng.choice(v), "f") for _ in range(4)], "store": [(rng.choice(v), "f", rng.choice(v)) for _ in range(4)],
    }
    p = program(spark, **facts)
    got = calls.points_to(p, 0)
    vh, hfh = analyses.points_to(p.new, p.assign, p.load, p.store)
    assert {(r.v, r.h) for r in got["points"].collect()} == {tuple(r) for r in vh.collect()}
    assert {(r.b, r.f, r.h) for r in got["fields"].collect()} == {tuple(r) for r in hfh.collect()}


def graph(seed):
    """Procedures with entry, body and exit nodes, random inner edges, and calls, some recursive."""
    rng = random.Random(seed)
    nodes = {p: [f"{p}{k}" for k in range(5)] for p in "abcd"}
    intra = {(n[x], n[y]) for n in nodes.values() for x, y in [(rng.randrange(5), rng.randrange(5)) for _ in range(6)]}
    call, back = set(), set()
    for i in range(6):
        u, q = rng.choice("abcd"), rng.choice("abcd")
        x, y = rng.sample(nodes[u][1:], 2)
        call.add((x, nodes[q][0], f"i{i}"))
        back.add((nodes[q][4], y, f"i{i}"))
    return intra, call, back, [n for ns in nodes.values() for n in ns]


def balanced(intra, call, back, nodes):
    """Pairs with a path in which calls and returns match."""
    pairs = {(n, n) for n in nodes}
    while True:
        more = {(a, v) for a, u in pairs for x, v in intra if x == u}
        inside = {(u, w) for u, e, i in call for x, w, j in back if i == j and (e, x) in pairs}
        more |= {(a, v) for a, u in pairs for x, v in inside if x == u}
        if more <= pairs:
            return pairs
        pairs |= more


@pytest.mark.parametrize("seed", [1])
def test_matched_reach_and_slices(spark, seed):
    intra, call, back, nodes = graph(seed)
    pairs = balanced(intra, call, back, nodes)
    frames = [spark.createDataFrame(sorted(e), s) for e, s in ((intra, "u string, v string"), (call, "u string, v string, i string"), (back, "u string, v string, i string"))]
    paths, _ = calls.summaries(*frames)
    entries = {e for _, e, _ in call}
    assert {tuple(r) for r in paths.collect()} == {p for p in pairs if p[0] in entries}

    def grown(begin, ahead):
        seen = set(begin)
        while more := {y for x in seen for y in ahead(x)} - seen:
            seen |= more
        return seen

    start = spark.createDataFrame([("a1",), ("b2",)], "node string")
    ahead = lambda x: {b for a, b in pairs if a == x} | {e for u, e, _ in call if u == x}
    assert {r.node for r in calls.matched_reach(*frames, start).collect()} == grown({"a1", "b2"}, ahead)
    up = grown({"a1", "b2"}, lambda y: {a for a, b in pairs if b == y} | {u for u, e, _ in call if e == y})
    down = grown(up, lambda y: {a for a, b in pairs if b == y} | {x for x, w, _ in back if w == y})
    assert {(r.node, r["pass"]) for r in calls.two_pass_slice(*frames, start).collect()} == {(n, 1 if n in up else 2) for n in down}


def test_empty_graphs(spark):
    edges, sites, none = (spark.createDataFrame([], s) for s in ("u string, v string", "u string, v string, i string", "node string"))
    assert calls.matched_reach(edges, sites, sites, none).count() == 0 and calls.two_pass_slice(edges, sites, sites, none).count() == 0
