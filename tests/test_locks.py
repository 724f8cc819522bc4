"""Lock checks against a walk over each thread's events."""

import random

from hornfels.operators import locks as K

LOG = "thread long, seq long, lock string, acquired boolean"


def walk(log):
    """thread, seq -> locks held before the event, and the acquisitions that were of a free lock."""
    depth, before, taken = {}, {}, []
    for t, q, lock, up in sorted(log, key=lambda r: r[:2]):
        mine = depth.setdefault(t, {})
        before[t, q] = {k for k, n in mine.items() if n > 0}
        if up and not mine.get(lock):
            taken.append((t, q, lock))
        mine[lock] = max(0, mine.get(lock, 0) + (1 if up else -1))
    return before, taken


def test_orders_deadlocks_and_unguarded_variables(spark):
    rng = random.Random(3)
    log = [(t, 3 * k, rng.choice("abcd"), rng.random() < 0.5) for t in range(4) for k in range(25)]
    before, taken = walk(log)
    rows = spark.createDataFrame(log, LOG)
    want = {(u, v, t) for t, q, v in taken for u in before[t, q]}
    for chunk in (4, 1024):  # cut in many places, or nowhere
        got = {(r.u, r.v): r.threads for r in K.lock_order(rows, chunk).collect()}
        assert got == {(u, v): len({t for a, b, t in want if (a, b) == (u, v)}) for u, v, _ in want}
    steps = [(t, u, v, before[t, q] - {u}) for t, q, v in taken for u in before[t, q]]
    dead = {(u, v) for t, u, v, g in steps for s, x, y, h in steps if u < v and (x, y) == (v, u) and t != s and not g & h}
    assert {tuple(r) for r in K.deadlocks(rows, 8).collect()} == dead
    points = [(t, 3 * k + 1, f"v{k % 7 if t else 9}", k % 2 == 0) for t in range(4) for k in range(24)]
    seen = {}
    for t, q, var, w in points:
        # what is held between two events is what is held before the next one
        seen.setdefault(var, []).append((t, w, before[t, q + 2]))
    bare = {v for v, xs in seen.items() if len({t for t, _, _ in xs}) > 1 and any(w for _, w, _ in xs) and not set.intersection(*[h for _, _, h in xs])}
    access = spark.createDataFrame(points, "thread long, seq long, var string, writes boolean")
    assert {r["var"] for r in K.unguarded(rows, access, 8).collect()} == bare and bare


def test_locks_of_odd_logs(spark):
    frame = lambda rows: spark.createDataFrame(rows, LOG)
    assert K.lock_order(frame([])).count() == 0 and K.deadlocks(frame([])).count() == 0
    gate = [(1, 1, "g", True), (1, 2, "a", True), (1, 3, "b", True), (2, 1, "g", True), (2, 2, "b", True), (2, 3, "a", True)]
    assert K.deadlocks(frame(gate)).count() == 0  # both hold the gate
    assert [tuple(r) for r in K.deadlocks(frame([r for r in gate if r[2] != "g"])).collect()] == [("a", "b")]
    again = [(1, 1, "a", False), (1, 2, "a", True), (1, 3, "a", True), (1, 4, "a", False), (1, 5, "b", True), (1, 6, "a", False), (1, 7, "c", True), (1, 8, None, True)]
    assert {(r.u, r.v) for r in K.lock_order(frame(again)).collect()} == {("a", "b"), ("b", "c")}


def test_sparse_numbers_cut_no_spell(spark):
    """Chunks follow a thread's own events: numbers that lie far apart make no pieces, so the log below fits in one a thread."""
    log = [(t, 10**15 * (k * 3 + t), "ab"[k % 2], k < 2) for t in range(3) for k in range(4)]
    rows = spark.createDataFrame(log, LOG)
    assert [tuple(r) for r in K.lock_order(rows).collect()] == [("a", "b", 3)]
    points = spark.createDataFrame([(0, 4 * 10**15, "x"), (1, 10**18, "y")], "thread long, seq long, `a.b` string")
    assert {(r.thread, r["a.b"], r.held) for r in K.held(rows, points).collect()} == {(0, "x", "a"), (0, "x", "b")}
