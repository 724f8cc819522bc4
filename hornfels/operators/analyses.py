"""Program analyses over relations of a program's facts, as mutually recursive rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornfels.operators.fixpoint import fixpoint, together, union_all
from hornfels.operators.graph import closure_by_doubling, reach
from hornfels.storage import materialise


def points_to(new: DataFrame, assign: DataFrame, load: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vh, hfh): what variables and fields can point to, whatever the order of statements.

    new(v, h), assign(v, w) for v = w, load(v, w, f) for v = w.f, store(v, f, w) for v.f = w, all strings. Both relations
    grow in one fixpoint; variables that no statement reads take no part in the rounds after theirs.
    """
    base = new.select("v", "h")
    # objects of loads' and stores' variables are relations of their own, so that facts meet a variable's new objects once each
    text = lambda *names: base.sparkSession.createDataFrame([], ", ".join(f"{n} string" for n in names))
    bases = {"vh": base, "hfh": text("b", "f", "h"), "written": text("b", "f", "w"), "read": text("v", "b", "f")}
    uses = [(assign.select("w"), 1), (store.select("v"), 2), (store.select("w"), 4), (load.select("w"), 8)]
    used = union_all([u.toDF("v").withColumn("use", F.lit(bit)) for u, bit in uses]).groupBy("v").agg(F.bit_or("use").alias("use"))
    used = materialise(used, "used")

    def step(new_: dict[str, DataFrame], known: dict[str, DataFrame]) -> dict[str, list[DataFrame]]:
        out: dict[str, list[DataFrame]] = {"vh": [], "hfh": [], "written": [], "read": []}
        if not new_["vh"].isEmpty():
            fresh = materialise(new_["vh"].join(used, "v").select("v", "h", "use"), "fresh")
            copied, stored, value, loaded = (fresh.where(F.col("use").bitwiseAND(F.lit(bit)) != 0).select("v", "h") for _, bit in uses)
            if not copied.isEmpty():
                out["vh"].append(copied.toDF("w", "h").join(assign, "w").select("v", "h"))
            if not stored.isEmpty():
                out["written"].append(stored.toDF("v", "b").join(store, "v").select("b", "f", "w"))
            if not value.isEmpty():
                out["hfh"].append(known["written"].join(value.toDF("w", "h"), "w").select("b", "f", "h"))
            if not loaded.isEmpty():
                # rows of a variable stay together, so that its objects are put together before they are sent
                out["read"].append(loaded.toDF("w", "b").join(load, "w").select("v", "b", "f").repartition("v"))
        if not new_["written"].isEmpty():
            out["hfh"].append(new_["written"].join(known["vh"].toDF("w", "h"), "w").select("b", "f", "h"))
        if not new_["read"].isEmpty():
            out["vh"].append(new_["read"].join(known["hfh"], ["b", "f"]).select("v", "h"))
        if not new_["hfh"].isEmpty():
            out["vh"].append(known["read"].join(new_["hfh"], ["b", "f"]).select("v", "h"))
        return {k: parts for k, parts in out.items() if parts}

    all_ = together(bases, step)
    return all_["vh"], all_["hfh"]


def aliases(vh: DataFrame) -> DataFrame:
    """Pairs v < w of variables that may point to one object."""
    a, b = vh.toDF("v", "h"), vh.toDF("w", "h")
    return a.join(b, "h").where("v < w").select("v", "w").distinct()


def escaping(roots: DataFrame, hfh: DataFrame) -> DataFrame:
    """Objects reachable from ``roots`` (column ``h``: what statics and started threads hold)."""
    return reach(hfh.select(F.col("b").alias("u"), F.col("h").alias("v")), roots.select(F.col("h").alias("node"))).toDF("h")


def _grouped(one: DataFrame, two: DataFrame, on: list[str], groups: DataFrame) -> DataFrame:
    """``one`` (with t) joined with ``two`` (with s) where t and s are different threads of a group."""
    of = groups.select(*[F.col(c).alias(k) for c, k in zip(groups.columns, ("t", "_group"), strict=True)]).distinct()
    return one.join(of, "t").join(two.join(of.withColumnRenamed("t", "s"), "s"), [*on, "_group"]).where("t <> s")


def races(access: DataFrame, locks: DataFrame, parallel: DataFrame | None, groups: DataFrame | None = None) -> DataFrame:
    """Pairs e <= d of accesses to one object that can run in parallel, one a write, without a common lock.

    access(e, t, h, write), locks(e, l), parallel(t, s), which is symmetric, or ``groups`` in its place, as for deadlocks.
    Locks are looked up for the pairs in question only.
    """
    a = access.toDF("e", "t", "h", "x")
    b = access.toDF("d", "s", "h", "y")
    both = a.join(b, "h").join(parallel.toDF("t", "s"), ["t", "s"], "left_semi") if groups is None else _grouped(a, b, ["h"], groups)
    pairs = materialise(both.where("e <= d and (x or y)").select("e", "d").distinct(), "pairs")
    guarded = pairs.join(locks.toDF("e", "l"), "e").join(locks.toDF("d", "l"), ["d", "l"], "left_semi").select("e", "d").distinct()
    return pairs.join(guarded, ["e", "d"], "left_anti")


def deadlocks(holds: DataFrame, parallel: DataFrame | None, escaping: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(t, s, l, m) with l < m: t takes m while it holds l, s takes l while it holds m, and no lock guards both.

    holds(t, a, l, m): in acquisition ``a`` thread t takes m while it holds l, a row for each l held. Threads must
    be able to run in parallel (a symmetric relation of t and s; a thread in parallel with itself is two of its
    kind; or, with ``groups`` (thread and group) in its place, different threads of a group, whose pairs are not formed), locks must be reachable by others (``escaping``, column l; all are by default), and no third lock may be
    held at both acquisitions.
    """
    shared = holds.toDF("t", "a", "l", "m").where("l <> m").distinct()
    if escaping is not None:
        shared = shared.join(escaping.toDF("l"), "l", "left_semi").join(escaping.toDF("m"), "m", "left_semi").select("t", "a", "l", "m")
    one, two = shared.where("l < m"), shared.where("l > m").toDF("s", "b", "m", "l")
    both = one.join(two, ["l", "m"]).join(parallel.toDF("t", "s"), ["t", "s"], "left_semi") if groups is None else _grouped(one, two, ["l", "m"], groups)
    pairs = materialise(both.select("t", "a", "s", "b", "l", "m").distinct(), "pairs")
    held = holds.toDF("t", "a", "g", "m").select("t", "a", "g").distinct()
    both = pairs.join(held, ["t", "a"]).where("g <> l and g <> m").join(held.toDF("s", "b", "g"), ["s", "b", "g"], "left_semi")
    free = pairs.join(both.select("t", "a", "s", "b", "l", "m").distinct(), ["t", "a", "s", "b", "l", "m"], "left_anti")
    return free.select("t", "s", "l", "m").distinct()


def flows(sources: DataFrame, edges: DataFrame, sinks: DataFrame, cleaners: DataFrame) -> DataFrame:
    """(source, sink) of values that reach a sink past no cleaner; each has a column ``node``."""
    open_ = edges.join(cleaners.select(F.col("node").alias("v")), "v", "left_anti")
    start = sources.select(F.col("node").alias("source"), "node")
    onward = materialise(open_.select(F.col("u").alias("node"), "v").distinct(), "edges")
    reached = fixpoint(start, lambda new, _: new.join(onward, "node").select("source", F.col("v").alias("node")))
    return reached.join(sinks.select("node"), "node", "left_semi").select("source", F.col("node").alias("sink"))


def parallel(starts: DataFrame, joins: DataFrame) -> DataFrame:
    """(t, s), symmetric: threads that may run at once.

    starts(t, s): t starts s; joins(t, s): t waits for s before it starts anything else. A started thread, and
    what it starts in turn, runs beside its starter unless that waits for it, and beside what the starter starts
    afterwards; without an order of statements any two threads of one starter that are not waited for run at once.
    """
    free = materialise(starts.toDF("t", "s").join(joins.toDF("t", "s"), ["t", "s"], "left_anti").distinct(), "free")
    below = closure_by_doubling(starts.toDF("u", "v"))
    under = materialise(below.union(starts.select(F.col("s").alias("u"), F.col("s").alias("v"))).distinct(), "below")
    down = lambda d, c: d.join(under.toDF(c, f"_{c}"), c).drop(c).withColumnRenamed(f"_{c}", c)
    beside = down(free, "s").select("t", "s")
    a, b = free.toDF("p", "t"), free.toDF("p", "s")
    siblings = down(down(a.join(b, "p").where("t <> s").select("t", "s"), "t"), "s").select("t", "s")
    out = beside.union(siblings).where("t <> s").distinct()
    return out.union(out.select(F.col("s").alias("t"), F.col("t").alias("s"))).distinct()


def unsafe_casts(vh: DataFrame, objects: DataFrame, subtypes: DataFrame, casts: DataFrame) -> DataFrame:
    """``cast``s of a variable that may hold an object of a type which is none of the cast's: casts(cast, v, type), objects(h, type), subtypes(sub, type), reflexive."""
    may = casts.toDF("cast", "v", "type").join(vh.toDF("v", "h"), "v").join(objects.toDF("h", "sub"), "h").select("cast", "sub", "type").distinct()
    return may.join(subtypes.toDF("sub", "type"), ["sub", "type"], "left_anti").select("cast").distinct()


def call_targets(vh: DataFrame, objects: DataFrame, methods: DataFrame, calls: DataFrame) -> DataFrame:
    """(call, method) of virtual calls: calls(call, v, name), objects(h, type), methods(type, name, method)."""
    return calls.toDF("call", "v", "name").join(vh.toDF("v", "h"), "v").join(objects.toDF("h", "type"), "h").join(methods.toDF("type", "name", "method"), ["type", "name"]).select("call", "method").distinct()


def site_kinds(targets: DataFrame) -> DataFrame:
    """``call`` and whether it is polymorphic: has more than one method."""
    return targets.groupBy("call").agg((F.count_distinct("method") > 1).alias("poly"))


def null_dereferences(uses: DataFrame, vh: DataFrame) -> DataFrame:
    """``use``s (columns use, v) of a variable that can point to nothing."""
    return uses.toDF("use", "v").join(vh.toDF("v", "h").select("v").distinct(), "v", "left_anti").select("use").distinct()


def backward_slice(depends: DataFrame, criteria: DataFrame) -> DataFrame:
    """Statements that ``criteria`` (column ``node``) depend on: depends(u, v) says that u depends on v."""
    return reach(depends, criteria)


def equal_classes(equal: DataFrame) -> DataFrame:
    """``node`` and ``root`` of classes under an equality relation, as unification-based points-to needs them."""
    from hornfels.operators.components import components

    return components(equal)
