"""Analyses that tell one call of a procedure from another: points-to by call strings, and matched calls and returns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornfels.operators.fixpoint import fixpoint, together, union_all
from hornfels.storage import keep, materialise, scratch


@dataclass(frozen=True)
class Program:
    """Facts of a program. A call site has one of ``static`` (i, m, n: site i in procedure m calls n) and ``virtual`` (i, m, v, s: it calls
    what the class of the object in v has for the name s); ``dispatch`` is (h, s, n). Every variable is of one procedure."""

    entry: DataFrame  # m
    variable: DataFrame  # v, m
    new: DataFrame  # v, h
    assign: DataFrame  # v, w: v = w
    load: DataFrame  # v, w, f: v = w.f
    store: DataFrame  # v, f, w: v.f = w
    static: DataFrame  # i, m, n
    virtual: DataFrame  # i, m, v, s
    dispatch: DataFrame  # h, s, n
    argument: DataFrame  # i, z, v: the z-th actual
    parameter: DataFrame  # n, z, v: the z-th formal
    result: DataFrame  # i, v: what the call is assigned to
    returned: DataFrame  # n, v


def _pushed(site: Column, context: Column, k: int) -> Column:
    """The last ``k`` sites, the newest first."""
    return F.slice(F.concat(F.array(site), context), 1, k) if k else F.expr("cast(array() as array<string>)")


def points_to(program: Program, k: int, heap: int | None = None) -> dict[str, DataFrame]:
    """Points-to and call graph together, procedures and variables told apart by the last ``k`` call sites, objects by ``heap`` (k - 1).

    reach(c, m); calls(c, i, d, n): in context c site i calls n in context d; points(c, v, g, h): v in context c may be object h made in
    context g; fields(e, b, f, g, h). A virtual call has the targets of the objects that its variable may be, so the call graph
    grows with what variables point to. Contexts are arrays of site names, at most ``k`` long, and part of all keys. With k = 0 all are empty:
    one copy of each procedure. Recursion is cut by the bound on contexts.

    Variables that nothing reads take no part in the rounds. What they point to follows from the others when these are settled, and is
    made when it is read: nothing is compared for one that has a single source.
    """
    depth = max(0, k - 1) if heap is None else heap
    p = Program(**{name: materialise(d.select([F.col(c).cast("string").alias(c) for c in d.columns]).distinct(), name) for name, d in vars(program).items()})
    spark = p.new.sparkSession
    none = F.expr("cast(array() as array<string>)")
    uses = [p.assign.select("w"), p.load.select("w"), p.store.select("v"), p.store.select("w"), p.virtual.select("v"), p.argument.select("v"), p.returned.select("v")]
    used = materialise(union_all([u.toDF("v") for u in uses]).distinct(), "used")

    def split(facts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Facts whose ``v`` is read, and those whose ``v`` is not."""
        return materialise(facts.join(used, "v", "left_semi"), name), materialise(facts.join(used, "v", "left_anti"), name)

    made, made_last = split(p.new.join(p.variable, "v"), "made")
    assign, assign_last = split(p.assign, "assign")
    load, load_last = split(p.load, "load")
    parameter, parameter_last = split(p.parameter, "parameter")
    result, result_last = split(p.result, "result")
    own_heap = F.slice("c", 1, depth) if depth else none
    read = lambda name, *columns: materialise(spark.createDataFrame([], ", ".join(f"{c} {'array<string>' if c in 'cdeg' else 'string'}" for c in columns)), name)
    bases = {
        "reach": p.entry.select(none.alias("c"), "m"),
        "calls": read("calls", "c", "i", "d", "n"),
        "points": read("points", "c", "v", "g", "h"),
        "fields": read("fields", "e", "b", "f", "g", "h"),
    }
    target = _pushed(F.col("i"), F.col("c"), k).alias("d")

    def step(new: dict[str, DataFrame], known: dict[str, DataFrame]) -> dict[str, list[DataFrame]]:
        def both(a: str, b: str) -> list[tuple[DataFrame, DataFrame]]:
            return [(new[a], known[b]), (known[a], new[b])]

        points, fields, calls = [], [], []
        points.append(new["reach"].join(made, "m").select("c", "v", own_heap.alias("g"), "h"))
        points.append(new["points"].withColumnRenamed("v", "w").join(assign, "w"))
        calls.append(new["reach"].join(p.static, "m").select("c", "i", target, "n"))
        for a, b in both("points", "points"):
            at = a.select("c", "v", F.col("g").alias("e"), F.col("h").alias("b")).join(p.store, "v")
            fields.append(at.join(b.withColumnRenamed("v", "w"), ["c", "w"]))
        for a, b in both("points", "fields"):
            at = a.select("c", F.col("v").alias("w"), F.col("g").alias("e"), F.col("h").alias("b")).join(load, "w")
            points.append(at.join(b, ["e", "b", "f"]))
        for a, b in both("reach", "points"):
            calls.append(a.join(p.virtual, "m").join(b, ["c", "v"]).join(p.dispatch, ["h", "s"]).select("c", "i", target, "n"))
        # the new objects of arguments are few where the calls are many: they are put together before they meet the calls
        given = materialise(new["points"].join(p.argument, "v").select("c", "i", "z", "g", "h"), "given")
        sent = [new["calls"].join(p.argument, "i").join(known["points"], ["c", "v"]).drop("v"), known["calls"].join(given, ["c", "i"])]
        for a in sent:
            points.append(a.join(parameter, ["n", "z"]).select(F.col("d").alias("c"), "v", "g", "h"))
        for a, b in both("calls", "points"):
            back = a.join(result.withColumnRenamed("v", "to"), "i").join(p.returned, "n")
            points.append(back.join(b.withColumnRenamed("c", "d"), ["d", "v"]).select("c", F.col("to").alias("v"), "g", "h"))
        return {"reach": [new["calls"].select(F.col("d").alias("c"), F.col("n").alias("m"))], "calls": calls, "points": points, "fields": fields}

    found = together(bases, step)
    reach, calls_, points, fields = (found[k] for k in ("reach", "calls", "points", "fields"))
    # of variables that nothing reads: (c, v) has what (e, w) has, and objects of its own
    copied = []
    if not assign_last.isEmpty():
        copied.append(points.select("c", F.col("v").alias("w")).join(assign_last, "w").select("c", "v", F.col("c").alias("e"), "w").distinct())
    if not parameter_last.isEmpty():
        sent = calls_.join(p.argument.withColumnRenamed("v", "w"), "i").join(parameter_last, ["n", "z"])
        copied.append(sent.select(F.col("d").alias("c"), "v", F.col("c").alias("e"), "w"))
    if not result_last.isEmpty():
        copied.append(calls_.join(result_last, "i").join(p.returned.withColumnRenamed("v", "w"), "n").select("c", "v", F.col("d").alias("e"), "w"))
    direct = [reach.join(made_last, "m").select("c", "v", own_heap.alias("g"), "h")] if not made_last.isEmpty() else []
    if not load_last.isEmpty():
        at = points.select("c", F.col("v").alias("w"), F.col("g").alias("e"), F.col("h").alias("b")).join(load_last, "w")
        direct.append(at.join(fields, ["e", "b", "f"]).select("c", "v", "g", "h"))
    return found | {"points": union_all([points, *_last(points, copied, direct)])}


def _last(points: DataFrame, copied: list[DataFrame], direct: list[DataFrame]) -> list[DataFrame]:
    """Objects of variables that nothing reads: of those with one source as they are, of all others distinct."""
    if not copied:
        return [union_all(direct).distinct()] if direct else []
    links = union_all(copied)
    marks = links.select("c", "v", F.struct("e", "w").alias("s"), F.lit(False).alias("own"))
    for d in direct:
        marks = marks.union(d.select("c", "v", F.lit(None).cast(marks.schema["s"].dataType), F.lit(True)))
    of = materialise(marks.groupBy("c", "v").agg(F.min("s").alias("s"), F.max("s").alias("t"), F.max("own").alias("own")).select("c", "v", "s.e", "s.w", (F.col("own") | (F.col("s") != F.col("t"))).alias("several")), "sources")
    single, several = of.where("not several").drop("several"), of.where("several").select("c", "v")
    # sources are few where they are shared, so that they are sent to the variables, not these to them
    value = points.select(F.col("c").alias("e"), F.col("v").alias("w"), "g", "h")
    value = materialise(value.join(of.where("w is not null").select("e", "w").distinct(), ["e", "w"], "left_semi"), "values")
    out = [single.join(value, ["e", "w"]).select("c", "v", "g", "h")]
    if not several.isEmpty():
        mixed = links.join(several, ["c", "v"], "left_semi").join(points.select(F.col("c").alias("e"), F.col("v").alias("w"), "g", "h"), ["e", "w"]).select("c", "v", "g", "h")
        out.append(union_all([mixed, *direct]).distinct())
    return out


def summaries(intra: DataFrame, call: DataFrame, back: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, summary): ``paths`` (e, v) leads from a procedure's entry e to v by matched calls, ``summary`` (u, v) over a whole call.

    ``intra`` (u, v) are edges within procedures, ``call`` (u, v, i) lead from a call to an entry and ``back`` (u, v, i) from an exit to behind
    the call, of one site i. Entries are the nodes that calls lead to; recursion needs no bound, since a path is kept by its ends only.
    """
    intra, call, back = (materialise(d.distinct(), "edges") for d in (intra, call, back))
    entries = call.select(F.col("v").alias("e"), F.col("v").alias("v")).distinct()
    whole = call.select(F.col("u").alias("a"), F.col("v").alias("e"), "i")
    exits = back.select(F.col("u").alias("v"), F.col("v").alias("w"), "i")

    def step(new: dict[str, DataFrame], known: dict[str, DataFrame]) -> dict[str, list[DataFrame]]:
        on = lambda paths, edges: paths.withColumnRenamed("v", "u").join(edges, "u").select("e", "v")
        paths = [on(new["paths"], intra), on(new["paths"], known["summary"]), on(known["paths"], new["summary"])]
        over = new["paths"].join(exits, "v").join(whole, ["e", "i"]).select(F.col("a").alias("u"), F.col("w").alias("v"))
        return {"paths": paths, "summary": [over]}

    found = together({"paths": entries, "summary": intra.limit(0)}, step)
    return found["paths"], found["summary"]


def matched_reach(intra: DataFrame, call: DataFrame, back: DataFrame, start: DataFrame) -> DataFrame:
    """``node``s that runs from ``start`` (column node) can reach: every return on the way matches its call, calls may stay open."""
    with scratch(start.sparkSession):
        _, summary = summaries(intra, call, back)
        edges = materialise(intra.unionByName(summary).unionByName(call.select("u", "v")).distinct(), "edges")
        found = fixpoint(start.select("node"), lambda new, _: new.join(edges, F.col("node") == F.col("u")).select(F.col("v").alias("node")))
        return keep(found, "reached")


def two_pass_slice(intra: DataFrame, call: DataFrame, back: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, pass): what the ``seeds`` (column node) depend on, over edges from cause to effect.

    Pass 1 goes back within procedures, over whole calls and up to callers; pass 2 goes on from all of it down into the procedures called,
    and never up again. So no path comes out of a procedure at another place than it went in.
    """
    with scratch(seeds.sparkSession):
        _, summary = summaries(intra, call, back)
        level = materialise(intra.unionByName(summary).distinct(), "level")

        def backwards(begin: DataFrame, more: DataFrame) -> DataFrame:
            edges = materialise(level.unionByName(more.select("u", "v")).distinct(), "edges")
            return fixpoint(begin, lambda new, _: new.join(edges, F.col("node") == F.col("v")).select(F.col("u").alias("node")))

        first = materialise(backwards(seeds.select("node"), call), "first")
        second = backwards(first, back)
        return keep(second.join(first.withColumn("pass", F.lit(1)), "node", "left").select("node", F.coalesce("pass", F.lit(2)).alias("pass")), "slice")
