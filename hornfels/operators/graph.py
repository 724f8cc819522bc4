"""Graph operators over edge tables (columns ``u`` and ``v``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hornfels.operators.components import components
from hornfels.operators.fixpoint import fixpoint, union_all
from hornfels.operators.relational import fellows
from hornfels.storage import keep, materialise, scratch


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()


def roots(edges: DataFrame) -> DataFrame:
    return nodes_of(edges).join(edges.select(F.col("v").alias("node")), "node", "left_anti")


def closure(edges: DataFrame) -> DataFrame:
    """Pairs joined by a path of one edge or more: linear rules, a round for each length."""
    edges = materialise(edges.select("u", "v").distinct(), "edges")
    onward = edges.select(F.col("u").alias("v"), F.col("v").alias("w"))
    return fixpoint(edges, lambda new, _: new.join(onward, "v").select("u", F.col("w").alias("v")))


def closure_by_doubling(edges: DataFrame) -> DataFrame:
    """The same by joining paths with paths: as many rounds as the logarithm of the longest path."""
    left = lambda d: d.select("u", F.col("v").alias("m"))
    right = lambda d: d.select(F.col("u").alias("m"), "v")

    def step(new: DataFrame, known: DataFrame) -> DataFrame:
        return left(new).join(right(known), "m").select("u", "v").union(left(known).join(right(new), "m").select("u", "v"))

    return fixpoint(edges.select("u", "v"), step)


def closure_by_classes(edges: DataFrame) -> DataFrame:
    """The same of a graph with cycles: paths are joined with paths between strongly connected components only.

    Within a component every node reaches every other, so joining its pairs would derive each as often as it has nodes; here
    its members are put in at the end, and every pair is made once.
    """
    edges = materialise(edges.select("u", "v").distinct(), "edges")
    classes = materialise(scc(edges), "scc")
    loops = cycle_edges(edges, classes).join(classes.toDF("u", "c"), "u").select(F.col("c").alias("u"), F.col("c").alias("v")).distinct()
    between = closure_by_doubling(condensed(edges, classes)).select(F.col("u").alias("cu"), F.col("v").alias("cv")).union(loops)
    return between.join(classes.toDF("v", "cv"), "cv").join(classes.toDF("u", "cu"), "cu").select("u", "v")


def closure_no_self(edges: DataFrame) -> DataFrame:
    """Closure that composes pairs of three different nodes only: loops stay, cycles add none."""
    plain = edges.where("u <> v").select("u", "v")
    return closure_by_classes(plain).where("u <> v").union(edges.where("u = v").select("u", "v").distinct())


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``node``s reachable from ``start`` (column ``node``), itself included."""
    onward = materialise(edges.select(F.col("u").alias("node"), "v").distinct(), "edges")
    return fixpoint(start.select("node"), lambda new, _: new.join(onward, "node").select(F.col("v").alias("node")))


def hops(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """Nodes within ``most`` edges of ``start``, and the fewest edges."""
    seen = start.select("node").distinct().withColumn("hops", F.lit(0))
    parts = [materialise(seen, "hops")]
    onward = materialise(edges.select(F.col("u").alias("node"), "v").distinct(), "edges")
    for k in range(1, most + 1):
        new = parts[-1].join(onward, "node").select(F.col("v").alias("node")).distinct()
        new = materialise(new.join(union_all(parts), "node", "left_anti").withColumn("hops", F.lit(k)), "hops")
        if new.isEmpty():
            break
        parts.append(new)
    return union_all(parts)


def shortest(edges: DataFrame, most: int = 1000) -> DataFrame:
    """u, v and the fewest edges of a path from u to v (u = v: of a cycle), round by round from all sources.

    The result has a row for each pair that a path joins; paths of more than ``most`` edges are an error.
    """
    edges = materialise(edges.select("u", "v").distinct(), "edges")
    onward = edges.select(F.col("u").alias("v"), F.col("v").alias("w"))
    parts = [materialise(edges.withColumn("dist", F.lit(1)), "dist")]
    for k in range(2, most + 2):
        new = parts[-1].join(onward, "v").select("u", F.col("w").alias("v")).distinct()
        new = materialise(new.join(union_all(parts), ["u", "v"], "left_anti").withColumn("dist", F.lit(k)), "dist")
        if new.isEmpty():
            return union_all(parts)
        parts.append(new)
    raise RuntimeError(f"there are paths of more than {most} edges")


def _without_ends(edges: DataFrame, rounds: int) -> DataFrame:
    """The edges left once nodes without an edge in, or without one out, are taken away again and again."""
    for _ in range(rounds):
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("v", F.lit(0), F.lit(1)))
        inner = ends.groupBy("node").agg(F.max("o").alias("o"), F.max("i").alias("i")).where("o = 1 and i = 1").select("node")
        left = edges.join(inner.withColumnRenamed("node", "u"), "u", "left_semi").join(inner.withColumnRenamed("node", "v"), "v", "left_semi")
        left = materialise(left.select("u", "v"), "edges")
        if left.count() == edges.count():
            return left
        edges = left
    raise RuntimeError(f"nodes at the ends are still left after {rounds} rounds")


def _colours(edges: DataFrame, rounds: int) -> DataFrame:
    """node and the least node that reaches it, or itself."""
    colours = materialise(nodes_of(edges).select("node", F.col("node").alias("colour"), F.lit(True).alias("new")), "colours")
    for _ in range(rounds):
        sent = colours.where("new").join(edges.withColumnRenamed("u", "node"), "node").groupBy("v").agg(F.min("colour").alias("least"))
        better = F.coalesce(F.col("least") < F.col("colour"), F.lit(False))
        colours = colours.join(sent.withColumnRenamed("v", "node"), "node", "left").select("node", F.least("colour", F.coalesce("least", "colour")).alias("colour"), better.alias("new"))
        colours = materialise(colours, "colours")
        if colours.where("new").isEmpty():
            return colours.select("node", "colour")
    raise RuntimeError(f"colours are not settled in {rounds} rounds")


def scc(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """``node`` and ``scc``: the least node of its strongly connected component.

    No closure is built. Nodes at the ends are trimmed; every other node takes the least node that reaches it as
    its colour, and what reaches a colour's own node inside the colour is one component. Components leave, and
    what is left goes on, without edges between colours, as none of them is in a component. The tables have a row a node
    or an edge, and numbers in place of names; rounds follow the longest paths.
    """
    all_ = materialise(nodes_of(edges).select("node", F.monotonically_increasing_id().alias("id")), "nodes")
    number = lambda c, n: all_.select(F.col("node").alias(c), F.col("id").alias(n))
    found: list[DataFrame] = []
    with scratch(edges.sparkSession):
        left = edges.where("u <> v").select("u", "v").distinct().join(number("u", "iu"), "u").join(number("v", "iv"), "v")
        left = materialise(left.select(F.col("iu").alias("u"), F.col("iv").alias("v")), "edges")
        for _ in range(rounds):
            left = _without_ends(left, rounds)
            if left.isEmpty():
                break
            colours = _colours(left, rounds)
            inside = left.join(colours.toDF("u", "cu"), "u").join(colours.toDF("v", "cv"), "v").where("cu = cv").select("u", "v")
            back = materialise(inside.select(F.col("v").alias("node"), F.col("u").alias("w")), "back")
            # all of a component have its colour's node as colour, so a search backwards in the colour finds it whole
            start = colours.where("node = colour")
            whole = fixpoint(start, lambda new, _, back=back: new.join(back, "node").select(F.col("w").alias("node"), "colour"))
            whole = keep(whole.select("node", F.col("colour").alias("scc")), "scc")
            found.append(whole)
            gone = whole.select("node")
            left = back.select(F.col("w").alias("u"), F.col("node").alias("v")).join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti")
            left = materialise(left.select("u", "v"), "edges")
        else:
            raise RuntimeError(f"components are not settled in {rounds} rounds")
    if not found:
        return all_.select("node", F.col("node").alias("scc"))
    named = union_all(found).toDF("id", "c").join(all_, "id")
    named = named.join(named.groupBy("c").agg(F.min("node").alias("scc")), "c").select("node", "scc")
    return all_.select("node").join(named, "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))


def cycle_edges(edges: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Edges on some cycle: loops, and edges inside a strongly connected component."""
    classes = materialise(scc(edges), "scc") if classes is None else classes
    ends = edges.select("u", "v").distinct().join(classes.toDF("u", "cu"), "u").join(classes.toDF("v", "cv"), "v")
    return ends.where("cu = cv").select("u", "v")


def in_cycles(edges: DataFrame) -> DataFrame:
    """``node``s on some cycle, loops included."""
    return cycle_edges(edges).select(F.col("u").alias("node")).distinct()


def condensed(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between different components, named by their least nodes; an acyclic graph."""
    ends = edges.select("u", "v").join(classes.toDF("u", "cu"), "u").join(classes.toDF("v", "cv"), "v")
    return ends.where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct()


def scc_levels(edges: DataFrame) -> DataFrame:
    """``scc`` and ``level``: an order of the components in which every edge goes to a higher level."""
    classes = materialise(scc(edges), "scc")
    deep = levels(condensed(edges, classes)).select(F.col("node").alias("scc"), "level")
    return classes.select("scc").distinct().join(deep, "scc", "left").select("scc", F.coalesce("level", F.lit(0)).alias("level"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_out and n_in over distinct edges, in one aggregation."""
    e = edges.select("u", "v").distinct()
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def levels(edges: DataFrame, most: int = 1000) -> DataFrame:
    """Longest path from a root to each node of an acyclic graph. Each round keeps the nodes of deeper levels only."""
    now = materialise(nodes_of(edges), "level")
    onward = materialise(edges.select(F.col("u").alias("node"), "v").distinct(), "edges")
    parts = []
    for k in range(most):
        deeper = materialise(now.join(onward, "node").select(F.col("v").alias("node")).distinct(), "level")
        parts.append(now.join(deeper, "node", "left_anti").withColumn("level", F.lit(k)))
        if deeper.isEmpty():
            return union_all(parts)
        now = deeper
    raise RuntimeError("the graph has a cycle, or paths longer than asked for")


def back_edges(edges: DataFrame) -> DataFrame:
    """Edges that the count of paths leaves out so that what remains is acyclic: loops, and edges that close a cycle.

    Within a component nodes have an order, by fewest edges from its entries (nodes with an edge from outside or
    a path's start, else the least node) and then by name; an edge that does not go up in it is a back edge.
    """
    classes = materialise(scc(edges), "scc")
    inner = materialise(cycle_edges(edges, classes), "inner")
    nodes = materialise(nodes_of(inner), "inner")
    entered = edges.select("u", "v").join(inner, ["u", "v"], "left_anti").select(F.col("v").alias("node")).join(nodes, "node", "left_semi").distinct()
    member = nodes.join(classes, "node")
    closed = member.join(member.join(entered, "node", "left_semi").select("scc").distinct(), "scc", "left_anti").where("node = scc").select("node")
    start = materialise(entered.union(closed), "entries")
    depth = materialise(hops(inner, start, 1_000_000), "depth")
    place = lambda c: depth.select(F.col("node").alias(c), F.struct("hops", "node").alias(f"_{c}"))
    return inner.join(place("u"), "u").join(place("v"), "v").where("_v <= _u").select("u", "v")


def path_counts(edges: DataFrame, most: int = 1000, back: DataFrame | None = None) -> DataFrame:
    """Paths from roots to each node, as decimals of 38 places; a root has one.

    Without ``back`` the graph must be acyclic. With it, as from ``back_edges``, those edges count nothing. A node
    that only back edges enter is a root.
    """
    edges = edges.select("u", "v") if back is None else edges.select("u", "v").join(back, ["u", "v"], "left_anti").unionByName(back.select(F.col("v").alias("u"), F.lit(None).cast(edges.schema["v"].dataType).alias("v")))
    all_ = materialise(edges, "edges")
    onward = all_.where("v is not null").select(F.col("u").alias("node"), "v")
    start = all_.select(F.col("u").alias("node")).distinct().join(onward.select(F.col("v").alias("node")), "node", "left_anti")
    parts = [materialise(start.withColumn("paths", F.lit(1).cast("decimal(38,0)")), "paths")]
    for _ in range(most):
        new = parts[-1].join(onward, "node").groupBy(F.col("v").alias("node")).agg(F.sum("paths").cast("decimal(38,0)").alias("paths"))
        new = materialise(new, "paths")
        if new.isEmpty():
            return union_all(parts).groupBy("node").agg(F.sum("paths").cast("decimal(38,0)").alias("paths"))
        parts.append(new)
    raise RuntimeError("the graph has a cycle, or paths longer than asked for")


def same_generation(edges: DataFrame) -> DataFrame:
    """Pairs of different nodes that are as far below a common ancestor (edges go from parent to child).

    Without cycles whatever two nodes have in common they have from a root too, so nodes are grouped by root and distance,
    and pairs are made from the groups at the end: no round sees pairs. With cycles pairs derive pairs, round by round.
    """
    edges = materialise(edges.select("u", "v").distinct(), "edges")
    if _without_ends(edges, 1000).isEmpty():
        onward = edges.withColumnRenamed("u", "node")
        start = roots(edges).select("node", F.col("node").alias("top"), F.lit(0).alias("k"))
        below = fixpoint(start, lambda new, _: new.join(onward, "node").select(F.col("v").alias("node"), "top", (F.col("k") + 1).alias("k")))
        return fellows(below.where("k > 0").select("node", F.struct("top", "k").alias("group"))).toDF("u", "v")
    up = edges.select(F.col("v").alias("child"), F.col("u").alias("parent")).distinct()
    a = up.select(F.col("child").alias("u"), F.col("parent").alias("p"))
    b = up.select(F.col("child").alias("v"), F.col("parent").alias("q"))
    siblings = a.withColumnRenamed("p", "q").join(b, "q").where("u <> v").select("u", "v")
    below = lambda new: new.select(F.col("u").alias("p"), F.col("v").alias("q")).join(a, "p").join(b, "q").select("u", "v")
    return fixpoint(siblings, lambda new, _: below(new).where("u <> v"))


def dominators(edges: DataFrame, root: DataFrame, rounds: int = 1000) -> DataFrame:
    """``node`` and each ``dom`` on every path from the one ``root`` (column ``node``) to it, itself included.

    What dominates a node lies on its path in a tree of fewest edges from the root, so these paths are the first table, built
    level by level from the last level's rows. A row falls if some predecessor of the node lacks it; rows that fall are
    found once each, in rounds that see the last round's only. What stays is what every predecessor has.
    """
    with scratch(edges.sparkSession):
        onward = materialise(edges.select("u", "v").distinct().where("u <> v").join(root.select(F.col("node").alias("v")), "v", "left_anti").select("u", "v"), "edges")
        level = materialise(root.select("node", F.col("node").alias("dom")), "doms")
        parts, seen = [level], [materialise(root.select("node", F.lit(None).cast(edges.schema["u"].dataType).alias("parent")), "tree")]
        for _ in range(rounds):
            last = seen[-1].select(F.col("node").alias("u"))
            new = onward.join(last, "u").groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent"))
            new = materialise(new.join(union_all(seen), "node", "left_anti"), "tree")
            if new.isEmpty():
                break
            above = new.join(level.withColumnRenamed("node", "parent"), "parent").select("node", "dom")
            level = materialise(above.union(new.select("node", F.col("node").alias("dom"))), "doms")
            parts.append(level)
            seen.append(new)
        else:
            raise RuntimeError(f"nodes are still found after {rounds} rounds")
        doms, tree = materialise(union_all(parts), "doms"), materialise(union_all(seen), "tree")
        into = materialise(onward.join(tree.select(F.col("node").alias("u")), "u", "left_semi").select("u", "v"), "edges")
        strict = materialise(doms.where("node <> dom"), "strict")
        other = into.join(tree.select(F.col("parent").alias("u"), F.col("node").alias("v")), ["u", "v"], "left_anti")  # a parent has them all
        lacks = other.join(strict.toDF("v", "dom"), "v").join(doms.toDF("u", "dom"), ["u", "dom"], "left_anti").select(F.col("v").alias("node"), "dom")

        def fall(new: DataFrame, _: DataFrame) -> DataFrame:
            return new.join(into.withColumnRenamed("u", "node"), "node").select(F.col("v").alias("node"), "dom").join(strict, ["node", "dom"], "left_semi")

        return keep(doms.join(fixpoint(lacks, fall, rounds), ["node", "dom"], "left_anti"), "doms")


def dominance_frontier(edges: DataFrame, doms: DataFrame) -> DataFrame:
    """``node`` and each ``front``: a node that it does not strictly dominate, but one of whose predecessors it dominates."""
    ahead = edges.select(F.col("u").alias("p"), F.col("v").alias("front")).distinct().join(doms.select(F.col("node").alias("p"), F.col("dom").alias("node")), "p")
    strict = doms.where("node <> dom").select(F.col("node").alias("front"), F.col("dom").alias("node"))
    return ahead.select("node", "front").distinct().join(strict, ["node", "front"], "left_anti")


def path_ranges(edges: DataFrame, back: DataFrame | None = None) -> DataFrame:
    """u, v, and the half-open range of path numbers [first, last) that edge (u, v) gives its end.

    The paths to a node are numbered from 0; its predecessors, by order, take contiguous ranges as long as
    their own numbers of paths. The window is over one node's predecessors. On a graph with cycles ``back`` names edges
    without which it has none, as from ``back_edges``; they have no numbers, as in ``path_counts``.
    """
    e = edges.select("u", "v").distinct()
    counts = path_counts(e, back=back)
    e = e if back is None else e.join(back, ["u", "v"], "left_anti")
    counts = counts.select(F.col("node").alias("u"), "paths")
    before = Window.partitionBy("v").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
    rows = e.join(counts, "u").withColumn("first", F.coalesce(F.sum("paths").over(before), F.lit(0)).cast("decimal(38,0)"))
    return rows.select("u", "v", "first", (F.col("first") + F.col("paths")).cast("decimal(38,0)").alias("last"))


def simple_paths(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """``path`` arrays without a repeated node, of 1 to ``most`` edges, from ``start`` (column ``node``)."""
    onward = edges.select(F.col("u").alias("end"), "v").distinct()
    parts = [materialise(start.select(F.array("node").alias("path")), "walk")]
    for _ in range(most):
        longer = parts[-1].withColumn("end", F.element_at("path", -1)).join(onward, "end")
        longer = materialise(longer.where(~F.array_contains("path", F.col("v"))).select(F.array_append("path", F.col("v")).alias("path")), "walk")
        if longer.isEmpty():
            break
        parts.append(longer)
    return union_all(parts).where(F.size("path") > 1)


def simple_cycles(edges: DataFrame, most: int) -> DataFrame:
    """``cycle`` arrays of at most ``most`` nodes, each once, begun at its least node; a loop is a cycle of one."""
    back = edges.select(F.col("u").alias("end"), F.col("v").alias("node")).distinct()
    larger = edges.where("v > u")
    walks = simple_paths(edges, nodes_of(larger), most - 1).where(F.array_min("path") == F.col("path")[0]) if most > 1 else None
    loops = edges.where("u = v").select(F.array("u").alias("cycle")).distinct()
    if walks is None:
        return loops
    ends = walks.select("path", F.element_at("path", -1).alias("end"), F.col("path")[0].alias("node"))
    return loops.union(ends.join(back, ["end", "node"], "left_semi").select(F.col("path").alias("cycle")))
