"""From evidence of traces to feedback on tuples: edges of locations become statements on pairs of nodes.

positive(src, dst, confidence) and negative(src, dst, confidence) are edges between source lines; nodes(line,
node) says which nodes a line holds; flow(u, v) is the graph that an analysis found between nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornfels.operators.fixpoint import fixpoint, union_all
from hornfels.operators.graph import closure_by_doubling
from hornfels.operators.ranking import ranked
from hornfels.storage import materialise


def positive_wins(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """``negative`` without the edges that are also positive."""
    return negative.join(positive.select("src", "dst"), ["src", "dst"], "left_anti")


def fanned_out(edges: DataFrame, nodes: DataFrame, skip: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """(u, v, confidence) of nodes for edges of lines: each node of the one with each of the other, the surest once.

    Nodes of ``skip`` are left out unless they are ``entries`` (both have a column node).
    """
    if skip is not None:
        out = skip if entries is None else skip.join(entries, "node", "left_anti")
        nodes = nodes.join(out, "node", "left_anti").select("line", "node")
    a, b = nodes.toDF("src", "u"), nodes.toDF("dst", "v")
    return edges.join(a, "src").join(b, "dst").groupBy("u", "v").agg(F.max("confidence").alias("confidence"))


def bridges(flow: DataFrame, found: DataFrame, rounds: int = 200) -> DataFrame:
    """``found`` edges (u, v) and the edges of ``flow`` that lie on every path of ``flow`` between the ends of a found one.

    An edge (a, b) is such a bridge for (u, v) if all paths from u to v go over it: taken away, v is out of reach. Only
    edges on paths between u and v are looked at. What is added counts as found, closed under composition, and the
    search goes on until nothing is added. Pairs of a found edge and an edge on its paths are the rows of the
    search, so ``flow`` should be pruned to what matters.
    """
    flow = materialise(flow.select("u", "v").distinct(), "flow")
    paths = materialise(closure_by_doubling(flow), "paths")
    ends = materialise(found.select("u", "v").distinct(), "found")
    parts = [ends]
    for _ in range(rounds):
        direct = paths.toDF("s", "t")
        asked = parts[-1].toDF("s", "t").join(direct, ["s", "t"], "left_semi")
        ahead = paths.toDF("s", "u").union(asked.select("s", F.col("s").alias("u"))).distinct()
        behind = paths.toDF("v", "t").union(asked.select(F.col("t").alias("v"), "t")).distinct()
        # of a pair's two ends the one with fewer nodes is walked from, and what it meets must be on a way between them
        down, up = ahead.groupBy("s").agg(F.count("*").alias("down")), behind.groupBy("t").agg(F.count("*").alias("up"))
        sized = materialise(asked.join(down, "s").join(up, "t"), "asked")
        last = sized.where("up <= down").select("s", "t").join(behind, "t").join(paths.toDF("s", "v"), ["s", "v"], "left_semi")
        last = last.join(flow, "v").join(ahead, ["s", "u"], "left_semi")
        first = sized.where("up > down").select("s", "t").join(ahead, "s").join(paths.toDF("u", "t"), ["u", "t"], "left_semi")
        first = first.join(flow, "u").join(behind, ["v", "t"], "left_semi")
        on = materialise(last.select("s", "t", "u", "v").union(first.select("s", "t", "u", "v")).distinct(), "on")
        # from s, without the edge (u, v), along edges on the way to t
        step = on.select("s", "t", F.col("u").alias("node"), F.col("v").alias("next"))
        state = on.select("s", "t", "u", "v", F.col("s").alias("node"))

        def walk(new: DataFrame, _: DataFrame, step: DataFrame = step) -> DataFrame:
            return new.join(step, ["s", "t", "node"]).where("not (node = u and next = v)").select("s", "t", "u", "v", F.col("next").alias("node"))

        around = fixpoint(state, walk).where("node = t").select("s", "t", "u", "v")
        sure = on.join(around, ["s", "t", "u", "v"], "left_anti").select("u", "v").distinct()
        known = union_all(parts)
        closed = closure_by_doubling(known.union(sure).distinct())
        new = materialise(closed.join(known, ["u", "v"], "left_anti"), "bridges")
        if new.isEmpty():
            return known
        parts.append(new)
    raise RuntimeError(f"bridges are not settled in {rounds} rounds")


def emitted(positive: DataFrame, negative: DataFrame, name: str = "DUPath") -> DataFrame:
    """``place``, ``tuple``, ``value`` and ``confidence``: the lines of feedback, positive ones first, a pair once.

    Both tables have u, v and confidence. Within a sign the order is that of the pair; places come from the sums
    of range partitions (see ranking.ranked), not from one sort in one task.
    """
    best = positive.select("u", "v", F.lit(True).alias("value"), "confidence").unionByName(negative.select("u", "v", F.lit(False).alias("value"), "confidence"))
    best = best.groupBy("u", "v").agg(F.max_by("confidence", F.struct("value", "confidence")).alias("confidence"), F.max("value").alias("value"))
    placed = ranked(best, [F.desc("value"), F.asc("u"), F.asc("v")])
    return placed.select("rank", F.concat(F.lit(f"{name}("), "u", F.lit(","), "v", F.lit(")")).alias("tuple"), "value", "confidence").withColumnRenamed("rank", "place")


def touched(lines: DataFrame, visited: DataFrame) -> DataFrame:
    """For each ``file`` of ``lines`` (file, line): instrumented lines, visited ones, and their share."""
    seen = visited.select("file", "line", F.lit(1).alias("hit")).distinct()
    rows = lines.select("file", "line").distinct().join(seen, ["file", "line"], "left")
    sums = rows.groupBy("file").agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("seen"))
    return sums.withColumn("share", F.col("seen") / F.col("n"))


def label_sources(union: DataFrame, labels: DataFrame, start: DataFrame) -> DataFrame:
    """(node, label): labels that ``start`` nodes are made of: union(pid, node, part) is followed down to labelled nodes, which are leaves."""
    down = union.select("pid", "node", "part").join(labels.select("pid", "node"), ["pid", "node"], "left_anti")
    named = lambda p, n: F.struct(F.col(p).alias("pid"), F.col(n).alias("node"))
    edges = down.select(named("pid", "node").alias("u"), named("pid", "part").alias("v"))
    seeds = start.select(named("pid", "node").alias("root"))
    onward = materialise(edges.select(F.col("u").alias("node"), "v"), "edges")
    pairs = fixpoint(seeds.select("root", F.col("root").alias("node")), lambda new, _: new.join(onward, "node").select("root", F.col("v").alias("node")))
    hit = labels.select(named("pid", "node").alias("node"), "label")
    return pairs.join(hit, "node").select("root.pid", F.col("root.node").alias("node"), "label").distinct()

