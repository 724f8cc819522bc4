"""Recursive queries on graphs that the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hornfels.operators import graph as G
from hornfels.operators import relational as R
from hornfels.operators.fixpoint import fixpoint
from hornfels.plans.registry import query, relation, table
from hornfels.storage import materialise


def hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """region -> nation -> customer -> order, nodes named by a letter and the key."""
    parts = [("nation", "r", "n_regionkey", "n", "n_nationkey"), ("customer", "n", "c_nationkey", "c", "c_custkey"), ("orders", "c", "o_custkey", "o", "o_orderkey")]
    edges = [table(spark, sf, t).select(F.concat(F.lit(a), k).alias("u"), F.concat(F.lit(b), j).alias("v")) for t, a, k, b, j in parts]
    return edges[0].union(edges[1]).union(edges[2])


HIERARCHY = """e(u, v) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


def transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Event types that follow each other at once for some user."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf, "events").select(F.col("event_type").alias("u"), F.lead("event_type").over(by).alias("v"))
    return steps.where("v is not null").distinct()


def habits(spark: SparkSession, sf: str) -> DataFrame:
    """What follows what for a user: nodes are a user, an event's type and the tenth its value is in; a graph with cycles."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    node = F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.floor(F.col("value") / 10).cast("string"))
    rows = table(spark, sf, "events").select(node.alias("u"), "user_id", "ts", "event_id").select("u", F.lead("u").over(by).alias("v"))
    return materialise(rows.where("v is not null").distinct(), "habits")


def firsts(edges: DataFrame) -> DataFrame:
    """The least node of each user with an edge from it."""
    return edges.groupBy(F.substring_index("u", ":", 1).alias("user")).agg(F.min("u").alias("node")).select("node")


HABITS = """e(u, v) AS (SELECT DISTINCT u, v FROM (SELECT u, lead(u) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v
FROM (SELECT *, user_id || ':' || event_type || ':' || floor(value / 10)::BIGINT AS u FROM events)) WHERE v IS NOT NULL),
f(node) AS (SELECT min(u) FROM e GROUP BY split_part(u, ':', 1))"""
TRANSITIONS = "e(u, v) AS (SELECT DISTINCT u, v FROM (SELECT event_type AS u, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events) WHERE v IS NOT NULL)"
CLOSE = "t(u, v) AS (SELECT u, v FROM e UNION SELECT t.u, e.v FROM t JOIN e ON t.v = e.u)"


@query(f"WITH RECURSIVE {HIERARCHY}, {CLOSE} SELECT u, v FROM t")
def tc_linear(spark: SparkSession, sf: str) -> DataFrame:
    return G.closure(hierarchy(spark, sf))


@query(f"WITH RECURSIVE {HABITS}, {CLOSE} SELECT u, v FROM t")
def tc_nonlinear(spark: SparkSession, sf: str) -> DataFrame:
    return G.closure_by_classes(habits(spark, sf))


@query(f"WITH RECURSIVE {TRANSITIONS}, {CLOSE} SELECT u, v FROM t")
def tc_cyclic(spark: SparkSession, sf: str) -> DataFrame:
    return G.closure(transitions(spark, sf))


@query(f"WITH RECURSIVE {HABITS}, p AS (SELECT u, v FROM e WHERE u <> v), t(u, v) AS (SELECT u, v FROM p UNION SELECT t.u, p.v FROM t JOIN p ON t.v = p.u) SELECT u, v FROM t WHERE u <> v UNION SELECT u, v FROM e WHERE u = v")
def closure_no_self(spark: SparkSession, sf: str) -> DataFrame:
    return G.closure_no_self(habits(spark, sf))


@query(f"WITH RECURSIVE {HABITS}, t(node) AS (SELECT node FROM f UNION SELECT e.v FROM t JOIN e ON t.node = e.u) SELECT node FROM t")
def reach_from_root(spark: SparkSession, sf: str) -> DataFrame:
    e = habits(spark, sf)
    return G.reach(e, firsts(e))


@query(f"WITH RECURSIVE {HABITS}, t(node) AS (SELECT node FROM f UNION SELECT e.v FROM t JOIN e ON t.node = e.u) SELECT u AS node FROM e UNION SELECT v FROM e EXCEPT SELECT node FROM t")
def stratified_unreachable(spark: SparkSession, sf: str) -> DataFrame:
    e = habits(spark, sf)
    return R.without(G.nodes_of(e), G.reach(e, firsts(e)))


@query(f"WITH RECURSIVE {HABITS}, t(node, k) AS (SELECT node, 0 FROM f UNION SELECT e.v, k + 1 FROM t JOIN e ON t.node = e.u WHERE k < 2) SELECT node, min(k)::INT AS hops FROM t GROUP BY node")
def bounded_k_hop(spark: SparkSession, sf: str) -> DataFrame:
    e = habits(spark, sf)
    return G.hops(e, firsts(e), 2)


@query(f"WITH RECURSIVE {HIERARCHY}, t(u, v, d) AS (SELECT u, v, 1 FROM e UNION ALL SELECT t.u, e.v, d + 1 FROM t JOIN e ON t.v = e.u) SELECT u, v, min(d)::INT AS dist FROM t GROUP BY u, v")
def shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    return G.shortest(hierarchy(spark, sf))


@query(f"WITH RECURSIVE {HABITS}, {CLOSE}, n AS (SELECT u AS node FROM e UNION SELECT v FROM e), m AS (SELECT a.u AS node, min(a.v) AS l FROM t a JOIN t b ON a.u = b.v AND a.v = b.u GROUP BY a.u) SELECT node, least(node, coalesce(l, node)) AS scc FROM n LEFT JOIN m USING (node)")
def scc(spark: SparkSession, sf: str) -> DataFrame:
    return G.scc(habits(spark, sf))


@query(f"WITH RECURSIVE {HABITS}, {CLOSE} SELECT u AS node FROM t WHERE u = v")
def nodes_in_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return G.in_cycles(habits(spark, sf))


@query(f"WITH {HABITS}, x AS (SELECT u AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT v, 0, 1 FROM e) SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM x GROUP BY node")
def degree(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(habits(spark, sf))


@query(f"WITH RECURSIVE {HIERARCHY}, t(node, k) AS (SELECT DISTINCT u, 0 FROM e WHERE u NOT IN (SELECT v FROM e) UNION SELECT e.v, k + 1 FROM t JOIN e ON t.node = e.u) SELECT node, max(k)::INT AS level FROM t GROUP BY node")
def topo_level(spark: SparkSession, sf: str) -> DataFrame:
    return G.levels(hierarchy(spark, sf))


CHAIN = "e(u, v) AS (SELECT conv_id || ':' || turn, conv_id || ':' || nxt FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL UNION ALL SELECT conv_id || ':' || turn, conv_id || ':' || nxt FROM (SELECT conv_id, turn, lead(turn, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL)"


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn of a conversation leads to the next and the one after."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.lead("turn").over(by).alias("a"), F.lead("turn", 2).over(by).alias("b"))
    name = lambda t: F.concat_ws(":", "conv_id", t)
    return rows.select(name("turn").alias("u"), F.explode(F.array("a", "b")).alias("n"), "conv_id").where("n is not null").select("u", name("n").alias("v"))


@query(f"WITH RECURSIVE {CHAIN}, t(node, k) AS (SELECT DISTINCT u, 1 FROM e WHERE u NOT IN (SELECT v FROM e) UNION ALL SELECT e.v, 1 FROM t JOIN e ON t.node = e.u) SELECT node, count(*)::BIGINT AS paths FROM t GROUP BY node")
def path_count(spark: SparkSession, sf: str) -> DataFrame:
    return G.path_counts(turns(spark, sf)).select("node", F.col("paths").cast("long").alias("paths"))


@query(f"WITH RECURSIVE {CHAIN}, t(node, k) AS (SELECT DISTINCT u, 1 FROM e WHERE u NOT IN (SELECT v FROM e) UNION ALL SELECT e.v, 1 FROM t JOIN e ON t.node = e.u) SELECT max(n)::BIGINT AS most FROM (SELECT node, count(*) AS n FROM t GROUP BY node)")
def path_count_max(spark: SparkSession, sf: str) -> DataFrame:
    return G.path_counts(turns(spark, sf)).agg(F.max("paths").cast("long").alias("most"))


@query("""SELECT a.s_suppkey AS u, b.s_suppkey AS v FROM supplier a JOIN nation n ON a.s_nationkey = n.n_nationkey JOIN nation m USING (n_regionkey) JOIN supplier b ON b.s_nationkey = m.n_nationkey WHERE a.s_suppkey <> b.s_suppkey""")
def same_generation(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of one region; names keep the kinds of node apart."""
    up = table(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("u"), F.concat(F.lit("n"), "n_nationkey").alias("v"))
    down = table(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("u"), F.concat(F.lit("s"), "s_suppkey").alias("v"))
    pairs = G.same_generation(up.union(down)).where("u like 's%' and v like 's%'")
    return pairs.select(F.substring("u", 2, 20).cast("long").alias("u"), F.substring("v", 2, 20).cast("long").alias("v"))


@query(f"WITH RECURSIVE {HIERARCHY}, t(node, k) AS (SELECT DISTINCT u, 0 FROM e WHERE u NOT IN (SELECT v FROM e) UNION SELECT e.v, (k + 1) % 2 FROM t JOIN e ON t.node = e.u) SELECT node, k = 0 AS even FROM t")
def mutual_even_odd(spark: SparkSession, sf: str) -> DataFrame:
    """even(y) :- odd(x), e(x, y). odd(y) :- even(x), e(x, y). Two relations in one fixpoint, told apart by a flag."""
    e = hierarchy(spark, sf)
    onward = e.select(F.col("u").alias("node"), "v")
    start = G.roots(e).withColumn("even", F.lit(True))
    return fixpoint(start, lambda new, _: new.join(onward, "node").select(F.col("v").alias("node"), (~F.col("even")).alias("even")))


@query("SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY md5(lower(text))) AS root FROM documents QUALIFY count(*) OVER (PARTITION BY md5(lower(text))) > 1")
def components(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of equal text but for case, linked to the least of them."""
    docs = table(spark, sf, "documents").select("doc_id", F.md5(F.lower("text")).alias("h"))
    least = docs.groupBy("h").agg(F.min("doc_id").alias("v"), F.count("*").alias("n")).where("n > 1")
    return G.components(docs.join(least, "h").select(F.col("doc_id").alias("u"), "v"))


DOMINATED = f"""{HABITS}, reached(node) AS (SELECT node FROM f UNION SELECT e.v FROM reached JOIN e ON reached.node = e.u),
own AS (SELECT node, split_part(node, ':', 1) AS user FROM reached), fu AS (SELECT node, split_part(node, ':', 1) AS user FROM f),
t(dom, node) AS (SELECT own.node, fu.node FROM own JOIN fu USING (user) WHERE own.node <> fu.node UNION SELECT t.dom, e.v FROM t JOIN e ON t.node = e.u WHERE e.v <> t.dom),
doms AS (SELECT a.node, b.node AS dom FROM own a JOIN own b USING (user) EXCEPT SELECT node, dom FROM t)"""


def dominated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Habits below one root, which leads to the first node of each user, and its dominators."""
    e = habits(spark, sf)
    first = firsts(e)
    e = e.union(first.select(F.lit("root").alias("u"), F.col("node").alias("v")))
    return e, G.dominators(e, spark.range(1).select(F.lit("root").alias("node")))


@query(f"WITH RECURSIVE {DOMINATED} SELECT node, dom FROM doms")
def dominators(spark: SparkSession, sf: str) -> DataFrame:
    return dominated(spark, sf)[1].where("dom <> 'root'")


@query(f"""WITH RECURSIVE {DOMINATED} SELECT DISTINCT d.dom AS node, e.v AS front FROM doms d JOIN e ON e.u = d.node WHERE NOT EXISTS (SELECT 1 FROM doms x WHERE x.node = e.v AND x.dom = d.dom AND x.node <> x.dom)""")
def dominance_frontier(spark: SparkSession, sf: str) -> DataFrame:
    e, doms = dominated(spark, sf)
    return G.dominance_frontier(e, doms).where("node <> 'root'")


@query(f"WITH RECURSIVE {HABITS}, {CLOSE} SELECT DISTINCT e.u, e.v FROM e WHERE e.u = e.v OR EXISTS (SELECT 1 FROM t WHERE t.u = e.v AND t.v = e.u)")
def cycle_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges on some cycle."""
    return G.cycle_edges(habits(spark, sf))


COUNTED = "t(node, k) AS (SELECT DISTINCT u, 1 FROM e WHERE u NOT IN (SELECT v FROM e) UNION ALL SELECT e.v, 1 FROM t JOIN e ON t.node = e.u), c AS (SELECT node, count(*) AS paths FROM t GROUP BY node)"


@query(f"WITH RECURSIVE {CHAIN}, {COUNTED}, x AS (SELECT e.u, e.v, paths, coalesce(sum(paths) OVER (PARTITION BY e.v ORDER BY e.u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM (SELECT DISTINCT u, v FROM e) e JOIN c ON c.node = e.u) SELECT u, v, first::BIGINT AS first, (first + paths)::BIGINT AS last FROM x")
def path_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return G.path_ranges(turns(spark, sf)).select("u", "v", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query(f"WITH RECURSIVE {HABITS}, w(path) AS (SELECT DISTINCT [u] FROM e UNION SELECT list_append(path, v) FROM w JOIN e ON e.u = path[-1] WHERE len(path) <= 3 AND NOT list_contains(path, v)) SELECT array_to_string(path, '>') AS path FROM w WHERE len(path) > 1")
def bounded_paths(spark: SparkSession, sf: str) -> DataFrame:
    e = habits(spark, sf)
    return G.simple_paths(e, e.select(F.col("u").alias("node")).distinct(), 3).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"WITH RECURSIVE {HABITS}, w(path) AS (SELECT DISTINCT [u] FROM e UNION SELECT list_append(path, v) FROM w JOIN e ON e.u = path[-1] WHERE len(path) < 5 AND NOT list_contains(path, v) AND v > path[1]) SELECT array_to_string(path, '>') AS cycle FROM w JOIN e ON e.u = path[-1] AND e.v = path[1]")
def simple_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return G.simple_cycles(habits(spark, sf), 5).select(F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"))
