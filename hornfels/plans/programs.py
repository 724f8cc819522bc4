"""Analyses, feedback and statistics across runs on relations that the tables hold; they grow with the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hornfels.operators import analyses as A
from hornfels.operators import feedback as B
from hornfels.operators import graph as G
from hornfels.operators import ranking as K
from hornfels.operators import runs as S
from hornfels.plans.graphs import CHAIN, components, turns
from hornfels.plans.measures import RANKED, ranked
from hornfels.plans.registry import query, relation, table
from hornfels.storage import materialise


def _named(letter: str, column: str) -> Column:
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def _program(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """new, assign, load, store: c = new n; s = new m; o = c; o.ship = s for the order's suppliers; p = o.ship for its parts."""
    new = table(spark, sf, "customer").select(_named("c", "c_custkey").alias("v"), _named("n", "c_nationkey").alias("h"))
    new = new.union(table(spark, sf, "supplier").select(_named("s", "s_suppkey"), _named("n", "s_nationkey")))
    assign = table(spark, sf, "orders").select(_named("o", "o_orderkey").alias("v"), _named("c", "o_custkey").alias("w"))
    line = table(spark, sf, "lineitem")
    load = line.select(_named("p", "l_partkey").alias("v"), _named("o", "l_orderkey").alias("w"), F.lit("ship").alias("f"))
    store = line.select(_named("o", "l_orderkey").alias("v"), F.lit("ship").alias("f"), _named("s", "l_suppkey").alias("w"))
    return new, assign, load, store


FIELDS = """o AS (SELECT o_orderkey AS o, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey),
hfh AS (SELECT DISTINCT o.n AS b, s_nationkey AS h FROM lineitem JOIN o ON l_orderkey = o.o JOIN supplier ON l_suppkey = s_suppkey)"""


@query(f"""WITH {FIELDS} SELECT 'c' || c_custkey AS v, 'n' || c_nationkey AS h FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'o' || o, 'n' || n FROM o
UNION ALL SELECT DISTINCT 'p' || l_partkey, 'n' || h FROM (SELECT DISTINCT l_partkey, n FROM lineitem JOIN o ON l_orderkey = o.o) JOIN hfh ON b = n""")
def points_to_vars(spark: SparkSession, sf: str) -> DataFrame:
    return A.points_to(*_program(spark, sf))[0]


@query(f"WITH {FIELDS} SELECT 'n' || b AS b, 'ship' AS f, 'n' || h AS h FROM hfh")
def points_to_fields(spark: SparkSession, sf: str) -> DataFrame:
    return A.points_to(*_program(spark, sf))[1]


@query("""WITH a AS MATERIALIZED (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS e, l_suppkey AS t, l_partkey AS h, l_returnflag = 'R' AS w, l_linestatus AS l, s_nationkey AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
, p AS MATERIALIZED (SELECT DISTINCT a.e, b.e AS d FROM a JOIN a b ON a.h = b.h AND a.n = b.n AND a.t <> b.t AND a.e <= b.e AND (a.w OR b.w))
, k AS MATERIALIZED (SELECT e, list(DISTINCT l) AS ls FROM a GROUP BY e)
SELECT p.e, p.d FROM p JOIN k x ON x.e = p.e JOIN k y ON y.e = p.d WHERE NOT list_has_any(x.ls, y.ls)""")
def race_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Lines on one part by different suppliers of a nation, one returned, whose status (the lock they hold) differs."""
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("e"), F.col("l_suppkey").alias("t"), F.col("l_partkey").alias("h"), (F.col("l_returnflag") == "R").alias("write"), F.col("l_linestatus").alias("l"))
    rows = materialise(rows.distinct(), "access")
    return A.races(rows.drop("l"), rows.select("e", "l"), None, relation(spark, sf, "supplier", "s_suppkey", "s_nationkey"))


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS k, l_suppkey AS s FROM lineitem), x AS (SELECT DISTINCT a.o, o_custkey AS t, b.k, a.s AS l, b.s AS m FROM i a JOIN i b ON a.o = b.o AND a.k < b.k JOIN orders ON o_orderkey = a.o),
one AS (SELECT * FROM x WHERE l < m), two AS (SELECT o, t, k, m AS l, l AS m FROM x WHERE l > m), c AS (SELECT c_custkey AS c, c_nationkey AS n FROM customer)
SELECT DISTINCT one.t AS t, two.t AS s, one.l, one.m FROM one JOIN two USING (l, m) JOIN c p ON p.c = one.t JOIN c q ON q.c = two.t AND p.n = q.n AND p.c <> q.c
WHERE NOT EXISTS (SELECT 1 FROM x g JOIN x h ON g.l = h.l WHERE g.o = one.o AND g.k = one.k AND h.o = two.o AND h.k = two.k AND g.l <> one.l AND g.l <> one.m)""")
def deadlock_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A customer is a thread, an order's line takes its supplier while those of the lines before are held; customers of a nation run at once."""
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("k"), F.col("l_suppkey").alias("x")).distinct()
    held = line.toDF("o", "j", "l").join(line.toDF("o", "k", "m"), "o").where("j < k")
    order = relation(spark, sf, "orders", "o_orderkey", "o_custkey").toDF("o", "t")
    holds = held.join(order, "o").select("t", F.concat_ws(":", "o", "k").alias("a"), "l", "m")
    return A.deadlocks(materialise(holds.distinct(), "holds"), None, groups=relation(spark, sf, "customer", "c_custkey", "c_nationkey"))


@query("""SELECT DISTINCT c_custkey AS source, l_partkey AS sink FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_acctbal < 0 AND o_orderstatus <> 'F' AND p_size > 30""")
def taint_flows(spark: SparkSession, sf: str) -> DataFrame:
    """From customers in debt over orders, but for finished ones, to large parts."""
    named = lambda t, letter, column, where="true": table(spark, sf, t).where(where).select(_named(letter, column).alias("node"))
    edges = table(spark, sf, "orders").select(_named("c", "o_custkey").alias("u"), _named("o", "o_orderkey").alias("v"))
    edges = edges.union(table(spark, sf, "lineitem").select(_named("o", "l_orderkey"), _named("p", "l_partkey")))
    out = A.flows(named("customer", "c", "c_custkey", "c_acctbal < 0"), edges, named("part", "p", "p_partkey", "p_size > 30"), named("orders", "o", "o_orderkey", "o_orderstatus = 'F'"))
    return out.select(*[F.substring(c, 2, 20).cast("long").alias(c) for c in ("source", "sink")])


@query(f"WITH RECURSIVE {CHAIN}, t(node) AS (SELECT DISTINCT conv_id || ':' || 3 FROM conversations WHERE turn = 3 UNION SELECT e.u FROM t JOIN e ON e.v = t.node) SELECT node FROM t")
def slice_back(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that the fourth turn of a conversation depends on."""
    back = turns(spark, sf).select(F.col("v").alias("u"), F.col("u").alias("v"))
    third = table(spark, sf, "conversations").where("turn = 3").select(F.concat_ws(":", "conv_id", "turn").alias("node")).distinct()
    return A.backward_slice(back, third)


def _edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Positive and negative edges from parts to suppliers: returned lines and others; the surest stands for all."""
    line = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_returnflag", (F.col("l_quantity") / 50).alias("confidence"))
    best = lambda flag: line.where(flag).groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
    return best("l_returnflag = 'R'"), best("l_returnflag <> 'R'")


SAID = """g AS (SELECT l_partkey AS src, l_suppkey AS dst, max(l_quantity / 50) FILTER (l_returnflag = 'R') AS p, max(l_quantity / 50) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY ALL)"""


@query(f"WITH {SAID} SELECT src, dst, n AS confidence FROM g WHERE p IS NULL AND n IS NOT NULL")
def positive_wins(spark: SparkSession, sf: str) -> DataFrame:
    return B.positive_wins(*_edges(spark, sf))


@query(f"""WITH {SAID}, f AS (SELECT 'p' || (src % 50) AS u, 's' || (dst % 10) AS v, max(p) AS p, max(CASE WHEN p IS NULL THEN n END) AS n FROM g GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY p IS NULL, u, v) AS place, 'DUPath(' || u || ',' || v || ')' AS tuple, p IS NOT NULL AS value, coalesce(p, n) AS confidence FROM f""")
def feedback_emitted(spark: SparkSession, sf: str) -> DataFrame:
    """Parts are lines of 50 nodes and suppliers of 10: edges fan out to nodes, positive ones win, and each pair is said once."""
    positive, negative = _edges(spark, sf)
    ends = {"src": ("part", "p_partkey", "p", 50), "dst": ("supplier", "s_suppkey", "s", 10)}
    nodes = None
    for c, (t, key, letter, n) in ends.items():
        own = table(spark, sf, t).select(F.concat(F.lit(f"{c}:"), F.col(key).cast("string")).alias("line"), F.concat(F.lit(letter), (F.col(key) % n).cast("string")).alias("node"))
        nodes = own if nodes is None else nodes.union(own)
    placed = lambda d: d.select(F.concat(F.lit("src:"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("dst:"), F.col("dst").cast("string")).alias("dst"), "confidence")
    nodes = materialise(nodes, "nodes")
    yes, no = placed(positive), placed(B.positive_wins(positive, negative))
    return B.emitted(B.fanned_out(yes, nodes), B.fanned_out(no, nodes))


@query("""WITH u AS (SELECT o_orderkey AS o, o_custkey AS c, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT')
SELECT 'n' || n AS u, 'o' || o AS v FROM u UNION SELECT 'n' || n, 'c' || c FROM u UNION SELECT 'c' || c, 'o' || o FROM u""")
def bridge_edges(spark: SparkSession, sf: str) -> DataFrame:
    """In the tree of nations, customers and orders all edges on the way to an urgent order are bridges."""
    down = table(spark, sf, "customer").select(_named("n", "c_nationkey").alias("u"), _named("c", "c_custkey").alias("v"))
    flow = down.union(table(spark, sf, "orders").select(_named("c", "o_custkey"), _named("o", "o_orderkey")))
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return B.bridges(flow, urgent.select(_named("n", "c_nationkey").alias("u"), _named("o", "o_orderkey").alias("v")))


@query("""WITH v AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45) SELECT p_brand AS file, count(*) AS n, count(p) AS seen, round(count(p) / count(*), 6) AS share FROM part LEFT JOIN v ON p = p_partkey GROUP BY p_brand""")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Of each brand's parts, those that a large returned line touches."""
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"))
    hit = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select(F.col("l_partkey").alias("line"))
    return B.touched(parts, parts.join(hit, "line", "left_semi")).withColumn("share", F.round("share", 6))


@query("""WITH a AS (SELECT c_mktsegment AS bench, c_nationkey AS run, c_acctbal < 0 AS bad, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer),
k AS (SELECT bench, run, rank, row_number() OVER (PARTITION BY bench, run ORDER BY rank) AS k, count(*) OVER (PARTITION BY bench, run) AS n FROM a WHERE bad),
r AS (SELECT bench, run, max(rank) FILTER (k = greatest(1, floor(n / 2 + 0.5))) AS median, max(rank) FILTER (k = greatest(1, floor(n - n / 10 + 0.5))) AS high FROM k WHERE run % 5 <> 0 GROUP BY bench, run)
SELECT bench, count(median) AS complete, round(avg(median), 6) AS median, round(avg(high), 6) AS high FROM (SELECT DISTINCT bench FROM a) LEFT JOIN r USING (bench) GROUP BY bench""")
def rank_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """A segment is a benchmark, a nation a run that ranks customers by balance; every fifth run lacks an alarm and so does not count."""
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("bench"), F.col("c_nationkey").alias("run"), "c_acctbal", "c_custkey")
    by = Window.partitionBy("bench", "run").orderBy(F.desc("c_acctbal"), "c_custkey")
    ranks = materialise(c.withColumn("rank", F.row_number().over(by)).where("c_acctbal < 0").select("bench", "run", "rank"), "ranks")
    runs = ranks.groupBy("bench", "run").agg((F.count("*") + F.when(F.col("run") % 5 == 0, 1).otherwise(0)).alias("expected"))
    runs = c.select("bench", "run").distinct().join(runs, ["bench", "run"], "left")
    out = S.rank_quantiles(ranks, runs)
    return out.select("bench", "complete", F.round("median", 6).alias("median"), F.round("high", 6).alias("high"))


@query(f"WITH {RANKED}, s AS (SELECT sum(truth::INT) AS t, sum((NOT truth)::INT) AS f, sum(CASE WHEN NOT truth THEN trues END) AS under FROM k) SELECT round((under + (greatest(f, 100000) - f) * greatest(t, 200000))::DOUBLE / (greatest(f, 100000) * greatest(t, 200000)::BIGINT), 6) AS auc FROM s")
def roc_auc_padded(spark: SparkSession, sf: str) -> DataFrame:
    return S.padded_auc(ranked(spark, sf), 200_000, 100_000).select(F.round("auc", 6).alias("auc"))


@query(f"WITH {RANKED}, c AS (SELECT DISTINCT (rank - trues)::BIGINT AS falses, trues::BIGINT AS trues FROM k), m AS (SELECT max(falses) AS f, max(trues) AS t FROM c) SELECT falses, trues FROM c UNION SELECT f, greatest(t, 200000) FROM m UNION SELECT greatest(f, 100000), greatest(t, 200000) FROM m")
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return S.padded_curve(K.curve(ranked(spark, sf)), 200_000, 100_000)


@query(f"WITH {RANKED} SELECT rank, round((rank - trues) / rank, 6) AS false_share FROM k")
def anti_yield(spark: SparkSession, sf: str) -> DataFrame:
    return S.anti_yield(K.curve(ranked(spark, sf))).withColumn("false_share", F.round("false_share", 6))


@query("WITH v AS (SELECT l_suppkey AS bench, l_returnflag AS kind, avg(l_extendedprice) AS x FROM lineitem GROUP BY ALL) SELECT bench, kind, round(x / b, 6) AS ratio FROM v LEFT JOIN (SELECT bench, x AS b FROM v WHERE kind = 'N') USING (bench)")
def against_baseline(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("bench"), F.col("l_returnflag").alias("kind")).agg(F.avg("l_extendedprice").alias("value"))
    return S.against_baseline(materialise(v, "values"), "N").withColumn("ratio", F.round("ratio", 6))


@query("""WITH g AS (SELECT md5(lower(text)) AS h, doc_id FROM documents), r AS (SELECT h, min(doc_id) AS root, count(*) AS nodes FROM g GROUP BY h HAVING count(*) > 1), b AS (SELECT DISTINCT h, g.doc_id FROM g JOIN labels l ON l.doc_id = g.doc_id WHERE toxic = 1)
SELECT root, nodes, nodes - 1 AS edges, (SELECT count(*) FROM b WHERE b.h = r.h) AS bugs FROM r""")
def component_sizes(spark: SparkSession, sf: str) -> DataFrame:
    roots = materialise(components(spark, sf), "roots")
    bugs = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("node"))
    return S.component_sizes(roots, roots.where("node <> root").toDF("u", "v"), bugs)


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS t, l_suppkey AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 49), n AS (SELECT t, count(*) AS n FROM a GROUP BY t)
SELECT p.t::BIGINT AS a, q.t::BIGINT AS b, count(*) AS shared, any_value(n) - count(*) AS lacking FROM a p JOIN a q USING (x) JOIN n ON n.t = q.t GROUP BY p.t, q.t""")
def common_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """Nations of customers and the suppliers of their large lines."""
    line = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("ancestor"))
    up = line.join(table(spark, sf, "orders"), "o_orderkey").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    up = up.select(F.col("c_nationkey").cast("long").alias("tuple"), "ancestor").distinct()
    return S.common_ancestors(materialise(up, "ancestors"), relation(spark, sf, "nation", "n_nationkey").toDF("tuple"))


@query(f"WITH RECURSIVE {CHAIN}, t(node, k) AS (SELECT DISTINCT u, 0 FROM e WHERE u NOT IN (SELECT v FROM e) UNION SELECT e.v, k + 1 FROM t JOIN e ON t.node = e.u) SELECT node AS scc, max(k)::INT AS level FROM t GROUP BY node")
def scc_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Turns are components of their own, in the order of the longest paths to them."""
    return G.scc_levels(turns(spark, sf))
