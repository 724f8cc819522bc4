"""Rules over the star schema: each query is one operator on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornfels.operators import relational as R
from hornfels.plans.registry import query, relation, table

SUP = ("supplier", "s_suppkey", "s_nationkey")
CUST = ("customer", "c_custkey", "c_nationkey")
NATION = ("nation", "n_nationkey", "n_regionkey")
ORDER = ("orders", "o_orderkey", "o_custkey")
ITEM = ("lineitem", "l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT DISTINCT c_custkey AS c, s_suppkey AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey")
def rule_join(spark: SparkSession, sf: str) -> DataFrame:
    """local(c, s) :- ordBy(o, c), item(o, _, s), custIn(c, n), supIn(s, n)."""
    item = R.atom(relation(spark, sf, *ITEM), "o", None, "s")
    rows = R.body(R.atom(relation(spark, sf, *ORDER), "o", "c"), item, R.atom(relation(spark, sf, *CUST), "c", "n"), R.atom(relation(spark, sf, *SUP), "s", "n"))
    return R.head(rows, c="c", s="s")


@query("SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem")
def rule_project(spark: SparkSession, sf: str) -> DataFrame:
    return R.head(R.atom(relation(spark, sf, *ITEM), "o", None, "s"), o="o", s="s")


@query("SELECT DISTINCT n_regionkey::BIGINT AS dst, n_nationkey::BIGINT AS src FROM nation")
def rule_rename(spark: SparkSession, sf: str) -> DataFrame:
    return R.head(R.atom(relation(spark, sf, *NATION), "x", "y"), src="x", dst="y")


@query("SELECT s_suppkey AS s FROM supplier WHERE s_nationkey = 7")
def rule_select_const(spark: SparkSession, sf: str) -> DataFrame:
    return R.head(R.atom(relation(spark, sf, *SUP), "s", 7), s="s")


@query("SELECT s_nationkey::BIGINT AS n FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def rule_union(spark: SparkSession, sf: str) -> DataFrame:
    poor = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").cast("long").alias("n"))
    return R.head(R.atom(relation(spark, sf, *SUP), None, "n").unionByName(poor), n="n")


@query("SELECT c_custkey AS c FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def rule_diff(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c"))
    return R.head(R.without(R.atom(relation(spark, sf, *CUST), "c", None), urgent), c="c")


@query("SELECT s_nationkey::BIGINT AS n FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def rule_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return R.head(R.having(R.atom(relation(spark, sf, *SUP), None, "n"), R.atom(relation(spark, sf, *CUST), None, "n")), n="n")


@query("SELECT r_regionkey::BIGINT AS r, n_nationkey::BIGINT AS n FROM region, nation")
def rule_cross(spark: SparkSession, sf: str) -> DataFrame:
    return R.universe(r=relation(spark, sf, "region", "r_regionkey"), n=relation(spark, sf, "nation", "n_nationkey"))


@query("SELECT DISTINCT a.n_nationkey::BIGINT AS x, b.n_nationkey::BIGINT AS y FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey < b.n_nationkey")
def rule_theta_lt(spark: SparkSession, sf: str) -> DataFrame:
    n = relation(spark, sf, *NATION)
    return R.head(R.body(R.atom(n, "x", "r"), R.atom(n, "y", "r")).where("x < y"), x="x", y="y")


@query("SELECT DISTINCT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b USING (s_nationkey) WHERE a.s_suppkey <> b.s_suppkey")
def rule_neq(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of one nation: a pair is a row of the result."""
    return R.fellows(relation(spark, sf, *SUP))


@query("SELECT DISTINCT n_nationkey::BIGINT AS n FROM nation WHERE n_nationkey = n_regionkey")
def rule_repeat_var(spark: SparkSession, sf: str) -> DataFrame:
    return R.head(R.atom(relation(spark, sf, *NATION), "n", "n"), n="n")


@query("SELECT s_suppkey AS s FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)")
def rule_semi(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_suppkey").alias("s"))
    return R.head(R.having(R.atom(relation(spark, sf, *SUP), "s", None), big), s="s")


@query("SELECT p_partkey AS p FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 45)")
def rule_anti(spark: SparkSession, sf: str) -> DataFrame:
    back = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select(F.col("l_partkey").alias("p"))
    return R.head(R.without(R.atom(relation(spark, sf, "part", "p_partkey"), "p"), back), p="p")


@query("SELECT 0::BIGINT AS a, 1::BIGINT AS b UNION SELECT n_nationkey, n_regionkey FROM nation")
def rule_fact(spark: SparkSession, sf: str) -> DataFrame:
    fact = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    return R.head(fact.unionByName(R.atom(relation(spark, sf, *NATION), "a", "b")), a="a", b="b")


@query("SELECT DISTINCT a.n_nationkey::BIGINT AS n, r_regionkey::BIGINT AS r FROM nation a, region WHERE a.n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def rule_head_wildcard(spark: SparkSession, sf: str) -> DataFrame:
    """unlocked(n, _) :- supIn(s, n), poor(s): the don't-care in the head ranges over its whole domain."""
    poor = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").cast("long").alias("n"))
    return R.universe(n=poor, r=relation(spark, sf, "region", "r_regionkey"))


@query("SELECT a.r_regionkey::BIGINT AS a, b.r_regionkey::BIGINT AS b FROM region a, region b")
def rule_universe(spark: SparkSession, sf: str) -> DataFrame:
    r = relation(spark, sf, "region", "r_regionkey")
    return R.universe(a=r, b=r)


@query("SELECT n_nationkey::BIGINT AS n, r_regionkey::BIGINT AS r FROM nation, region EXCEPT SELECT n_nationkey, n_regionkey FROM nation")
def rule_complement(spark: SparkSession, sf: str) -> DataFrame:
    rel = relation(spark, sf, *NATION).toDF("n", "r")
    return R.complement(rel, n=rel.select("n"), r=relation(spark, sf, "region", "r_regionkey"))


@query("SELECT p_type AS value, row_number() OVER (ORDER BY p_type) - 1 AS id FROM (SELECT DISTINCT p_type FROM part)")
def domain_index(spark: SparkSession, sf: str) -> DataFrame:
    return R.domain_index(table(spark, sf, "part").select("p_type"))


@query("""WITH a AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS a FROM (SELECT DISTINCT o_orderpriority AS value FROM orders)),
b AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS b FROM (SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderstatus = 'F')) SELECT a, b FROM a JOIN b USING (value)""")
def same_values(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    done = orders.where("o_orderstatus = 'F'").select("o_orderpriority")
    return R.same_values(R.domain_index(orders.select("o_orderpriority")), R.domain_index(done))


@query("""WITH n AS (SELECT count(*) AS a FROM nation), r AS (SELECT count(*) AS b FROM region), s AS (SELECT count(*) AS c FROM supplier)
SELECT 'nation' AS domain, i AS id, i AS packed FROM n, range(a) t(i) UNION ALL SELECT 'region', i, i + a + 1 FROM n, r, range(b) t(i) UNION ALL SELECT 'supplier', i, i + a + b + 2 FROM n, r, s, range(c) t(i)""")
def equivalence_map(spark: SparkSession, sf: str) -> DataFrame:
    """The domains of nations, regions and suppliers packed into one."""
    return R.packed(spark, **{t: table(spark, sf, t).count() for t in ("nation", "region", "supplier")})


@query("SELECT s_suppkey AS s FROM supplier WHERE false")
def rule_never(spark: SparkSession, sf: str) -> DataFrame:
    """empty(s) :- supIn(s, n), n < 0: ids are not negative, so the guard leaves nothing, and declares an empty relation."""
    return R.head(R.atom(relation(spark, sf, *SUP), "s", "n").where("n < 0"), s="s")


@query("SELECT n_nationkey::BIGINT AS n, n_nationkey::BIGINT AS m FROM nation WHERE n_regionkey = 2")
def rule_equal(spark: SparkSession, sf: str) -> DataFrame:
    """same(n, m) :- inRegion(n, 2), m = n: the equality binds a variable of the head that no atom has."""
    rows = R.atom(relation(spark, sf, *NATION), "n", 2).withColumn("m", F.col("n"))
    return R.head(rows, n="n", m="m")


@query("SELECT a.r_regionkey::BIGINT AS a, b.r_regionkey::BIGINT AS b, n_nationkey::BIGINT AS c FROM region a, region b, nation WHERE a.r_regionkey <> b.r_regionkey AND b.r_regionkey < n_nationkey")
def rule_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    """pick(a, b, c) :- a != b, b < c, nation(c): variables in comparisons only range over their domains."""
    r = relation(spark, sf, "region", "r_regionkey")
    return R.universe(a=r, b=r, c=relation(spark, sf, "nation", "n_nationkey")).where("a <> b and b < c")


@query("SELECT s_suppkey AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation)")
def rule_named_const(spark: SparkSession, sf: str) -> DataFrame:
    """bad(s) :- supIn(s, 'first name'): a constant by its name is looked up in the domain's dictionary."""
    names = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n"), "n_name")
    named = names.join(names.agg(F.min("n_name").alias("n_name")), "n_name").select("n")
    return R.head(R.having(R.atom(relation(spark, sf, *SUP), "s", "n"), named), s="s")


@query("SELECT DISTINCT l_partkey AS v FROM lineitem WHERE l_suppkey = 3")
def tuple_partial_match(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a relation with column k = j, projected to another column."""
    return R.head(R.atom(relation(spark, sf, *ITEM), None, "v", 3), v="v")


@query("SELECT n_nationkey::BIGINT AS n, n_nationkey::BIGINT + 5 AS m FROM nation WHERE n_nationkey BETWEEN 3 AND 17")
def range_and_shift(spark: SparkSession, sf: str) -> DataFrame:
    """varRange and buildAdd: an inclusive range, and a column that is another plus a constant."""
    n = relation(spark, sf, *NATION).where("n_nationkey between 3 and 17")
    return n.select(F.col("n_nationkey").alias("n"), (F.col("n_nationkey") + 5).alias("m"))


@query("SELECT l_orderkey AS o, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 3")
def count_tuples(spark: SparkSession, sf: str) -> DataFrame:
    pairs = R.head(R.atom(relation(spark, sf, *ITEM), "o", None, "s"), o="o", s="s")
    return pairs.groupBy("o").agg(F.count("*").alias("n")).where("n > 3")


@query("""WITH p AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS n, CASE WHEN s_suppkey % 3 > 0 THEN '1-URGENT' END AS p, CASE WHEN s_suppkey % 5 = 0 THEN 'F' END AS s FROM supplier WHERE s_suppkey % 6 <> 3),
o AS (SELECT c_nationkey AS n, o_orderpriority AS p, o_orderstatus AS s, count(*) AS n_orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
SELECT p.id, o.n, o.p, o.s, n_orders FROM p JOIN o ON (p.n IS NULL OR p.n = o.n) AND (p.p IS NULL OR p.p = o.p) AND (p.s IS NULL OR p.s = o.s)""")
def pattern_table(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers ask for orders by nation, priority and state, each binding some of them."""
    s = table(spark, sf, "supplier").where("s_suppkey % 6 <> 3")
    ask = s.select(
        F.col("s_suppkey").alias("id"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("n"),
        F.when(F.col("s_suppkey") % 3 > 0, F.lit("1-URGENT")).alias("p"),
        F.when(F.col("s_suppkey") % 5 == 0, F.lit("F")).alias("s"),
    )
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.groupBy(F.col("c_nationkey").alias("n"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n_orders"))
    return R.matching(ask, o, "n", "p", "s")
