"""Weighted clauses that need elimination, and such as are grounded lazily."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hornfels.operators import grounding as L
from hornfels.operators import markov as M
from hornfels.operators.elimination import eliminate
from hornfels.plans.registry import query, relation, table
from hornfels.storage import materialise


def _name(kind: str, *columns: str) -> F.Column:
    return F.concat(F.lit(f"{kind}("), F.concat_ws(",", *columns), F.lit(")"))


def picks(spark: SparkSession, sf: str) -> DataFrame:
    """pick(o) weighs the order's whole price (soft); of a customer's orders no two in a row may be picked (hard)."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), F.floor("o_totalprice").cast("double").alias("w"))
    after = o.withColumn("next", F.lead("o").over(W.partitionBy("c").orderBy("o")))
    wish = o.select("c", _name("wish", "o").alias("clause_id"), F.col("w").alias("weight"), _name("pick", "o").alias("tuple"), F.lit(True).alias("positive"))
    apart = after.where("next is not null").select("c", _name("apart", "o").alias("clause_id"), F.explode(F.array("o", "next")).alias("x"))
    return wish.unionByName(apart.select("c", "clause_id", F.lit(None).cast("double").alias("weight"), _name("pick", "x").alias("tuple"), F.lit(False).alias("positive")))


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS c, floor(o_totalprice) AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
s AS (SELECT c, k, w AS taken, 0.0::DOUBLE AS passed FROM o WHERE k = 1 UNION ALL SELECT o.c, o.k, s.passed + o.w, greatest(s.taken, s.passed) FROM s JOIN o ON o.c = s.c AND o.k = s.k + 1),
m AS (SELECT c, max(k) AS k, sum(w) AS w FROM o GROUP BY c)
SELECT m.c::BIGINT AS c, m.w - greatest(s.taken, s.passed) AS cost, 0::BIGINT AS violations FROM m JOIN s USING (c, k)""")
def mln_elimination(spark: SparkSession, sf: str) -> DataFrame:
    """Least cost of leaving orders out so that no two in a row of a customer are picked; each customer is a chain of its own."""
    rows = materialise(picks(spark, sf), "picks")
    true = eliminate(rows.drop("c")).where("value").select("tuple")
    named = rows.select("clause_id", F.col("c").cast("long").alias("c")).distinct()
    lost = ~F.col("ok")
    return M.satisfied(rows.drop("c"), true).join(named, "clause_id").groupBy("c").agg(
        F.sum(F.when(lost, F.coalesce("weight", F.lit(0.0))).otherwise(0.0)).alias("cost"), F.sum((lost & F.isnull("weight")).cast("long")).alias("violations"),
    )


LAZY = """WITH bad AS (SELECT s_suppkey AS s FROM supplier WHERE s_acctbal < 0), i AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
t AS (SELECT DISTINCT i.o, i.s FROM i JOIN bad USING (s)), h AS (SELECT DISTINCT o_custkey AS c, o FROM t JOIN orders ON o_orderkey = o), k AS (SELECT c, count(*) AS k FROM h GROUP BY c)
SELECT (SELECT sum(least(k, 2.5)) FROM k)::DOUBLE AS cost, 0::BIGINT AS violations, (SELECT count(*) FROM t) + (SELECT count(*) FROM h) + (SELECT count(*) FROM k) AS grounded,
(SELECT count(*) FROM i) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT o_custkey) FROM orders) AS whole"""


@query(LAZY)
def mln_lazy(spark: SparkSession, sf: str) -> DataFrame:
    """An order with an item of a supplier in debt is late (hard); a customer with a late order complains (1), which few do (2.5).

    Suppliers in debt are evidence: it is no tuple of the clauses, which are ground without it. Only clauses that a solution violates
    are grounded: their number stands beside that of all ground clauses.
    """
    debt = materialise(table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").cast("long").alias("s")), "debt")
    item = materialise(relation(spark, sf, "lineitem", "l_orderkey", "l_suppkey").toDF("o", "s").distinct(), "item")
    order = relation(spark, sf, "orders", "o_orderkey", "o_custkey").toDF("o", "c")

    def clause(rows: DataFrame, name: F.Column, weight: float | None, *literals: tuple[F.Column, bool]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(t.alias("tuple"), F.lit(p).alias("positive")) for t, p in literals])).alias("l")
        return rows.select(name.alias("clause_id"), F.lit(weight).cast("double").alias("weight"), each).select("clause_id", "weight", "l.tuple", "l.positive")

    def holding(true: DataFrame, kind: str, key: str) -> DataFrame:
        return true.where(F.col("tuple").startswith(f"{kind}(")).select(F.regexp_extract("tuple", r"\((\d+)\)", 1).cast("long").alias(key))

    def violated(true: DataFrame) -> DataFrame:
        late, sad = holding(true, "late", "o"), holding(true, "complains", "c")
        spreads = item.join(debt, "s", "left_semi").join(late, "o", "left_anti")
        upset = order.join(late, "o", "left_semi").join(sad, "c", "left_anti")
        return (
            clause(spreads, _name("spreads", "o", "s"), None, (_name("late", "o"), True))
            .union(clause(upset, _name("upset", "o"), 1.0, (_name("late", "o"), False), (_name("complains", "c"), True)))
            .union(clause(sad, _name("few", "c"), 2.5, (_name("complains", "c"), False)))
        )

    nothing = violated(debt.select(F.lit("").alias("tuple")).limit(0)).limit(0)
    true, ground, _ = L.lazily(nothing, violated, M.solve)
    none = F.lit(0).cast("long")
    grounded = ground.agg(F.count_distinct("clause_id").alias("k")).select(F.lit(0.0).alias("cost"), none.alias("violations"), F.col("k").alias("grounded"), none.alias("whole"))
    sizes = item.agg(F.count("*").alias("k")).union(order.agg(F.count("*"))).union(order.agg(F.count_distinct("c")))
    whole = sizes.select(F.lit(0.0).alias("cost"), none.alias("violations"), none.alias("grounded"), F.col("k").alias("whole"))
    found = M.evaluation(ground, true).select("cost", "violations", none.alias("grounded"), none.alias("whole"))
    return found.union(grounded).union(whole).agg(*[F.sum(c).alias(c) for c in found.columns])
