"""Checks of locks on the events table as a trace: users are threads, a value's class is a lock, every other event releases it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornfels.operators import locks as K
from hornfels.operators.graph import scc
from hornfels.plans.registry import query, table
from hornfels.storage import materialise

SPELLS = """e AS (SELECT user_id AS t, event_id AS q, floor(value)::BIGINT % 12 AS l, event_id % 2 = 0 AS up FROM events WHERE value IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN up THEN 1 ELSE -1 END) OVER (PARTITION BY t, l ORDER BY q) AS s FROM e), d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY t, l ORDER BY q)) AS d FROM s),
c AS (SELECT *, lag(d, 1, 0) OVER (PARTITION BY t, l ORDER BY q) AS b FROM d), x AS (SELECT *, lead(q) OVER (PARTITION BY t, l ORDER BY q) AS f FROM c WHERE b + d = 1),
i AS (SELECT t, l, q AS a, coalesce(f, 4611686018427387904) AS z FROM x WHERE d = 1),
o AS (SELECT j.t, j.a AS q, i.l AS u, j.l AS v FROM i JOIN i j ON i.t = j.t AND i.a < j.a AND j.a < i.z)"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").where("value is not null")
    lock = F.floor("value").cast("long") % 12
    return rows.select(F.col("user_id").alias("thread"), F.col("event_id").alias("seq"), lock.alias("lock"), (F.col("event_id") % 2 == 0).alias("acquired"))


@query(f"WITH {SPELLS} SELECT u, v, count(DISTINCT t) AS threads FROM o GROUP BY u, v")
def lock_order(spark: SparkSession, sf: str) -> DataFrame:
    return K.lock_order(materialise(log(spark, sf), "log"))


@query(f"""WITH RECURSIVE {SPELLS}, w AS (SELECT u, v, count(DISTINCT t) AS n FROM o GROUP BY u, v), g AS (SELECT w.u, w.v FROM w LEFT JOIN w m ON m.u = w.v AND m.v = w.u WHERE w.n > coalesce(m.n, 0)), r AS (SELECT u, v FROM g UNION SELECT r.u, g.v FROM r JOIN g ON r.v = g.u),
n AS (SELECT u AS node FROM g UNION SELECT v FROM g)
SELECT node, coalesce((SELECT least(node, min(p.v)) FROM r p JOIN r q ON p.v = q.u AND q.v = p.u WHERE p.u = node), node) AS scc FROM n""")
def lock_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Locks by strongly connected component of the orders that more threads take than the reverse ones."""
    order = materialise(K.lock_order(materialise(log(spark, sf), "log")), "order")
    back = order.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("threads").alias("reverse"))
    return scc(order.join(back, ["u", "v"], "left").where("threads > coalesce(reverse, 0)").select("u", "v"))


@query(f"""WITH {SPELLS}, h AS (SELECT t, q, v, list(DISTINCT u) AS us FROM o GROUP BY t, q, v), y AS (SELECT t, v, unnest(us) AS u, us FROM h), k AS (SELECT DISTINCT t, u, v, list_filter(us, lambda w: w <> u) AS gs FROM y)
SELECT DISTINCT m.u AS a, m.v AS b FROM k m JOIN k n ON m.u = n.v AND m.v = n.u AND m.u < m.v AND m.t <> n.t AND NOT list_has_any(m.gs, n.gs)""")
def lock_deadlocks(spark: SparkSession, sf: str) -> DataFrame:
    return K.deadlocks(materialise(log(spark, sf), "log"))


@query(f"""WITH {SPELLS}, p AS (SELECT user_id AS t, event_id AS q, event_id // 3 % 977 AS var, event_id % 5 = 0 AS w FROM events), al AS (SELECT var, count(*) AS n, bool_or(w) AS w, count(DISTINCT t) AS threads FROM p GROUP BY var),
un AS (SELECT var, l, count(*) AS k FROM p JOIN i ON p.t = i.t AND i.a < p.q AND p.q < i.z GROUP BY var, l)
SELECT var, threads FROM al WHERE w AND threads > 1 AND NOT EXISTS (SELECT 1 FROM un WHERE un.var = al.var AND un.k = al.n)""")
def lock_unguarded(spark: SparkSession, sf: str) -> DataFrame:
    var = F.floor(F.col("event_id") / 3) % 977
    accesses = table(spark, sf, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("seq"), var.alias("var"), (F.col("event_id") % 5 == 0).alias("writes"))
    return K.unguarded(materialise(log(spark, sf), "log"), accesses)
