"""Labels over clauses, points-to by call strings and matched calls, on programs that the tables hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hornfels.operators import calls as C
from hornfels.operators import labels as L
from hornfels.plans.registry import query, table
from hornfels.storage import materialise

MUST, NOT_MAY = ("1-URGENT", "2-HIGH", "5-LOW"), "2-HIGH"


def _id(letter: str, *columns: str) -> Column:
    return F.concat(F.lit(letter), F.concat_ws(":", *[F.col(c).cast("string") for c in columns]))


@query("""WITH ln AS MATERIALIZED (SELECT l_orderkey AS o, l_linenumber AS k, CASE WHEN bool_or(l_returnflag = 'R') THEN TRUE WHEN bool_and(l_returnflag = 'A') THEN FALSE END AS v FROM lineitem GROUP BY 1, 2),
lo AS (SELECT o, bool_or(coalesce(v, FALSE)) AS t, bool_and(coalesce(NOT v, FALSE)) AS f, count(*) FILTER (WHERE v IS NULL) AS u FROM ln GROUP BY o),
ord AS (SELECT o_orderkey AS o, o_custkey AS c, o_orderpriority AS p, o_orderpriority = '1-URGENT' AND o_orderkey % 4 = 0 AS seeded FROM orders),
od AS MATERIALIZED (SELECT ord.*, CASE WHEN seeded OR t THEN TRUE WHEN f THEN FALSE END AS v, seeded AND coalesce(f, FALSE) AS clash, seeded AND NOT t AND u = 1 AS pick, u FROM ord LEFT JOIN lo ON lo.o = ord.o),
cl AS MATERIALIZED (SELECT c, p, p IN ('1-URGENT', '2-HIGH', '5-LOW') AS must, p <> '2-HIGH' AS may, count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS undecided, count(*) FILTER (WHERE NOT v) AS falses, count(*) FILTER (WHERE NOT seeded) AS m FROM od GROUP BY c, p),
cc AS (SELECT cl.*, c_acctbal < 0 AS seed FROM cl JOIN customer ON c_custkey = c),
cf AS (SELECT c, bool_or(must AND undecided = 0 AND falses = 0 AND NOT (seed AND m = 1)) AS forced, bool_and(falses > 0) AND bool_or(may AND falses > 0) AS failed FROM cc GROUP BY c),
cu AS MATERIALIZED (SELECT c_custkey AS c, c_nationkey AS nat, c_mktsegment AS seg, CASE WHEN c_acctbal < 0 THEN FALSE WHEN forced THEN TRUE WHEN failed THEN FALSE END AS v, c_acctbal < 0 AND coalesce(forced, FALSE) AS clash FROM customer LEFT JOIN cf ON c = c_custkey),
bk AS MATERIALIZED (SELECT od.o, coalesce(m = 1 AND od.v, FALSE) AS torn FROM od JOIN cc ON cc.c = od.c AND cc.p = od.p WHERE seed AND must AND NOT seeded AND ((m = 1 AND coalesce(od.v, TRUE)) OR (m > 1 AND undecided = 1 AND falses = 0 AND od.v IS NULL))),
ct AS MATERIALIZED (SELECT c FROM cc WHERE NOT seed GROUP BY c HAVING bool_or(must AND undecided = 0 AND falses = 0) AND NOT bool_or(may AND undecided = 0 AND falses = 0) AND count(*) FILTER (WHERE may AND undecided > 0 AND falses = 0) = 1),
li AS MATERIALIZED (SELECT od.o FROM od JOIN cc ON cc.c = od.c AND cc.p = od.p JOIN ct ON ct.c = od.c WHERE may AND undecided > 0 AND falses = 0 AND od.v IS NULL),
fin AS MATERIALIZED (SELECT od.o, CASE WHEN torn THEN NULL WHEN bk.o IS NOT NULL THEN FALSE WHEN li.o IS NOT NULL THEN TRUE ELSE od.v END AS v, clash OR coalesce(torn, FALSE) AS clash, pick OR (li.o IS NOT NULL AND u = 1) AS pick, bk.o IS NOT NULL AS back
FROM od LEFT JOIN bk ON bk.o = od.o LEFT JOIN li ON li.o = od.o),
lf AS (SELECT 'l' || ln.o || ':' || k AS tuple, CASE WHEN ln.v IS NOT NULL THEN ln.v WHEN pick THEN TRUE WHEN back AND fin.v = FALSE THEN FALSE END AS value FROM ln LEFT JOIN fin ON fin.o = ln.o),
nc AS (SELECT nat, seg, count(*) FILTER (WHERE v IS NULL) AS undecided, count(*) FILTER (WHERE NOT v) AS falses FROM cu GROUP BY nat, seg),
nv AS (SELECT nat, CASE WHEN bool_or(undecided = 0 AND falses = 0) THEN TRUE WHEN bool_and(falses > 0) THEN FALSE END AS v FROM nc GROUP BY nat)
SELECT tuple, value, FALSE AS conflict FROM lf WHERE value IS NOT NULL UNION ALL SELECT 'o' || o, v, clash FROM fin WHERE v IS NOT NULL OR clash
UNION ALL SELECT 'c' || c, v, clash FROM cu WHERE v IS NOT NULL UNION ALL SELECT 'n' || nat, v, FALSE FROM nv WHERE v IS NOT NULL""")
def label_propagation(spark: SparkSession, sf: str) -> DataFrame:
    """Orders hold by any line, customers by all orders of a priority, nations by all customers of a segment; returned lines are true,
    accepted ones and customers in debt false, some urgent orders true."""
    line = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("k"))
    line = line.agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"), F.min((F.col("l_returnflag") == "A").cast("int")).alias("a"))
    order = table(spark, sf, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"))
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"), "c_acctbal")
    yes, urgent = F.lit(True), F.col("p").isin(*MUST)
    clauses = line.select(_id("L", "o", "k").alias("clause_id"), _id("o", "o").alias("head"), _id("l", "o", "k").alias("lit"), yes.alias("must"), yes.alias("may"))
    clauses = clauses.union(order.select(_id("O", "c", "p"), _id("c", "c"), _id("o", "o"), urgent, F.col("p") != NOT_MAY))
    clauses = clauses.union(customer.select(_id("C", "n", "s"), _id("n", "n"), _id("c", "c"), yes, yes))
    seeds = line.where("r = 1 or a = 1").select(_id("l", "o", "k").alias("tuple"), (F.col("r") == 1).alias("value"))
    seeds = seeds.union(customer.where("c_acctbal < 0").select(_id("c", "c"), F.lit(False)))
    seeds = seeds.union(order.where("p = '1-URGENT' and o % 4 = 0").select(_id("o", "o"), yes))
    return L.propagate(materialise(clauses, "clauses"), materialise(seeds, "seeds")).select("tuple", "value", "conflict")


def _kept(spark: SparkSession, sf: str) -> C.Program:
    """Nations' procedures make an object for each customer and send it to its segment's ``keep`` (which returns it) and ``wrap``
    (which returns what one identity procedure, that all segments share, returns)."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"))
    c = materialise(c, "customers")
    kinds, segments, nations = c.select("n", "s").distinct(), c.select("s").distinct(), c.select("n").distinct()
    one = lambda *row, schema: spark.createDataFrame([row], schema)
    zero = F.lit("0")
    site = c.select(_id("d", "c").alias("i"), "c", "n", "s", F.lit("keep").alias("f"), F.lit("r").alias("out")).union(c.select(_id("w", "c"), "c", "n", "s", F.lit("wrap"), F.lit("q")))
    result = F.concat("out", F.col("c").cast("string"))
    variable = c.select(_id("x", "c").alias("v"), _id("N", "n").alias("m")).union(site.select(result, _id("N", "n")))
    variable = variable.union(segments.select(_id("p", "s"), _id("K", "s"))).union(segments.select(_id("a", "s"), _id("W", "s"))).union(segments.select(_id("b", "s"), _id("W", "s"))).union(one("i", "ID", schema="v string, m string"))
    return C.Program(
        entry=one("main", schema="m string"),
        variable=variable,
        new=c.select(_id("x", "c").alias("v"), _id("h", "n", "s").alias("h")),
        assign=spark.createDataFrame([], "v string, w string"),
        load=spark.createDataFrame([], "v string, w string, f string"),
        store=spark.createDataFrame([], "v string, f string, w string"),
        static=nations.select(_id("n", "n").alias("i"), F.lit("main").alias("m"), _id("N", "n").alias("n")).union(segments.select(_id("j", "s"), _id("W", "s"), F.lit("ID"))),
        virtual=site.select("i", _id("N", "n").alias("m"), _id("x", "c").alias("v"), F.col("f").alias("s")),
        dispatch=kinds.select(_id("h", "n", "s").alias("h"), F.lit("keep").alias("s"), _id("K", "s").alias("n")).union(kinds.select(_id("h", "n", "s"), F.lit("wrap"), _id("W", "s"))),
        argument=site.select("i", zero.alias("z"), _id("x", "c").alias("v")).union(segments.select(_id("j", "s"), zero, _id("a", "s"))),
        parameter=segments.select(_id("K", "s").alias("n"), zero.alias("z"), _id("p", "s").alias("v")).union(segments.select(_id("W", "s"), zero, _id("a", "s"))).union(one("ID", "0", "i", schema="n string, z string, v string")),
        result=site.select("i", result.alias("v")).union(segments.select(_id("j", "s"), _id("b", "s"))),
        returned=segments.select(_id("K", "s").alias("n"), _id("p", "s").alias("v")).union(segments.select(_id("W", "s"), _id("b", "s"))).union(one("ID", "i", schema="n string, v string")),
    )


OBJECTS = "c AS (SELECT c_custkey AS c, c_nationkey AS n, c_mktsegment AS s FROM customer), o AS (SELECT DISTINCT n, s FROM c)"
OWN = "'h' || n || ':' || s"


def _results(spark: SparkSession, sf: str, k: int) -> DataFrame:
    found = C.points_to(_kept(spark, sf), k)["points"].where("v rlike '^[rq][0-9]+$'").select("v", "h")
    return found.distinct() if k else found  # without contexts no row is there twice


@query(f"WITH {OBJECTS} SELECT 'r' || c.c AS v, 'h' || o.n || ':' || o.s AS h FROM c JOIN o ON o.s = c.s UNION ALL SELECT 'q' || c.c, 'h' || o.n || ':' || o.s FROM c, o")
def call_strings_none(spark: SparkSession, sf: str) -> DataFrame:
    """One copy of a procedure: what is kept mixes with the segment's, what is wrapped with all."""
    return _results(spark, sf, 0)


@query(f"WITH {OBJECTS} SELECT 'r' || c AS v, {OWN} AS h FROM c UNION ALL SELECT 'q' || c.c, 'h' || o.n || ':' || o.s FROM c JOIN o ON o.s = c.s")
def call_strings_one(spark: SparkSession, sf: str) -> DataFrame:
    """A copy for each last call site: what is kept stays apart, the shared identity mixes a segment."""
    return _results(spark, sf, 1)


@query(f"WITH {OBJECTS} SELECT unnest(['r' || c, 'q' || c]) AS v, {OWN} AS h FROM c")
def call_strings_two(spark: SparkSession, sf: str) -> DataFrame:
    """A copy for the last two: all stays apart."""
    return _results(spark, sf, 2)


def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(intra, call, back, lines): an order calls its lines' suppliers in turn, a supplier its nation, a nation itself; one in debt never returns."""
    line = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("k")).agg(F.min("l_suppkey").alias("s"))
    later = F.lead("k").over(Window.partitionBy("o").orderBy("k"))
    line = materialise(line.select("o", "k", "s", _id("o", "o", "k").alias("here"), F.concat(_id("o", "o"), F.lit(":"), F.coalesce(later.cast("string"), F.lit("end"))).alias("there")), "lines")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("n"), "s_acctbal")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("n"))
    at = lambda letter, c, place: F.concat(F.lit(letter), F.col(c).cast("string"), F.lit(f":{place}"))
    edge = lambda rows, letter, c, *pairs: [rows.select(at(letter, c, u).alias("u"), at(letter, c, v).alias("v")) for u, v in pairs]
    intra = [*edge(s, "s", "s", ("in", "mid")), *edge(s.where("s_acctbal >= 0"), "s", "s", ("back", "out")), *edge(n, "n", "n", ("in", "out"), ("in", "again"), ("after", "out"))]
    call = line.select(F.col("here").alias("u"), at("s", "s", "in").alias("v"), F.col("here").alias("i"))
    call = call.union(s.select(at("s", "s", "mid"), at("n", "n", "in"), _id("s", "s"))).union(n.select(at("n", "n", "again"), at("n", "n", "in"), _id("n", "n")))
    back = line.select(at("s", "s", "out").alias("u"), F.col("there").alias("v"), F.col("here").alias("i"))
    back = back.union(s.select(at("n", "n", "out"), at("s", "s", "back"), _id("s", "s"))).union(n.select(at("n", "n", "out"), at("n", "n", "after"), _id("n", "n")))
    whole = intra[0]
    for more in intra[1:]:
        whole = whole.union(more)
    return whole, call, back, line


RUNS = """l AS (SELECT l_orderkey AS o, l_linenumber AS k, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
x AS MATERIALIZED (SELECT o, k, s, s_nationkey AS n, s_acctbal < 0 AS stuck, coalesce(sum((s_acctbal < 0)::INT) OVER (PARTITION BY o ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
coalesce(sum((s_acctbal < 0)::INT) OVER (PARTITION BY o ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS behind FROM l JOIN supplier ON s_suppkey = s)"""


@query(f"""WITH {RUNS} SELECT 'o' || o || ':' || k AS node FROM x WHERE before = 0 UNION SELECT 'o' || o || ':end' FROM x GROUP BY o HAVING NOT bool_or(stuck)
UNION SELECT 's' || s || unnest([':in', ':mid', ':back']) FROM x WHERE before = 0 UNION SELECT 's' || s || ':out' FROM x WHERE before = 0 AND NOT stuck
UNION SELECT 'n' || n || unnest([':in', ':again', ':after', ':out']) FROM x WHERE before = 0""")
def matched_runs(spark: SparkSession, sf: str) -> DataFrame:
    """What orders get to from their first lines, if a supplier that serves many returns to the one that called it."""
    intra, call, back, line = _runs(spark, sf)
    first = line.groupBy("o").agg(F.min("k").alias("k")).select(_id("o", "o", "k").alias("node"))
    return C.matched_reach(intra, call, back, first)


@query(f"""WITH {RUNS}, u AS (SELECT x.* FROM x JOIN orders ON o_orderkey = o WHERE o_orderpriority = '1-URGENT' AND behind = 0), e AS (SELECT DISTINCT s, n, stuck FROM u)
SELECT 'o' || o || ':end' AS node, 1 AS pass FROM u UNION SELECT 'o' || o || ':' || k, 1 FROM u WHERE NOT stuck UNION SELECT 's' || s || ':out', 2 FROM e
UNION SELECT 's' || s || unnest([':in', ':mid', ':back']), 2 FROM e WHERE NOT stuck UNION SELECT 'n' || n || unnest([':in', ':again', ':after', ':out']), 2 FROM e WHERE NOT stuck""")
def two_pass_slice(spark: SparkSession, sf: str) -> DataFrame:
    """What the ends of urgent orders depend on; no other order is in it, though they share suppliers."""
    intra, call, back, line = _runs(spark, sf)
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("o"))
    ends = line.join(urgent, "o", "left_semi").select(F.concat(_id("o", "o"), F.lit(":end")).alias("node")).distinct()
    return C.two_pass_slice(intra, call, back, ends)
