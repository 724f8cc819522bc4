"""Ranking, calibration, evidence and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hornfels.functions import scalar as S
from hornfels.operators import evidence as E
from hornfels.operators import inference as I
from hornfels.operators import markov as M
from hornfels.operators import ranking as K
from hornfels.plans.registry import query, table
from hornfels.storage import materialise


def alarms(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as alarms: quality is the truth, length gives a confidence, toxic ones bear a label."""
    docs = table(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("confidence"))
    labels = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("truth"), F.when(F.col("toxic") == 1, F.when(F.col("quality") == 1, 1).otherwise(-1)).alias("label"))
    return docs.join(labels, "doc_id")


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(K.ranked(alarms(spark, sf), K.alarm_order("label", "confidence", "doc_id"), "truth"), "alarms")


RANKED = """a AS (SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS confidence, quality = 1 AS truth, CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 1 ELSE -1 END END AS label FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (ORDER BY coalesce(label, 0) DESC, confidence DESC, doc_id) AS rank FROM a),
k AS (SELECT *, sum(truth::INT) OVER (ORDER BY rank) AS trues FROM r)"""


@query(f"WITH {RANKED} SELECT doc_id, rank, trues::BIGINT AS trues FROM k")
def rank_alarms(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(spark, sf).select("doc_id", "rank", "trues")


@query(f"WITH {RANKED} SELECT sum(CASE WHEN truth THEN rank - trues ELSE 0 END)::BIGINT AS inversions, (sum(truth::INT) * sum((NOT truth)::INT))::BIGINT AS peak FROM k")
def inversions(spark: SparkSession, sf: str) -> DataFrame:
    return K.measures(ranked(spark, sf)).select("inversions", "peak")


@query(f"WITH {RANKED} SELECT round(sum(CASE WHEN truth THEN ln(2.0) / ln(rank + 1.0) END), 6) AS dcg FROM k")
def dcg(spark: SparkSession, sf: str) -> DataFrame:
    return K.measures(ranked(spark, sf)).select(F.round("dcg", 6).alias("dcg"))


@query(f"WITH {RANKED} SELECT round(1 - sum(CASE WHEN truth THEN rank - trues END)::DOUBLE / (sum(truth::INT) * sum((NOT truth)::INT)), 6) AS auc FROM k")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return K.measures(ranked(spark, sf)).select(F.round("auc", 6).alias("auc"))


@query(f"WITH {RANKED} SELECT rank, (rank - trues)::BIGINT AS falses, trues::BIGINT AS trues, round(trues / rank, 6) AS precision FROM k")
def tp_curve(spark: SparkSession, sf: str) -> DataFrame:
    return K.curve(ranked(spark, sf)).withColumn("precision", F.round("precision", 6))


@query(f"WITH {RANKED} SELECT round(avg(rank), 6) AS mean_rank, max(rank) AS lowest_rank FROM k WHERE truth")
def mean_rank(spark: SparkSession, sf: str) -> DataFrame:
    return K.measures(ranked(spark, sf)).select(F.round("mean_rank", 6).alias("mean_rank"), "lowest_rank")


@query(f"WITH {RANKED} SELECT median(rank) AS median_rank FROM k WHERE truth")
def median_rank(spark: SparkSession, sf: str) -> DataFrame:
    return K.median_rank(ranked(spark, sf))


@query(f"WITH {RANKED} SELECT doc_id FROM k WHERE label IS NULL ORDER BY rank LIMIT 10")
def next_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten unlabelled alarms: what to ask next."""
    return ranked(spark, sf).where("label is null").orderBy("rank").limit(10).select("doc_id")


@query(f"WITH {RANKED} SELECT p::INT AS p, round(avg((CASE WHEN floor(confidence * 100) >= p THEN truth ELSE NOT truth END)::INT), 6) AS accuracy FROM a, range(1, 100) t(p) GROUP BY p")
def rank_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    out = K.threshold_accuracy(alarms(spark, sf), "confidence", "truth")
    return out.select("p", F.round("accuracy", 6).alias("accuracy"))


@query(f"""WITH {RANKED}, s AS (SELECT count(*) FILTER (confidence >= 0.5 AND truth) AS tp, count(*) FILTER (confidence >= 0.5 AND NOT truth) AS fp, count(*) FILTER (confidence < 0.5 AND truth) AS fn, count(*) FILTER (confidence < 0.5 AND NOT truth) AS tn FROM a)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM s""")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    out = K.confusion(alarms(spark, sf), F.col("confidence") >= 0.5, F.col("truth"))
    return out.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query(f"WITH {RANKED}, s AS (SELECT sum(truth::INT) AS t, sum((NOT truth)::INT) AS f FROM a WHERE label IS NULL) SELECT (t * f / 2.0)::DOUBLE AS expected FROM s")
def expected_inversions(spark: SparkSession, sf: str) -> DataFrame:
    """Of a random order of the unlabelled alarms."""
    t = F.col("truth").cast("long")
    return alarms(spark, sf).where("label is null").agg((F.sum(t) * F.sum(1 - t) / 2.0).alias("expected"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source""")
def membership_matrix(spark: SparkSession, sf: str) -> DataFrame:
    wide = table(spark, sf, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).count().na.fill(0)
    return wide.select("source", (F.col("en") + F.col("de") + F.col("fr") + F.col("es")).alias("n"), "en", "de", "fr", "es")


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS total FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 200")
def carousel_cum_time(spark: SparkSession, sf: str) -> DataFrame:
    """Running time of the first 200 steps of each run."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").withColumn("k", F.row_number().over(by)).withColumn("total", F.round(F.sum("value").over(by.rowsBetween(Window.unboundedPreceding, 0)), 4))
    return rows.where("k <= 200").select("user_id", "event_id", "total")


@query("""SELECT user_id, count(*) FILTER (value > prev + 5 AND value > 1.1 * prev) AS n, round(coalesce(sum(value - prev) FILTER (value > prev + 5 AND value > 1.1 * prev), 0), 4) AS total FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY user_id""")
def false_gen_events(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of a run at which its value rises by more than 5 and a tenth: their number and total rise."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").withColumn("prev", F.lag("value").over(by))
    up = (F.col("value") > F.col("prev") + 5) & (F.col("value") > 1.1 * F.col("prev"))
    return rows.groupBy("user_id").agg(F.count(F.when(up, 1)).alias("n"), F.round(F.coalesce(F.sum(F.when(up, F.col("value") - F.col("prev"))), F.lit(0.0)), 4).alias("total"))


@query("""SELECT n, count(*) AS lines FROM (SELECT DISTINCT o_orderkey, s_nationkey::BIGINT AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey UNION SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY n""")
def pkg_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of each nation: one within a nation counts once, one across two nations in both."""
    t = lambda name: table(spark, sf, name)
    lines = t("lineitem").select("l_orderkey", "l_suppkey").distinct().join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    ends = lines.select(F.col("l_orderkey").alias("o"), F.col("s_nationkey").cast("long").alias("n"))
    buyers = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("o"), F.col("c_nationkey").cast("long").alias("n"))
    return ends.union(buyers).distinct().groupBy("n").agg(F.count("*").alias("lines"))


@query("SELECT p_partkey AS p, p_size::BIGINT AS size FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01')")
def missed_locs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of interest that no early line visits."""
    seen = table(spark, sf, "lineitem").where("l_shipdate < timestamp '1995-01-01'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(seen, "p_partkey", "left_anti").select(F.col("p_partkey").alias("p"), F.col("p_size").cast("long").alias("size"))


@query("SELECT source, i::INT AS i, (list_sort(list(n_chars)))[1 + floor(count(*) * i / 10)::BIGINT] AS value FROM documents, range(0, 10) t(i) GROUP BY source, i")
def coverage_deciles(spark: SparkSession, sf: str) -> DataFrame:
    """Values at places n * i / 10 of each source's lengths; one sort a source with a row for each place."""
    by = Window.partitionBy("source")
    rows = table(spark, sf, "documents").select("source", "n_chars").withColumn("k", F.row_number().over(by.orderBy("n_chars")) - 1).withColumn("n", F.count("*").over(by))
    spots = rows.select("source", "k", "n", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    return spots.where(F.col("k") == F.floor(F.col("n") * F.col("i") / 10)).select("source", "i", F.col("n_chars").alias("value"))


@query("SELECT md5(text) AS h, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY md5(text)")
def dedupe_by_content(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def table_summary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT l_partkey AS p, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS pos, count(DISTINCT l_orderkey) FILTER (l_returnflag <> 'R') AS neg FROM lineitem GROUP BY l_partkey""")
def support_counts(spark: SparkSession, sf: str) -> DataFrame:
    """In how many runs each location has positive and negative support, once a run."""
    runs = table(spark, sf, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.max((F.col("l_returnflag") == "R").cast("long")).alias("a"), F.max((F.col("l_returnflag") != "R").cast("long")).alias("b"))
    return runs.groupBy(F.col("l_partkey").alias("p")).agg(F.sum("a").alias("pos"), F.sum("b").alias("neg"))


def trace(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a trace: a user is a run; an event's type leads to the next one's."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("pid"), F.row_number().over(by).alias("seq"), F.col("event_type").alias("src"), F.lead("event_type").over(by).alias("dst"), "value")
    return rows.where("dst is not null")


TRACE = "t AS (SELECT * FROM (SELECT user_id AS pid, row_number() OVER w AS seq, event_type AS src, lead(event_type) OVER w AS dst, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE dst IS NOT NULL)"
NEG = "g AS (SELECT src, dst, count(DISTINCT pid) AS n FROM (SELECT *, max((value < 10)::INT) OVER (PARTITION BY pid, src ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM t) WHERE value <= 90 AND seen = 1 GROUP BY src, dst)"
POS = "c AS (SELECT src, dst, count(DISTINCT pid) / (SELECT count(DISTINCT pid) FROM t)::DOUBLE AS confidence FROM t WHERE value > 90 GROUP BY src, dst)"


@query(f"WITH {TRACE} SELECT DISTINCT src, dst FROM t WHERE value > 90")
def trace_pos_edges(spark: SparkSession, sf: str) -> DataFrame:
    return E.positive_edges(trace(spark, sf), F.col("value") > 90)


@query(f"WITH {TRACE}, {NEG} SELECT src, dst, n FROM g")
def trace_neg_edges(spark: SparkSession, sf: str) -> DataFrame:
    return E.negative_counts(trace(spark, sf), F.col("value") > 90, F.col("value") < 10)


@query(f"WITH {TRACE}, {POS} SELECT src, dst, round(confidence, 6) AS confidence FROM c")
def trace_conf(spark: SparkSession, sf: str) -> DataFrame:
    return E.confidences(trace(spark, sf), F.col("value") > 90).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {TRACE}, {POS}, {NEG} SELECT src, dst, n, round(1 - pow(1 - (SELECT avg(confidence) FROM c), n), 6) AS confidence FROM g")
def neg_conf(spark: SparkSession, sf: str) -> DataFrame:
    t = trace(spark, sf)
    p = E.confidences(t, F.col("value") > 90).agg(F.avg("confidence")).first()[0] or 0.0
    out = E.negative_confidence(E.negative_counts(t, F.col("value") > 90, F.col("value") < 10), p)
    return out.withColumn("confidence", F.round("confidence", 6))


@query("SELECT round(avg(CASE WHEN quality = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS loss FROM (SELECT quality, 1 / (1 + exp(-(0.414 + 2.167 * (n_chars % 100) / 100.0))) AS p FROM documents JOIN labels USING (doc_id))")
def log_loss(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    p = E.logistic((F.col("n_chars") % 100) / 100.0)
    return rows.agg(F.round(F.avg(E.log_loss(p, F.col("quality") == 1)), 6).alias("loss"))


@query("SELECT doc_id, round(1 / (1 + exp(-(0.414 + 2.167 * (n_chars % 100) / 100.0))), 6) AS p FROM documents")
def logistic_predict(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.round(E.logistic((F.col("n_chars") % 100) / 100.0), 6).alias("p"))


@query("SELECT vec_id, round(0.2 * a / (0.2 * a + 0.8 * (1 - a)), 6) AS p FROM (SELECT vec_id, 1 / (1 + exp(-label)) AS a FROM embeddings)")
def soft_evidence_posterior(spark: SparkSession, sf: str) -> DataFrame:
    a = 1 / (1 + F.exp(-F.col("label").cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(I.soft_posterior(F.lit(0.2), a), 6).alias("p"))


def ground(spark: SparkSession, sf: str) -> DataFrame:
    """poor(s) => low(n) for suppliers of a nation, weight 1; low(n) unlikely, weight -0.5; every nation of region 0 low, hard."""
    sup = table(spark, sf, "supplier").where("s_acctbal < 0")
    poor, low = F.concat(F.lit("poor("), "s_suppkey", F.lit(")")), F.concat(F.lit("low("), "s_nationkey", F.lit(")"))
    ident = F.concat(F.lit("i"), F.col("s_suppkey").cast("string"))
    parts = sup.select(ident.alias("clause_id"), F.lit(1.0).alias("weight"), F.explode(F.array(F.struct(poor.alias("tuple"), F.lit(False).alias("positive")), F.struct(low.alias("tuple"), F.lit(True).alias("positive")))).alias("x"))
    n = F.concat(F.lit("low("), F.col("n_nationkey").cast("string"), F.lit(")"))
    nation = table(spark, sf, "nation")
    soft = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("clause_id"), F.lit(-0.5).alias("weight"), n.alias("tuple"), F.lit(True).alias("positive"))
    hard = nation.where("n_regionkey = 0").select(F.concat(F.lit("h"), F.col("n_nationkey").cast("string")).alias("clause_id"), F.lit(None).cast("double").alias("weight"), n.alias("tuple"), F.lit(True).alias("positive"))
    said = sup.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("clause_id"), F.lit(2.0).alias("weight"), poor.alias("tuple"), F.lit(True).alias("positive"))
    return parts.select("clause_id", "weight", "x.tuple", "x.positive").unionByName(soft).unionByName(hard).unionByName(said)


GROUND = """g AS (SELECT 'i' || s_suppkey AS clause_id, 1.0::DOUBLE AS weight, unnest(['poor(' || s_suppkey || ')', 'low(' || s_nationkey || ')']) AS tuple, unnest([false, true]) AS positive FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT 'n' || n_nationkey, -0.5, 'low(' || n_nationkey || ')', true FROM nation UNION ALL SELECT 'h' || n_nationkey, NULL, 'low(' || n_nationkey || ')', true FROM nation WHERE n_regionkey = 0
UNION ALL SELECT 's' || s_suppkey, 2.0, 'poor(' || s_suppkey || ')', true FROM supplier WHERE s_acctbal < 0)"""


@query(f"WITH {GROUND} SELECT * FROM g")
def mln_ground_clauses(spark: SparkSession, sf: str) -> DataFrame:
    return ground(spark, sf)


@query(f"""WITH {GROUND}, t AS (SELECT 'poor(' || s_suppkey || ')' AS tuple FROM supplier WHERE s_acctbal < 0), s AS (SELECT clause_id, weight, bool_or((tuple IN (SELECT tuple FROM t)) = positive) AS ok FROM g GROUP BY clause_id, weight)
SELECT count(*) FILTER (weight IS NULL AND NOT ok) AS violations, coalesce(sum(abs(weight)) FILTER ((weight > 0 AND NOT ok) OR (weight < 0 AND ok)), 0) AS cost, coalesce(sum(weight) FILTER (ok), 0) AS objective FROM s""")
def mln_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Violations, cost and objective of the assignment in which only poor(s) is true."""
    true = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("poor("), "s_suppkey", F.lit(")")).alias("tuple"))
    return M.evaluation(ground(spark, sf), true)


@query(f"""WITH {GROUND}, k AS (SELECT n_nationkey AS n, n_regionkey = 0 AS must, (SELECT count(*) FROM supplier WHERE s_acctbal < 0 AND s_nationkey = n_nationkey) AS c FROM nation)
SELECT sum(CASE WHEN must OR c > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS cost, 0::BIGINT AS violations FROM k""")
def mln_solution_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Cost of the solved assignment: each nation with a poor supplier, or of region 0, is low."""
    g = materialise(ground(spark, sf), "ground")
    return M.evaluation(g, M.solve(g)).select(F.round("cost", 6).alias("cost"), "violations")


@query("SELECT c_nationkey::BIGINT AS n, count(*) AS k FROM customer GROUP BY 1 HAVING count(*) NOT BETWEEN 1 AND 50")
def cardinality_check(spark: SparkSession, sf: str) -> DataFrame:
    """Keys for which a relation has other than 1 to 50 tuples."""
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("n")).agg(F.count("*").alias("k")).where("k not between 1 and 50")


@query("""SELECT p_partkey AS p, sign(p_retailprice - 1000)::INT AS sgn, abs(p_size - 25)::BIGINT AS dist, ceil(p_retailprice) AS up, floor(p_retailprice) AS down, trunc(-p_retailprice) AS cut, round(ln(p_retailprice), 6) AS ln, round(log10(p_retailprice), 6) AS lg,
round(sqrt(p_retailprice), 6) AS root, round(sin(p_size), 6) AS sine, round(pow(p_size, 1.5), 4) AS power, (p_partkey % 7)::BIGINT AS rest, factorial(p_size % 10)::BIGINT AS fact, round(exp(p_size / 50.0), 6) AS ex, round(log(2, p_retailprice), 6) AS logb, round(cos(p_size), 6) AS cosine, round(tan(p_size), 6) AS tangent, round_even(p_size / 2.0, 0)::DOUBLE AS even FROM part""")
def fn_math(spark: SparkSession, sf: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("p"), F.signum(price - 1000).cast("int").alias("sgn"), F.abs(size - 25).cast("long").alias("dist"), F.ceil(price).cast("double").alias("up"), F.floor(price).cast("double").alias("down"),
        S.trunc(-price).alias("cut"), F.round(F.log(price), 6).alias("ln"), F.round(S.lg(price), 6).alias("lg"), F.round(F.sqrt(price), 6).alias("root"), F.round(F.sin(size.cast("double")), 6).alias("sine"),
        F.round(F.pow(size, F.lit(1.5)), 4).alias("power"), (F.col("p_partkey") % 7).alias("rest"), F.factorial(size % 10).alias("fact"), F.round(F.exp(size / 50.0), 6).alias("ex"), F.round(S.log(F.lit(2.0), price), 6).alias("logb"), F.round(F.cos(size.cast("double")), 6).alias("cosine"), F.round(F.tan(size.cast("double")), 6).alias("tangent"), S.round_even(size / 2.0).alias("even"),
    )


@query("""SELECT p_partkey AS p, length(p_name)::INT AS n, upper(p_type) AS up, lower(p_type) AS low, trim('  ' || p_brand || ' ') AS cut, md5(p_name) AS h, p_brand || '/' || p_type AS both_, strpos(p_name, ' ')::INT AS at, repeat(substr(p_brand, 1, 2), 2) AS twice,
substr(p_name, 2, 4) AS part, replace(p_brand, '#', '-') AS changed, split_part(p_name, ' ', 2) AS word, regexp_replace(p_name, '[aeiou]', '_') AS vowels, array_to_string(list_transform(string_split(p_type, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title FROM part""")
def fn_string(spark: SparkSession, sf: str) -> DataFrame:
    name, brand = F.col("p_name"), F.col("p_brand")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("p"), F.char_length(name).alias("n"), F.upper("p_type").alias("up"), F.lower("p_type").alias("low"), F.trim(F.concat(F.lit("  "), brand, F.lit(" "))).alias("cut"), F.md5(name).alias("h"),
        F.concat(brand, F.lit("/"), "p_type").alias("both_"), S.strpos(name, " ").alias("at"), F.repeat(F.substring(brand, 1, 2), 2).alias("twice"), F.substring(name, 2, 4).alias("part"), F.replace(brand, F.lit("#"), F.lit("-")).alias("changed"),
        S.split_part(name, " ", 2).alias("word"), S.regex_replace(name, "[aeiou]", "_").alias("vowels"), S.initcap(F.col("p_type")).alias("title"),
    )


@query("SELECT p_partkey AS p, p_partkey & 12 AS a, p_partkey | 3 AS o, xor(p_partkey, 5) AS x, ~p_partkey AS n, p_partkey << 2 AS l, p_partkey >> 1 AS r FROM part")
def fn_bits(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(p.alias("p"), p.bitwiseAND(F.lit(12)).alias("a"), p.bitwiseOR(F.lit(3)).alias("o"), p.bitwiseXOR(F.lit(5)).alias("x"), F.bitwise_not(p).alias("n"), S.shift_left(p, 2).alias("l"), S.shift_right(p, 1).alias("r"))


@query("SELECT p_partkey AS p, contains(p_name, 'an') AS c, starts_with(p_type, 'S') AS s, ends_with(p_type, 'L') AS e, p_size = 7 OR p_size < 3 AS q, NOT (p_size >= 10 AND p_size <> 20) AS b, p_size <= 9 AS le, p_size > 30 AS gt FROM part")
def fn_pred(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("p"), F.contains(F.col("p_name"), F.lit("an")).alias("c"), F.startswith(F.col("p_type"), F.lit("S")).alias("s"), F.endswith(F.col("p_type"), F.lit("L")).alias("e"),
        ((size == 7) | (size < 3)).alias("q"), (~((size >= 10) & (size != 20))).alias("b"), (size <= 9).alias("le"), (size > 30).alias("gt"),
    )
