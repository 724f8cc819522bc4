"""Text formats of tuples, dictionaries, clauses and traces, as DataFrame transformations of ``spark.read.text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tuples_from(lines: DataFrame, columns: list[str], sizes: list[int] | None = None) -> DataFrame:
    """Rows of ids from ``value`` lines of blank-separated fields: a number, a range ``a-b``, or ``*`` for a whole domain.

    Lines that begin with # and empty lines are skipped, and lines with another number of fields or with a
    field that is none of these. ``sizes`` are the domains' sizes, which ``*`` needs.
    """
    text = F.trim("value")
    rows = lines.where(~text.startswith("#") & (text != "")).select(F.split(text, r"\s+").alias("f")).where(F.size("f") == len(columns))

    def values(k: int) -> Column:
        f = F.col("f")[k]
        ends = F.split(f, "-")
        single, span = f.rlike(r"^\d+$"), f.rlike(r"^\d+-\d+$")
        whole = F.sequence(F.lit(0).cast("long"), F.lit(sizes[k] - 1).cast("long")) if sizes and sizes[k] else F.array().cast("array<long>")
        # casts stand behind the patterns, and a range that runs backwards is empty
        low, high = F.when(span, ends[0]).cast("long"), F.when(span, ends[1]).cast("long")
        run = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<long>"))
        return F.when(single, F.array(F.when(single, f).cast("long"))).when(span, run).when(f == "*", whole).otherwise(F.array().cast("array<long>"))

    for k, c in enumerate(columns):
        rows = rows.withColumn(c, F.explode(values(k)))
    return rows.select(*columns).distinct()


def read_tuples(spark: SparkSession, path: str, columns: list[str], sizes: list[int] | None = None) -> DataFrame:
    return tuples_from(spark.read.text(path), columns, sizes)


def write_tuples(rows: DataFrame, path: str) -> None:
    """One line a tuple, fields separated by blanks."""
    rows.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns]).alias("value")).write.text(path)


def clauses_from(lines: DataFrame) -> DataFrame:
    """Clause table from lines ``rule: NOT a, NOT b, head``; commas inside brackets do not separate.

    A clause is named by its line; of equal sets of literals the operators' duplicate rule decides.
    """
    parts = F.regexp_extract_all(F.regexp_replace("value", r"^[^:]*:", ""), F.lit(r"(?:NOT\s+)?[A-Za-z_][\w.]*(?:\([^)]*\))?"), F.lit(0))
    rows = lines.where(F.col("value").contains(":")).select(F.trim(F.substring_index("value", ":", 1)).alias("rule"), F.trim("value").alias("clause_id"), F.transform(parts, F.trim).alias("p"))
    rows = rows.select("clause_id", "rule", F.filter("p", lambda x: ~x.startswith("NOT ")).alias("h"), F.filter("p", lambda x: x.startswith("NOT ")).alias("b")).where(F.size("h") == 1)
    return rows.select("clause_id", "rule", F.col("h")[0].alias("head"), F.explode_outer(F.transform("b", lambda x: F.trim(F.substring(x, 5, 1 << 30)))).alias("lit")).distinct()


def read_clauses(spark: SparkSession, path: str) -> DataFrame:
    return clauses_from(spark.read.text(path))


def write_clauses(clauses: DataFrame, path: str) -> None:
    negated = F.transform(F.sort_array(F.collect_set("lit")), lambda x: F.concat(F.lit("NOT "), x))
    rows = clauses.groupBy("clause_id", "rule", "head").agg(negated.alias("b"))
    rows.select(F.concat("rule", F.lit(": "), F.concat_ws(", ", F.concat("b", F.array("head")))).alias("value")).write.text(path)


def observations_from(lines: DataFrame) -> DataFrame:
    """``tuple`` and ``confidence`` from tab-separated lines; a line without a number is skipped."""
    field = lambda k: F.trim(F.split_part("value", F.lit("\t"), F.lit(k)))
    rows = lines.select(field(1).alias("tuple"), field(2).try_cast("double").alias("confidence"))
    return rows.where("confidence is not null and tuple <> ''")


def feedback_from(lines: DataFrame) -> DataFrame:
    """``tuple`` and ``value`` from lines ``O tuple true`` or ``O tuple false``; others are skipped."""
    hit = lambda k: F.regexp_extract("value", r"^O\s+(.+?)\s+(true|false)\s*$", k)
    return lines.select(hit(1).alias("tuple"), hit(2).alias("v")).where("v <> ''").select("tuple", (F.col("v") == "true").alias("value"))


def unordered_pairs(accesses: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs: the lesser first."""
    return accesses.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a is not null and b is not null").distinct()


def whole_runs(log: DataFrame, pid: str, seq: str, done: Column) -> DataFrame:
    """Rows of runs that ended (``done`` on some row) and whose sequence numbers are 1 to n; others are skipped whole."""
    sums = log.groupBy(pid).agg(F.max(done.cast("int")).alias("_d"), F.min(seq).alias("_a"), F.max(seq).alias("_z"), F.count_distinct(F.col(seq)).alias("_n"))
    return log.join(sums.where("_d = 1 and _a = 1 and _z = _n").select(pid), pid, "left_semi")
