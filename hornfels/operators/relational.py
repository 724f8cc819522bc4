"""Horn-rule bodies as joins of DataFrames: an atom names a relation's columns by variables, a body joins atoms on equal names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hornfels.storage import materialise

#: A term of an atom: a variable's name, a constant, or None where any value will do.
Term = str | int | None


def atom(relation: DataFrame, *terms: Term) -> DataFrame:
    """The relation's rows with its columns, by position, named by ``terms``; a repeated name is an equality."""
    if len(terms) != len(relation.columns):
        raise ValueError(f"{len(terms)} terms for {len(relation.columns)} columns")
    columns: dict[str, Column] = {}
    rows = relation
    for name, term in zip(relation.columns, terms, strict=True):
        value = F.col(f"`{name}`")
        if isinstance(term, str):
            if term in columns:
                rows = rows.where(columns[term] == value)
            else:
                columns[term] = value
        elif term is not None:
            rows = rows.where(value == F.lit(term))
    return rows.select(*[c.alias(v) for v, c in columns.items()])


def body(*atoms: DataFrame) -> DataFrame:
    """Natural join in the given order; each atom must share a variable with those before it."""

    def step(left: DataFrame, right: DataFrame) -> DataFrame:
        shared = [c for c in left.columns if c in right.columns]
        if not shared:
            raise ValueError(f"no variable links {left.columns} and {right.columns}")
        return left.join(right, shared)

    return reduce(step, atoms)


def without(rows: DataFrame, negated: DataFrame) -> DataFrame:
    """Stratified negation: rows for which ``negated`` has none with the same shared variables."""
    return rows.join(negated, [c for c in rows.columns if c in negated.columns], "left_anti")


def having(rows: DataFrame, related: DataFrame) -> DataFrame:
    """Rows for which ``related`` has one: an existential atom, without multiplying rows."""
    return rows.join(related, [c for c in rows.columns if c in related.columns], "left_semi")


def head(rows: DataFrame, **terms: Term) -> DataFrame:
    """Distinct tuples; each keyword names a column and gives its variable or constant."""
    return rows.select(*[(F.col(t) if isinstance(t, str) else F.lit(t).cast("long")).alias(c) for c, t in terms.items()]).distinct()


def fellows(relation: DataFrame, block: int = 1500) -> DataFrame:
    """``x`` and ``y``: different ids of ``relation`` (two columns, an id and its group) that share a group, each pair once.

    The result is quadratic in the groups by definition, so a group's ids are cut into blocks of about ``block`` and a task
    sees pairs of blocks, not groups. A pair of which one id has a single group is met once; only pairs of ids with several
    groups are compared with each other, so no table of all pairs is kept anywhere.
    """
    rows = relation.toDF("id", "g").where("id is not null and g is not null").distinct()
    single = rows.groupBy("id").agg(F.count("*").alias("k")).select("id", (F.col("k") == 1).alias("single"))
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    tagged = materialise(rows.join(single, "id").join(sizes, "g").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "groups")
    tasks = tagged.select("g", "blocks").distinct().agg(F.sum(F.col("blocks").cast("long") * F.col("blocks"))).first()[0] or 1
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = tagged.select("g", F.col("b").alias("p"), other.alias("q"), F.col("id").alias("x"), F.col("single").alias("sx"))
    right = tagged.select("g", F.col("b").alias("q"), other.alias("p"), F.col("id").alias("y"), F.col("single").alias("sy"))
    met = left.repartition(min(tasks, 10_000), "g", "p", "q").join(right, ["g", "p", "q"]).where("x <> y")
    several = met.where("not sx and not sy").select("x", "y").distinct()
    return met.where("sx or sy").select("x", "y").union(several)


def universe(**domains: DataFrame) -> DataFrame:
    """All tuples over one-column domains. The result is the product by definition; domains must be small."""
    named = [d.toDF(name).distinct() for name, d in domains.items()]
    return reduce(lambda a, b: a.join(b), named)


def complement(relation: DataFrame, **domains: DataFrame) -> DataFrame:
    """Tuples over the domains that the relation, whose columns bear their names, lacks."""
    return universe(**domains).join(relation.select(*domains), list(domains), "left_anti")


def domain_index(values: DataFrame) -> DataFrame:
    """``value`` and its ``id`` from 0 by order: a dense dictionary. Ids come from range partitions' sizes, not one window."""
    column = values.columns[0]
    distinct = values.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    placed = materialise(distinct.repartitionByRange("value").withColumn("_part", F.spark_partition_id()), "domain")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("value")))
    return ranked.join(before, "_part").select("value", (F.col("_base") + F.col("_rank") - 1).cast("long").alias("id"))


def same_values(values: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs (a, b) of dictionaries' ids that stand for the same value."""
    return values.select("value", F.col("id").alias("a")).join(other.select("value", F.col("id").alias("b")), "value").select("a", "b")


def equivalence(**sizes: int) -> list[tuple[str, int, int]]:
    """(domain, size, offset) of domains packed into one, in the given order: each begins ``size + 1`` after the last."""
    out, at = [], 0
    for name, size in sizes.items():
        out.append((name, size, at))
        at += size + 1
    return out


def packed(spark: SparkSession, **sizes: int) -> DataFrame:
    """The relation (domain, id, packed) between each domain's ids and those of the domain that holds them all."""
    parts = [spark.range(size).select(F.lit(name).alias("domain"), "id", (F.col("id") + offset).alias("packed")) for name, size, offset in equivalence(**sizes)]
    return reduce(DataFrame.unionByName, parts)


def matching(patterns: DataFrame, relation: DataFrame, *columns: str) -> DataFrame:
    """The columns of ``patterns`` but ``columns``, and those of ``relation``, for each tuple that a pattern matches; null in a pattern matches all.

    Patterns are told apart by which columns they bind, at most 2 to the number of ``columns`` kinds; a kind is one equi join on its bound
    columns. Only patterns that bind none are joined with all tuples, which is their meaning. Nulls of ``relation`` match unbound columns only.
    """
    others = [c for c in patterns.columns if c not in columns]
    mask = reduce(lambda a, b: a + b, [F.isnotnull(c).cast("int") * (1 << k) for k, c in enumerate(columns)])
    kinds = sorted(r[0] for r in patterns.select(mask.alias("mask")).distinct().collect())
    parts = []
    for kind in kinds:
        bound = [c for k, c in enumerate(columns) if kind >> k & 1]
        own = patterns.where(mask == kind).select(*others, *[F.col(c).alias(f"_{c}") for c in bound])
        on = [own[f"_{c}"] == relation[c] for c in bound]
        parts.append(own.join(relation, on or F.lit(True)).select(*others, *relation.columns))
    return reduce(DataFrame.unionByName, parts) if parts else patterns.where(F.lit(False)).select(*others).join(relation).select(*others, *relation.columns)
