"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornfels.storage import keep, materialise, scratch


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge at most and none that leads to it has one: then all are stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("own"), F.lit(0).alias("end")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("own").alias("own"), F.max("end").alias("end"))
    return nodes.where("own > 1 or own > 0 and end > 0").isEmpty()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (its component's least node) for every node of ``links`` (columns ``u`` and ``v``).

    The number of rounds grows with the logarithm of the longest path; every round is written to the shared
    folder, so that plans stay short and a lost executor costs one round. A node's neighbours meet in an
    aggregate with partial sums and in a join that Spark may split, never in one task's memory. Loops of a
    node with itself, repeated links and an empty table are allowed; nulls are not nodes.
    """
    known = links.where("u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    known = materialise(known.distinct(), "links")
    with scratch(links.sparkSession):
        edges = keep(_stars(known.where("u <> v"), rounds), "stars")
    nodes = known.select(F.col("u").alias("node")).union(known.select("v")).distinct()
    return nodes.join(edges.toDF("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _stars(edges: DataFrame, rounds: int) -> DataFrame:
    """The edges turned into stars about the least node of each component."""
    for _ in range(rounds):
        if _settled(edges):
            return edges
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = materialise(linked.where("u <> v").distinct(), "links")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
