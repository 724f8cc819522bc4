"""Proportional stratified interleaving: every shard gets the corpus's mixture of sources.

Rows of a source are put in a seeded random order; the row of rank r among n has the fractional rank
(2r - 1) / 2n. Sorting all rows by it interleaves the sources in proportion, so each of the equal cuts of
that order matches the mixture to within a row a source. Ranks come from two prefix sums over hash
buckets and over slices of the fractional rank, which are even whatever the size of a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hornfels.llm.common import bucket_bases, free_names, hash_bucket, key_of, n_buckets, read_table

SHARDS, SEED = 16, 17


def interleaved(rows: DataFrame, stratum: str, order: list[str], seed: int = SEED, name: str = "position") -> DataFrame:
    """Adds ``name``: the place of each row, from 0 without gaps, in the interleaved order.

    ``order`` names the columns that the seeded shuffle hashes; they also break ties. Rows that are equal in
    all of them are interchangeable. Null strata form a stratum; an empty table gives an empty result.
    Existing columns are kept, whatever their names, but for ones that begin with ``_il_``; the new one has an
    underscore more where its name is taken.
    """
    total = rows.count()
    buckets = n_buckets(total)
    h = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in order])
    rows = rows.withColumns({"_il_key": key_of(f"`{stratum}`"), "_il_hash": h}).withColumn("_il_bucket", hash_bucket(F.col("_il_hash"), buckets))
    sums = rows.groupBy("_il_key", "_il_bucket").agg(F.count("*").alias("_il_n"))
    sizes = sums.groupBy("_il_key").agg(F.sum("_il_n").alias("_il_size"))
    bases = bucket_bases(sums, ["_il_key"], "_il_bucket", "_il_n", buckets).withColumnRenamed("base", "_il_base").join(sizes, "_il_key")
    within = Window.partitionBy("_il_key", "_il_bucket").orderBy("_il_hash", *[f"`{c}`" for c in order])
    ranked = rows.withColumn("_il_rank", F.row_number().over(within)).join(bases, ["_il_key", "_il_bucket"])
    ranked = ranked.withColumn("_il_rank", F.col("_il_rank") + F.col("_il_base"))
    ranked = ranked.withColumn("_il_part", (2 * F.col("_il_rank") - 1) / (2 * F.col("_il_size")))
    ranked = ranked.drop("_il_base", "_il_hash", "_il_bucket").withColumn("_il_slice", F.floor(F.col("_il_part") * buckets).cast("long"))
    slices = bucket_bases(ranked.groupBy("_il_slice").agg(F.count("*").alias("_il_n")), [], "_il_slice", "_il_n", buckets).withColumnRenamed("base", "_il_base")
    place = Window.partitionBy("_il_slice").orderBy("_il_part", "_il_key", "_il_rank")
    ranked = ranked.withColumn("_il_place", F.row_number().over(place)).join(slices, "_il_slice")
    own = [c for c in ranked.columns if not c.startswith("_il_")]
    return ranked.select(*[F.col(f"`{c}`") for c in own], (F.col("_il_place") + F.col("_il_base") - 1).alias(*free_names(own, name)))


def shard(rows: DataFrame, stratum: str = "source", order: tuple[str, ...] = ("doc_id",), shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0 without gaps in each shard).

    Counts of shards differ by one at most. The method keeps no copies together: a group can exceed a shard.
    Columns of ``rows`` stay as they are; a new one whose name is taken has underscores behind it.
    """
    total = rows.count()
    placed = interleaved(rows, stratum, list(order), seed)
    at = placed.columns[-1]
    shard_name, slot_name = free_names(rows.columns, "shard", "slot")
    k = F.expr(f"(`{at}` * {shards}) div {max(1, total)}")
    first = F.expr(f"((`{at}` * {shards}) div {max(1, total)} * {total}L + {shards - 1}) div {shards}")
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], k.cast("int").alias(shard_name), (F.col(f"`{at}`") - first).cast("long").alias(slot_name))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order; a shard is written by one task."""
    sharded.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    out = shard(docs, "source", ("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
