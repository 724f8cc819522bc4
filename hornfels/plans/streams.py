"""Streaming queries over the events table, as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornfels.plans.measures import NEG, TRACE, trace
from hornfels.plans.registry import query, table
from hornfels.storage import materialise
from hornfels.streaming import derive


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts by type, from the table read as a stream of files."""
    folder, name = sf, "events.parquet"
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", name).parquet(folder)
    return derive.run_complete(derive.windowed_counts(stream, "ts", "event_type"), "daily")


@query(f"WITH {TRACE}, {NEG} SELECT src, dst, n FROM g")
def stream_neg_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The negative edges of the traces, whose rows come as a stream of files, in no order, two at a time; state a run and source."""
    log = materialise(trace(spark, sf).repartition(4), "trace")
    folder = log.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    found = derive.run_available(derive.misses(stream, F.col("value") > 90, F.col("value") < 10), "misses")
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))
