"""Streams that stop and go on: what they keep is what the whole input gives."""

import random

import pytest
from pyspark.sql import functions as F

from hornfels.operators import evidence
from hornfels.operators import graph as G
from hornfels.streaming import derive

LOG = "pid long, seq long, src string, dst string, value long"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_closure_goes_on_after_a_restart(spark, tmp_path):
    rng = random.Random(5)
    links = [(rng.randrange(12), rng.randrange(12)) for _ in range(18)]
    folder, state = str(tmp_path / "e"), str(tmp_path / "state")
    frame = lambda rows: spark.createDataFrame(rows, "u long, v long")
    stream = spark.readStream.schema("u long, v long").option("maxFilesPerTrigger", 1)
    frame(links[:9]).coalesce(1).write.parquet(folder)
    derive.IncrementalClosure(spark).follow(stream.parquet(folder), state)
    frame(links[9:]).coalesce(1).write.mode("append").parquet(folder)
    again = derive.IncrementalClosure(spark)  # knows nothing of the first but the checkpoint
    again.follow(stream.parquet(folder), state)
    assert rows_of(again.paths()) == rows_of(G.closure(frame(links))) and len(again.parts) == 2
    again.add(frame([(90, 91)]), 1)  # a batch that is done is not taken twice
    assert rows_of(derive.IncrementalClosure(spark, f"{state}/paths").paths()) == rows_of(G.closure(frame(links)))
    other = derive.IncrementalClosure(spark)
    other.add(frame([(1, 2), (2, 3), (None, 3)]))
    assert rows_of(other.paths()) == [(1, 2), (1, 3), (2, 3)]
    with pytest.raises(ValueError, match="checkpoint"):
        other.follow(stream.parquet(folder), state)


def test_misses_of_a_stopped_stream_are_those_of_the_whole_log(spark, tmp_path):
    rng = random.Random(8)
    log = [(pid, k, rng.choice("abc"), rng.choice("xyz"), rng.choice([5, 50, 95, None])) for pid in range(4) for k in range(15)]
    log += [(9, 0, "a", None, 5), (9, 1, "a", None, 50)]
    rng.shuffle(log)
    folder = str(tmp_path / "log")
    (tmp_path / "log").mkdir()
    flag, seen = F.col("value") > 90, F.col("value") < 10
    stream = derive.misses(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder), flag, seen)
    whole = spark.createDataFrame(log, LOG)
    for part in (log[:20], log[20:41], log[41:]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(folder)
        got = derive.run_available(stream, "misses", str(tmp_path / "out"))  # stops, and goes on from the checkpoint
    counts = got.groupBy("src", "dst").agg(F.count("*").alias("n"))
    assert sorted(map(str, counts.collect())) == sorted(map(str, evidence.negative_counts(whole, flag, seen).collect()))
    assert got.count() == got.distinct().count() > 5


def test_state_of_idle_runs_is_dropped(spark, tmp_path):
    schema = LOG + ", ts timestamp"
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    folder = str(tmp_path / "log")
    (tmp_path / "log").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stream = derive.misses(stream, F.col("value") > 90, F.col("value") < 10, "ts", 60)
    steps = [([(1, 1, "a", "x", 5), (2, 1, "a", "x", 5)], 0), ([(2, 2, "a", "y", 50), (3, 1, "b", "x", 50)], 30), ([(3, 2, "b", "x", 50)], 4000), ([(3, 3, "b", "x", 50)], 4001), ([(1, 2, "a", "x", 50)], 4002)]
    for rows, s in steps:
        spark.createDataFrame(rows, LOG).withColumn("ts", at(s)).coalesce(1).write.mode("append").parquet(folder)
        got = derive.run_available(stream, "misses", str(tmp_path / "out"))
    assert rows_of(got) == [(2, "a", "y")]  # run 1 was silent for too long: its source is not known any more
