"""Streaming: windowed counts with watermarks, and closures kept up to date by micro-batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hornfels.operators.graph import closure_by_doubling
from hornfels.storage import for_session, materialise, scratch, shared_dir, written_parts


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 day", late: str | None = None) -> DataFrame:
    """Rows of each key and tumbling window; with ``late``, state of windows older than that watermark is dropped."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def run_available(stream: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Appends all that a stream has now to Parquet in the shared folder, and reads it back.

    With ``folder`` it is kept there, and a later call with the same folder goes on where the last one stopped.
    """
    path = folder or f"{shared_dir(stream.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if not folder:
        for_session(stream.sparkSession, path)
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def run_complete(stream: DataFrame, label: str) -> DataFrame:
    """The complete result of a streaming aggregation over all that its source has now."""
    last: list[DataFrame] = []

    def keep(rows: DataFrame, _: int) -> None:
        last[:] = [materialise(rows, label)]

    path = f"{shared_dir(stream.sparkSession)}/{label}-{uuid.uuid4().hex}"
    for_session(stream.sparkSession, path)
    writer = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return last[0] if last else stream.sparkSession.createDataFrame([], stream.schema)


class IncrementalClosure:
    """Transitive closure of a stream of edges: each micro-batch joins its own new paths with the known ones.

    A new path uses new edges: with N the closure of the new edges over the known paths at both ends, only
    pairs through N are derived. Paths are one Parquet part a batch, named by the batch, in ``folder``. A stream that goes
    on from its checkpoint, in this session or another, finds there the paths of all batches before; a batch that runs
    again replaces a part that was not completed and leaves a completed one. Without a folder parts go with the session.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder
        self.parts = written_parts(spark, folder) if folder else {}

    def add(self, edges: DataFrame, batch: int | None = None) -> None:
        name = f"batch-{batch if batch is not None else uuid.uuid4().hex}"
        if name in self.parts:
            return
        if not self.folder:
            self.folder = f"{shared_dir(self.spark)}/paths-{uuid.uuid4().hex}"
            for_session(self.spark, self.folder)
        with scratch(self.spark):
            new = materialise(edges.where("u is not null and v is not null").select("u", "v").distinct(), "new")
            if self.parts:
                known = self.paths()
                ahead = new.join(known.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("u", F.col("w").alias("v"))
                bridged = materialise(closure_by_doubling(new.union(ahead)), "bridged")  # paths that begin with a new edge
                behind = known.select("u", F.col("v").alias("m")).join(bridged.select(F.col("u").alias("m"), "v"), "m").select("u", "v")
                derived = bridged.union(behind).distinct().join(known, ["u", "v"], "left_anti")
            else:
                derived = closure_by_doubling(new)
            path = f"{self.folder}/{name}"
            derived.write.mode("overwrite").parquet(path)
        self.parts[name] = path

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Takes in all that the stream has now; parts lie under its checkpoint, so that both are kept or lost together."""
        folder = f"{checkpoint}/paths"
        if self.parts and self.folder != folder:
            raise ValueError(f"paths are in {self.folder} already, not under the checkpoint {checkpoint}")
        self.folder, self.parts = folder, written_parts(self.spark, folder)
        stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def paths(self) -> DataFrame:
        return self.spark.read.parquet(*self.parts.values())


def misses(log: DataFrame, flag: Column, seen: Column, time: str | None = None, idle_seconds: int = 0) -> DataFrame:
    """pid, src, dst of a stream of log rows, once each: as soon as a run has a row without ``flag`` after one that shows its source.

    ``log`` has pid, seq, src and dst. A run's source keeps the least seq that shows it and, for each dst, the greatest
    seq without flag: so rows may come in any order and in any batches, and the result is that of the whole log. Rows of one seq are
    not after each other; null flags count as neither, null seqs come first. With ``time``, a column, what a run's source keeps is dropped once
    the watermark has passed its last row by ``idle_seconds``, after which it begins anew. State is in the stream's
    checkpoint and goes on after a restart.
    """
    first = -(2**63)
    rows = log.withWatermark(time, f"{idle_seconds} seconds") if time else log
    millis = F.unix_millis(F.col(time)) if time else F.lit(None).cast("long")
    rows = rows.select("pid", "src", "dst", F.coalesce(F.col("seq").cast("long"), F.lit(first)).alias("seq"), F.coalesce(~flag, F.lit(False)).alias("miss"), F.coalesce(seen, F.lit(False)).alias("shown"), *([time] if time else []), millis.alias("_ms"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    state = f"shown bigint, dst array<{kind['dst']}>, seq array<bigint>, told array<boolean>"

    def work(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        shown, dst, seq, told = kept.get if kept.exists else (None, [], [], [])
        last = {d: [s, t] for d, s, t in zip(dst, seq, told, strict=True)}
        at = 0
        for p in frames:
            for s in p.loc[p["shown"], "seq"]:
                shown = int(s) if shown is None else min(shown, int(s))
            for d, s in p.loc[p["miss"]].groupby("dst", dropna=False)["seq"].max().items():
                d = None if pd.isna(d) else d
                now = last.setdefault(d, [int(s), False])
                now[0] = max(now[0], int(s))
            if time and p["_ms"].notna().any():
                at = max(at, int(p["_ms"].max()))
        new = [d for d, (s, t) in last.items() if shown is not None and s > shown and not t]
        for d in new:
            last[d][1] = True
        kept.update((shown, list(last), [s for s, _ in last.values()], [t for _, t in last.values()]))
        if time:
            kept.setTimeoutTimestamp(max(at, kept.getCurrentWatermarkMs()) + 1000 * idle_seconds + 1)
        if new:
            yield pd.DataFrame({"pid": [key[0]] * len(new), "src": [key[1]] * len(new), "dst": new})

    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    out = ", ".join(f"{c} {kind[c]}" for c in ("pid", "src", "dst"))
    return rows.groupBy("pid", "src").applyInPandasWithState(work, out, state, "append", timeout)
