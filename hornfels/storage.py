"""Tables written to the folder that driver and executors share, to cut lineage durably."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local one only where none is set and the master is local, as in tests."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="hornfels-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


#: Paths that the loops running now in this thread have written, the innermost last.
_LOOPS: ContextVar[tuple[list[str], ...]] = ContextVar("loops", default=())


#: Shuffle files of a table that has been written are of no use: Spark deletes them at the end of the write.
_FREE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def for_session(spark: SparkSession, path: str) -> None:
    """Has ``path`` deleted when the session ends, or with the loop that runs now."""
    target, files = _path(spark, path)
    files.deleteOnExit(target)
    if loops := _LOOPS.get():
        loops[-1].append(path)


def written_parts(spark: SparkSession, folder: str) -> dict[str, str]:
    """Name and path of each folder in ``folder`` whose writing was completed; none if there is no such folder."""
    target, files = _path(spark, folder)
    if not files.exists(target):
        return {}
    found = [s.getPath() for s in files.listStatus(target)]
    return {p.getName(): p.toString() for p in found if files.exists(_path(spark, f"{p.toString()}/_SUCCESS")[0])}


def materialise(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    Unlike a cache the copy outlives a lost executor; it goes when the session ends, or with its loop (see scratch).
    ``by`` names columns of few values, each of which gets a folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _settings(spark, _FREE):
        df.write.parquet(path, partitionBy=list(by) or None)
    for_session(spark, path)
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns]) if by else spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialised inside is deleted at the end; write the result outside, or by ``keep``, before that."""
    written: list[str] = []
    token = _LOOPS.set((*_LOOPS.get(), written))
    try:
        yield
    finally:
        _LOOPS.reset(token)
        for p in written:
            target, files = _path(spark, p)
            files.delete(target, True)


def keep(df: DataFrame, label: str) -> DataFrame:
    """``materialise``, for a result that outlives the innermost ``scratch`` around it."""
    token = _LOOPS.set(_LOOPS.get()[:-1])
    try:
        return materialise(df, label)
    finally:
        _LOOPS.reset(token)
