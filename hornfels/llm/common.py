"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: a word is a run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one bucket of a prefix sum holds on average, and buckets summed in one window.
BUCKET_ROWS, FANOUT = 2048, 4096


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_of(column: str) -> Column:
    """A key that is never null: null gets a value that no string has."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column).cast("string")), F.lit("n"))


def n_buckets(rows: int) -> int:
    """A power of two, in proportion to the rows."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS)))


def hash_bucket(h: Column, buckets: int) -> Column:
    """The leading bits of a 64-bit hash, so that buckets follow the hash's unsigned order."""
    bits = buckets.bit_length() - 1
    return F.shiftrightunsigned(h, 64 - bits).cast("long") if bits else F.lit(0).cast("long")


def bucket_bases(sums: DataFrame, keys: list[str], bucket: str, amount: str, buckets: int) -> DataFrame:
    """For each (keys, bucket) of ``sums``: ``base``, the amounts of the key's lower buckets.

    Buckets beyond FANOUT are summed level by level, so no window holds more than FANOUT rows of a key.
    """
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    if buckets <= FANOUT:
        return sums.select(*keys, bucket, F.coalesce(F.sum(amount).over(w), F.lit(0)).cast("long").alias("base"))
    up = f"{bucket}_up"
    fine = sums.withColumn(up, F.floor(F.col(bucket) / FANOUT).cast("long"))
    coarse = fine.groupBy(*keys, up).agg(F.sum(amount).alias(amount))
    coarse = bucket_bases(coarse, keys, up, amount, -(-buckets // FANOUT)).withColumnRenamed("base", "_above")
    inner = Window.partitionBy(*keys, up).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(amount).over(inner), F.lit(0))
    return fine.withColumn("_own", own).join(coarse, [*keys, up]).select(*keys, bucket, (F.col("_own") + F.col("_above")).cast("long").alias("base"))


def crc_of_id(column: Column) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Fewer rows an Arrow batch for what is run inside: a Python worker holds a batch of whole texts several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """``names`` for new columns: each with underscores behind it until it is none of ``taken``, whatever the case."""
    known, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in known:
            n += "_"
        known.add(n.lower())
        out.append(n)
    return out


def stashed(keep: Iterable[str]) -> list[Column]:
    """The columns to ``keep`` under names that an operator's own do not clash with."""
    return [F.col(f"`{k}`").alias(f"_keep{i}") for i, k in enumerate(keep)]


def restored(rows: DataFrame, keep: tuple[str, ...], *outputs: str) -> DataFrame:
    """The stashed columns under their own names, and ``outputs``, renamed by ``free_names`` where they clash."""
    own = [F.col(f"_keep{i}").alias(k) for i, k in enumerate(keep)]
    return rows.select(*own, *[F.col(o).alias(n) for o, n in zip(outputs, free_names(keep, *outputs), strict=True)])


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def platt(z: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic curve through counted scores, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * z + b)
        w = n * p * (1 - p) + 1e-9
        g = np.array([((p - y) * n * z).sum() + 1e-3 * a, ((p - y) * n).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
    return float(a), float(b)
