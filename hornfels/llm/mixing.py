"""Mixing sources to target weights by pivotal dependent rounding.

A source's target share gives each of its documents a fractional number of copies. The whole part is taken
at once; the fraction is rounded by pivotal steps: two fractional documents trade words until one of them is
taken or left out, at random and without bias, so the words of a pair never change. Documents meet within a
source and a class of like sizes, in hashed buckets; each bucket leaves a few fractional documents at most.
Residuals of the buckets meet level by level in a reduction tree, then those of a source's size classes:
there the largest is settled first and the others together take up the difference, so that a source misses
its words by about its smallest residual.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hornfels.llm.common import WORD, key_of, read_table, restored, stashed
from hornfels.storage import materialise

#: Fixed values of the mix: weights by the sources' order, repeating, and times a source may be repeated.
WEIGHTS, MAX_TIMES, SEED = (1, 2, 3), 3, 23
#: Documents a bucket holds on average, buckets whose residuals meet in a step of the tree, and residuals a step leaves at least.
BUCKET_ROWS, FAN_IN, LEFT = 4096, 256, 8
#: A share this close to a whole number counts as whole.
EPS = 1e-9


def allot(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_TIMES, rounds: int = 64) -> DataFrame:
    """Adds ``target`` to source_key, source and source_size: shares by weight, capped at ``most`` times the size.

    What lies above a cap is shared again by weight among the others, until none is above. A source without
    words has the target 0. The table has a row a source; each round is two sums over it.
    """
    order = Window.orderBy("source_key")
    table = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    table = materialise(table, "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    cap = most * F.col("source_size")
    level = 0.0  # words a unit of weight; it only rises
    for _ in range(rounds):
        bound = F.lit(level) * F.col("weight") >= cap
        r = table.agg(F.sum(F.when(bound, cap)).alias("held"), F.sum(F.when(~bound, F.col("weight"))).alias("open")).first()
        now = (total - (r["held"] or 0)) / r["open"] if r["open"] else level
        if now <= level:
            break
        level = now
    else:
        raise RuntimeError(f"the caps did not settle in {rounds} rounds")
    return table.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h.astype(np.uint64) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivot(size: np.ndarray, share: np.ndarray, draw: np.ndarray, left: int = LEFT) -> np.ndarray:
    """Rounds shares in turn and returns them, all whole but for ``left`` + 1 at most.

    Two fractional rows trade words: either the first gains and the second loses, or the other way round, each
    as far as it goes, with the odds that keep every expectation.
    """
    x = np.where((share > EPS) & (share < 1 - EPS), share, np.round(share)).astype(float)
    open_ = np.flatnonzero((x > EPS) & (x < 1 - EPS))
    at = -1
    for j in open_[: max(0, len(open_) - left)]:
        if at < 0:
            at = j
            continue
        a, b = size[at], size[j]
        up = min((1 - x[at]) * a, x[j] * b)  # words the first can gain
        down = min(x[at] * a, (1 - x[j]) * b)
        move = up if draw[j] * (up + down) < down else -down
        x[at], x[j] = x[at] + move / a, x[j] - move / b
        done = [not EPS < x[k] < 1 - EPS for k in (at, j)]
        x[at], x[j] = (round(x[k]) if d else x[k] for k, d in zip((at, j), done, strict=True))
        at = (-1 if all(done) else j) if done[0] else at
    return x


def settle(size: np.ndarray, share: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Rounds all shares, largest size first; the smaller ones together take up what each rounding moves.

    Where they can take up one way only, that way is gone: a document as long as all of its source's
    fractions together would else throw the source off its target.
    """
    x = share.astype(float).copy()
    order = np.argsort(-size, kind="stable")
    for k, i in enumerate(order):
        if not EPS < x[i] < 1 - EPS:
            x[i] = round(x[i])
            continue
        rest = order[k + 1 :]
        rest = rest[(x[rest] > EPS) & (x[rest] < 1 - EPS)]
        if len(rest) == 0:
            x[i] = float(draw[i] < x[i])
            continue
        gives, takes = (size[rest] * x[rest]).sum(), (size[rest] * (1 - x[rest])).sum()
        fits = (size[i] * (1 - x[i]) <= gives, size[i] * x[i] <= takes)
        up = draw[i] < x[i] if fits[0] == fits[1] else fits[0]
        words = size[i] * (1 - x[i] if up else x[i])
        room = size[rest] * (x[rest] if up else 1 - x[rest])
        x[i] = float(up)
        part = min(1.0, words / room.sum())
        x[rest] += (-1 if up else 1) * part * room / size[rest]
    return x


_TREE = "row long, source_key string, class int, node long, size long, share double, draw long, residual boolean"


def _reduce(rows: DataFrame) -> DataFrame:
    """One level: the rows of a (source, class, node) are rounded; the last fractional ones stay residual."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["draw", "size", "row"], kind="stable").reset_index(drop=True)
        x = pivot(part["size"].to_numpy(float), part["share"].to_numpy(), _unit(part["draw"].to_numpy()))
        part["share"], part["residual"] = x, (x > EPS) & (x < 1 - EPS)
        return part

    key = ["source_key", "class", "node"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work: not to be coalesced
    return rows.repartition(tasks, *key).groupBy(*key).applyInPandas(work, _TREE)


def rounded(rows: DataFrame, buckets: int) -> DataFrame:
    """``row`` and its whole ``share`` for all of ``rows`` (row, source_key, size, share, draw, bits), sizes above 0.

    A source's documents are dealt over 2^bits buckets, ``buckets`` at most.
    """
    node = F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(draw, 64 - bits)")).otherwise(F.lit(0))
    level = rows.select("row", "source_key", F.floor(F.log2("size")).cast("int").alias("class"), node.cast("long").alias("node"), "size", "share", "draw", F.lit(True).alias("residual"))
    done, width = [], buckets
    while True:
        level = materialise(_reduce(level), "pivot")
        done.append(level.where("not residual").select("row", "share"))
        level = level.where("residual").withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long"))
        if width <= 1:
            break
        width = -(-width // FAN_IN)

    def last(part: pd.DataFrame) -> pd.DataFrame:  # a few rows for each size class
        part = part.sort_values(["size", "row"], ascending=False, kind="stable").reset_index(drop=True)
        return pd.DataFrame({"row": part["row"], "share": settle(part["size"].to_numpy(float), part["share"].to_numpy(), _unit(part["draw"].to_numpy()))})

    done.append(level.groupBy("source_key").applyInPandas(last, "row long, share double"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, *keep: str, source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, most: float = MAX_TIMES, seed: int = SEED) -> DataFrame:
    """The ``keep`` columns with size (words), source_size, target and copies, for each row of ``docs``.

    The targets share the words of all sources (sorted by code point, null last) by ``weights``. Equal rows
    have the same hash and are interchangeable; reruns agree. Rows without words (null, empty) get 0 copies.
    A new column has underscores behind its name where ``keep`` has it; an empty table gives an empty result.
    """
    words = F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    ident = F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in keep], F.coalesce(F.col(text), F.lit("")), F.col(source))
    rows = docs.select(*stashed(keep), key_of(source).alias("source_key"), words.alias("size"), ident.alias("draw"))
    rows = materialise(rows, "sizes")
    sizes = rows.groupBy("source_key").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("source_rows"))
    # 's...' sorts by code point; 'n' stands for null and must come last
    targets = allot(sizes.withColumn("source_key", F.regexp_replace("source_key", "^n$", "t")), weights, most).withColumn("source_key", F.regexp_replace("source_key", "^t$", "n"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.join(targets.select("source_key", "source_size", "target", "source_rows", share.alias("times")), "source_key")
    twins = Window.partitionBy("draw").orderBy(*[f"_keep{i}" for i in range(len(keep))], "size")
    rows = rows.withColumn("_twin", F.row_number().over(twins)).withColumn("row", F.xxhash64("draw", "_twin"))
    whole = F.floor(F.col("times") + EPS)
    rows = materialise(rows.withColumn("whole", whole.cast("int")).withColumn("share", F.greatest(F.col("times") - whole, F.lit(0.0))), "shares")
    bits = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("source_rows") / BUCKET_ROWS)))
    open_ = rows.where((F.col("size") > 0) & (F.col("share") > EPS)).select("row", "source_key", "size", "share", F.xxhash64("row", F.lit(seed)).alias("draw"), bits.cast("int").alias("bits"))
    buckets = 1 << (open_.agg(F.max("bits")).first()[0] or 0)
    extra = rounded(open_, buckets).withColumnRenamed("share", "extra")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce(F.round("extra").cast("int"), F.lit(0))).otherwise(0)
    return restored(rows.join(extra, "row", "left").withColumn("copies", copies), keep, "size", "source_size", "target", "copies")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
