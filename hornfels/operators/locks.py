"""Checks on traces of locks: what is held when, in which order locks are taken, variables that no lock guards.

``log`` has thread, seq (an event's number, unique in its thread), lock and ``acquired`` (true, or false for a release). A lock may
be taken again by its holder and is free after as many releases; a release of a lock that is not held does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Events of a thread that are compared with each other; what is held for longer is in several such chunks.
CHUNK = 64
OPEN = 2**62


def _events(log: DataFrame) -> DataFrame:
    return log.where("lock is not null and acquired is not null and seq is not null").select("thread", "lock", "seq", F.when(F.col("acquired"), 1).otherwise(-1).alias("step"))


def _spells(rows: DataFrame, *more: str) -> DataFrame:
    by = Window.partitionBy("thread", "lock").orderBy("seq")
    rows = rows.withColumn("s", F.sum("step").over(by))
    rows = rows.withColumn("depth", F.col("s") - F.least(F.lit(0), F.min("s").over(by)))
    rows = rows.withColumn("before", F.lag("depth", 1, 0).over(by)).where("before + depth = 1")
    ends = [F.lead(c).over(by).alias(f"{c}_until") for c in more]
    rows = rows.select("*", F.coalesce(F.lead("seq").over(by), F.lit(OPEN)).alias("until"), *ends).where("depth = 1")
    return rows.select("thread", "lock", F.col("seq").alias("since"), "until", *more, *[f"{c}_until" for c in more])


def spells(log: DataFrame) -> DataFrame:
    """thread, lock, ``since`` and ``until``: from the first acquisition to the release that frees it, OPEN if there is none."""
    return _spells(_events(log))


def held(log: DataFrame, points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``points`` (thread, seq and more), one for each lock that their thread holds then, as ``held``.

    Spells are cut at every ``chunk`` events of their own thread, however far apart the numbers of these are, so that the
    join has equal keys, a point meets the spells of its chunk only, and the pieces grow with the events; a lock counts
    as held after its acquisition and before its release.
    """
    by = Window.partitionBy("thread").orderBy("seq")
    events = _events(log)
    part = F.floor(F.sum("one").over(by) / chunk)  # of equal numbers, all are counted
    placed = events.withColumn("one", F.lit(1)).withColumn("part", part).drop("one")
    last = events.groupBy("thread").agg(F.floor(F.count("*") / chunk).alias("last"))
    some = _spells(placed, "part").join(last, "thread")
    some = some.withColumn("part", F.explode(F.sequence(F.col("part"), F.coalesce("part_until", "last"))))
    some = some.select("thread", "part", F.col("lock").alias("held"), "since", "until")
    row = F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("row")
    both = points.where("seq is not null").select("thread", "seq", F.lit(0).alias("one"), row)
    both = both.unionByName(events.select("thread", "seq", F.lit(1).alias("one"), F.lit(None).cast(both.schema["row"].dataType).alias("row")))
    at = both.withColumn("part", part).where("one = 0").select("thread", "seq", "part", "row")
    found = at.join(some, ["thread", "part"]).where("since < seq and seq < until")
    return found.select(*[F.col("row")[c].alias(c) for c in points.columns], "held")


def lock_order(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``u``, ``v`` and in how many threads lock v was taken while u was held; its cycles are possible deadlocks."""
    taken = spells(log).select("thread", F.col("since").alias("seq"), F.col("lock").alias("v"))
    pairs = held(log, taken, chunk).select("thread", F.col("held").alias("u"), "v").distinct()
    return pairs.groupBy("u", "v").agg(F.count("*").alias("threads"))


def deadlocks(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``a`` < ``b``: some thread takes b under a, another one a under b, and no third lock is held at both times.

    Threads that take locks under the same locks are one row, so that pairs are formed of different sets only.
    """
    taken = spells(log).select("thread", F.col("since").alias("seq"), F.col("lock").alias("v"))
    sets = held(log, taken, chunk).groupBy("thread", "seq", "v").agg(F.sort_array(F.collect_set("held")).alias("under"))
    each = sets.select("thread", "v", F.explode("under").alias("u"), "under").withColumn("guards", F.array_remove("under", F.col("u")))
    kinds = each.groupBy("u", "v", "guards").agg(F.min("thread").alias("low"), F.max("thread").alias("high"))
    one = kinds.where("u < v").select(F.col("u").alias("a"), F.col("v").alias("b"), "guards", "low", "high")
    two = kinds.where("u > v").select(F.col("v").alias("a"), F.col("u").alias("b"), F.col("guards").alias("guards_"), F.col("low").alias("low_"), F.col("high").alias("high_"))
    apart = ~((F.col("low") == F.col("high")) & (F.col("low_") == F.col("high_")) & (F.col("low") == F.col("low_")))
    return one.join(two, ["a", "b"]).where(apart & ~F.arrays_overlap("guards", "guards_")).select("a", "b").distinct()


def unguarded(log: DataFrame, accesses: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``var`` and ``threads`` of variables that several threads access, one writes and no single lock guards at every access.

    ``accesses`` has thread, seq, var and ``writes``; accesses under a lock are counted, not gathered.
    """
    all_of = accesses.groupBy("var").agg(F.count("*").alias("n"), F.max("writes").alias("written"), F.count_distinct("thread").alias("threads"))
    under = held(log, accesses, chunk).groupBy("var", "held").agg(F.count("*").alias("k"))
    safe = all_of.join(under, "var").where("k = n").select("var")
    return all_of.where("written and threads > 1").join(safe, "var", "left_anti").select("var", "threads")
