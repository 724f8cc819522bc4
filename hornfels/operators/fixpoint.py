"""Least fixpoints of positive rules, by semi-naive rounds whose results are written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornfels.storage import keep, materialise, scratch

#: Parts after which the rows known so far are written as one.
PARTS = 64


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def fixpoint(base: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], rounds: int = 1000) -> DataFrame:
    """Distinct rows of ``base`` and all that ``step(new, all)`` derives, round by round.

    ``step`` sees the rows that the last round added and all rows so far. What it returns is deduplicated and
    written first, so that its size is known: while that is below Spark's broadcast threshold the known rows are
    probed where they lie, and not shuffled again in every round. A round's new rows are one Parquet part, so plans
    stay short and a lost executor repeats one round at most; what a round writes besides goes with it.
    """
    new = materialise(base.distinct(), "round")
    parts = [new]
    for _ in range(rounds):
        if new.isEmpty():
            return union_all(parts)
        known = union_all(parts)
        with scratch(base.sparkSession):
            derived = materialise(step(new, known).select(base.columns).distinct(), "derived")
            old = known.join(derived, base.columns, "left_semi")
            new = keep(derived.join(old, base.columns, "left_anti"), "round")
        parts.append(new)
        if len(parts) > PARTS:
            parts = [materialise(union_all(parts), "rounds")]
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def together(bases: dict[str, DataFrame], step: Callable[[dict[str, DataFrame], dict[str, DataFrame]], dict[str, list[DataFrame]]], rounds: int = 1000) -> dict[str, DataFrame]:
    """Least fixpoint of relations of different columns that derive each other, each with new rows of its own.

    ``bases`` has the first rows of every relation (empty ones too, for their columns). ``step`` sees each relation's rows
    that the last round added and all its rows so far, and returns the parts that it derives, by relation; a rule over two
    growing relations joins the new rows of one with all of the other, and the other way round. Rounds are written as in
    ``fixpoint``.
    """
    spark = next(iter(bases.values())).sparkSession
    new = {k: materialise(b.distinct(), "round") for k, b in bases.items()}
    parts = {k: [b] for k, b in new.items()}
    done = {k: b.isEmpty() for k, b in new.items()}
    empty = dict(done)
    for _ in range(rounds):
        if all(done.values()):
            return {k: union_all(p) for k, p in parts.items()}
        new = {k: n.where(F.lit(False)) if done[k] else n for k, n in new.items()}  # joins with nothing are then not even planned
        known = {k: union_all(p) for k, p in parts.items()}
        with scratch(spark):
            found = {}
            for k, made in step(new, known).items():
                columns = bases[k].columns
                rows = union_all([m.select(columns) for m in made]).distinct()
                if empty[k]:
                    found[k] = keep(rows, "round")  # all are new
                    continue
                derived = materialise(rows, "derived")
                if not derived.isEmpty():
                    old = known[k].join(derived, columns, "left_semi")
                    found[k] = keep(derived.join(old, columns, "left_anti"), "round")
        new = {k: found.get(k, b) for k, b in new.items()}
        done = {k: k not in found or found[k].isEmpty() for k in new}
        for k, rows in found.items():
            if done[k]:
                continue
            parts[k].append(rows)
            empty[k] = False
            if len(parts[k]) > PARTS // 4:  # several relations meet in one plan
                parts[k] = [materialise(union_all(parts[k]), "rounds")]
    raise RuntimeError(f"no fixpoint after {rounds} rounds")
