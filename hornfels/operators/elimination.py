"""Exact weighted solving by eliminating tuples from tables of costs.

A cost table has the tuples of its scope and a cost for each of their assignments. Tuples that share no table go in one
round: the tables of each are added up, and the least cost over its two values is a table of its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornfels.operators.fixpoint import union_all
from hornfels.storage import keep, materialise, scratch

#: The bit of assignment ``cell`` at each position of ``at``, packed in the order of ``at``.
_PACKED = "aggregate(transform(at, (p, i) -> shiftleft(shiftright(cell, p) & 1, i)), 0, (a, b) -> a + b)"


def _tables(rows: DataFrame, width: int, hard: float) -> DataFrame:
    """``f``, ``scope`` and ``cost`` of each clause; one assignment of its tuples fails it, all others meet it."""
    sides = rows.groupBy("clause_id", "t").agg(F.min("positive").alias("positive"), F.max("positive").alias("other"), F.first(F.coalesce("weight", F.lit(hard))).alias("weight"))
    sides = materialise(sides, "literals")
    always = sides.where("positive <> other").select("clause_id").distinct()
    size = sides.groupBy("clause_id").agg(F.count("*").alias("k"))
    if widest := size.where(F.col("k") > width + 1).orderBy(F.desc("k")).first():
        raise ValueError(f"clause {widest['clause_id']} has {widest['k']} tuples, more than the width {width} and one allow")
    made = sides.join(always, "clause_id", "left_anti").groupBy("clause_id", "weight").agg(F.sort_array(F.collect_list(F.struct("t", "positive"))).alias("l"))
    made = made.withColumn("fails", F.expr("aggregate(transform(l, (x, i) -> if(x.positive, 0, shiftleft(1, i))), 0, (a, b) -> a + b)"))
    cost = F.expr("transform(sequence(0, shiftleft(1, size(l)) - 1), c -> if(c = fails, greatest(weight, 0D), greatest(-weight, 0D)))")
    return made.select(F.monotonically_increasing_id().alias("f"), F.col("l.t").alias("scope"), cost.alias("cost"))


def eliminate(clauses: DataFrame, width: int = 12, hard: float = 1e6, rounds: int = 1000) -> DataFrame:
    """``tuple`` and ``value`` of an assignment of least cost, for every tuple of the clauses; hard ones weigh ``hard``.

    Each round takes tuples of the fewest neighbours (two at least are allowed, so that chains go in a logarithmic number
    of rounds), no two of which are neighbours; a tuple's tables are added up cell by cell in a grouped sum, never gathered. Values
    are read back in the opposite order; of equal costs false wins. A round's tables have ``width`` tuples at most: where
    every tuple left has more neighbours, or a clause is longer, it is an error. Clauses that hold either way say nothing; an
    empty table gives no rows.
    """
    with scratch(clauses.sparkSession):
        rows = clauses.where("tuple is not null and coalesce(weight, 1D) <> 0D")
        names = materialise(rows.select("tuple").distinct().withColumn("t", F.monotonically_increasing_id()), "names")
        tables = materialise(_tables(rows.join(names, "tuple"), width, hard), "tables")
        gone: list[DataFrame] = []
        for k in range(rounds):
            if tables.isEmpty():
                break
            pairs = tables.select(F.explode("scope").alias("t"), "scope").select("t", F.explode("scope").alias("o")).distinct()
            pairs = materialise(pairs, "pairs")  # a tuple is its own neighbour here, so that none is lost
            degree = materialise(pairs.groupBy("t").agg((F.count("*") - 1).alias("n")), "degree")
            least = degree.agg(F.min("n")).first()[0]
            if least > width:
                raise ValueError(f"each of {degree.count()} tuples left has {least} neighbours or more, more than the width {width}")
            able = degree.where(F.col("n") <= max(2, least)).select("t", F.struct("n", F.xxhash64("t", F.lit(k)), "t").alias("rank"))
            beaten = pairs.where("t <> o").join(able, "t").join(able.toDF("o", "before"), "o").where("before < rank").select("t").distinct()
            chosen = able.select("t").join(beaten, "t", "left_anti")
            around = pairs.join(chosen, "t").groupBy("t").agg(F.sort_array(F.collect_list(F.when(F.col("o") != F.col("t"), F.col("o")))).alias("others"))
            around = materialise(around, "around")  # others: width tuples at most
            mine = tables.select("f", F.explode("scope").alias("t")).join(around, "t").join(tables, "f")
            mine = mine.withColumn("at", F.expr("transform(scope, s -> int(if(s = t, 0, array_position(others, s))))"))
            cells = mine.withColumn("cell", F.explode(F.expr("sequence(0, shiftleft(1, size(others) + 1) - 1)")))
            sums = cells.select("t", "cell", F.expr(f"get(cost, {_PACKED})").alias("c")).groupBy("t", "cell").agg(F.sum("c").alias("c"))
            best = sums.groupBy("t", F.expr("shiftright(cell, 1)").alias("rest")).agg(F.min(F.struct("c", F.expr("cell & 1").alias("bit"))).alias("best"))
            made = best.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("rest", "best"))).alias("l"))
            made = made.join(around, "t").select("t", "others", F.col("l.best.c").alias("cost"), F.col("l.best.bit").alias("choice"))
            made = materialise(made, "eliminated")
            gone.append(made)
            used = tables.select("f", F.explode("scope").alias("t")).join(made.select("t"), "t", "left_semi").select("f")
            left = tables.join(used, "f", "left_anti")
            tables = materialise(left.unionByName(made.where("size(others) > 0").select((-F.col("t") - 1).alias("f"), F.col("others").alias("scope"), "cost")), "tables")
        else:
            raise RuntimeError(f"tuples are left after {rounds} rounds")
        known = [materialise(names.select("t", F.lit(0).alias("value")).limit(0), "values")]
        for made in reversed(gone):
            place = made.select("t", F.posexplode("others").alias("p", "o")).join(union_all(known).toDF("o", "value"), "o")
            cell = place.groupBy("t").agg(F.sum(F.expr("shiftleft(value, p)")).cast("int").alias("cell"))
            values = made.join(cell, "t", "left").select("t", F.expr("get(choice, coalesce(cell, 0))").alias("value"))
            known.append(materialise(values, "values"))
        return keep(names.join(union_all(known), "t", "left").select("tuple", (F.coalesce("value", F.lit(0)) == 1).alias("value")), "solved")
