"""Labels of tuples, carried over clauses in both directions until nothing follows.

A clause that must hold says that its head is true where its literals are; clauses that may derive a head say that it is false where
all its clauses fail. So true and false labels go forward to heads, and back to the last literal that can explain a label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornfels.operators.fixpoint import union_all
from hornfels.storage import keep, materialise, scratch


def propagate(clauses: DataFrame, seeds: DataFrame, eager: bool = False, rounds: int = 1000) -> DataFrame:
    """tuple, value, round and conflict for every tuple that a seed labels or that follows.

    ``clauses`` has clause_id, head, lit, must, may and, if there are negated literals, negated; a row a literal, lit null for a
    clause without body; ids are unique. ``seeds`` has tuple and value. Each round applies, to the labels of the rounds before:

    * forward, must: the head of a clause whose literals are all true is true;
    * forward, may: the head of a failed may-clause is false if every clause of it has a false literal;
    * back, may: if one may-clause of a true head can still be true and none is, its literals are true;
    * back, must: the last unknown literal of a must-clause of a false head is false, the others being true
      (``eager``: whatever the others are).

    A tuple that gets both labels in a round has the value null, one that gets the other label later keeps its own; both, and a
    false head of a must-clause that holds or a true head all of whose clauses fail, are conflicts. Conflicts and nulls go no further.
    Each clause counts its unknown and its false literals, and a round looks at clauses of tuples that have just changed only.
    """
    spark = clauses.sparkSession
    rows = clauses if "negated" in clauses.columns else clauses.withColumn("negated", F.lit(False))
    with scratch(spark):
        names = rows.select(F.col("head").alias("tuple")).union(rows.where("lit is not null").select("lit")).union(seeds.select("tuple")).distinct()
        names = materialise(names.withColumn("t", F.monotonically_increasing_id()), "names")
        heads = rows.select("clause_id", "head", "must", "may").distinct()
        heads = heads.join(names.toDF("head", "h"), "head").withColumn("c", F.monotonically_increasing_id())
        heads = materialise(heads.select("clause_id", "c", "h", "must", "may"), "heads")
        body = rows.where("lit is not null").select("clause_id", F.col("lit").alias("tuple"), "negated").distinct().join(names, "tuple")
        body = materialise(body.join(heads.select("clause_id", "c"), "clause_id").select("c", "t", "negated"), "body")
        state = heads.drop("clause_id").join(body.groupBy("c").agg(F.count("*").alias("open")), "c", "left")
        state = materialise(state.withColumns({"open": F.coalesce("open", F.lit(0).cast("long")), "falses": F.lit(0).cast("long")}), "state")

        def told(found: DataFrame, k: int) -> DataFrame:
            both = found.groupBy("t").agg(F.min("value").alias("a"), F.max("value").alias("b"))
            return both.select("t", F.when(F.col("a") == F.col("b"), F.col("a")).alias("value"), F.lit(k).alias("round"), (F.col("a") != F.col("b")).alias("conflict"))

        new = materialise(told(seeds.where("value is not null").join(names, "tuple").select("t", "value"), 0), "labels")
        labels, clashes = [new], []
        # clauses without body hold from the start
        touched = heads.join(body.select("c"), "c", "left_anti").select("h").distinct()
        for k in range(1, rounds):
            sure = new.where("value is not null")
            hits = body.join(sure, "t").groupBy("c").agg(F.count("*").alias("n"), F.sum((F.col("value") == F.col("negated")).cast("long")).alias("f"))
            zero = F.lit(0)
            state = state.join(hits, "c", "left").select("c", "h", "must", "may", (F.col("open") - F.coalesce("n", zero)).alias("open"), (F.col("falses") + F.coalesce("f", zero)).alias("falses"), F.isnotnull("n").alias("hit"))
            state = materialise(state, "state")
            touched = touched.union(state.where("hit").select("h")).union(new.select(F.col("t").alias("h"))).distinct()
            known = union_all(labels)
            near = state.join(touched, "h", "left_semi").join(known.select(F.col("t").alias("h"), F.col("value").alias("label"), F.lit(True).alias("seen")), "h", "left")
            near = materialise(near, "near")
            holds, fails, undecided = (F.col("open") == 0) & (F.col("falses") == 0), F.col("falses") > 0, (F.col("open") > 0) & (F.col("falses") == 0)
            of = near.groupBy("h").agg(
                F.first("label").alias("label"),
                F.max(F.coalesce("seen", F.lit(False))).alias("seen"),
                F.max(F.col("must") & holds).alias("forced"),
                F.max(F.col("may") & fails).alias("refuted"),
                F.min(fails).alias("all_fail"),
                F.max(F.col("may") & holds).alias("explained"),
                F.min(F.when(F.col("may") & undecided, F.col("c"))).alias("last"),
                F.sum((F.col("may") & undecided).cast("int")).alias("left"),
            )
            of = materialise(of, "of")
            forward = of.where("not seen and (forced or (refuted and all_fail))").select(F.col("h").alias("t"), F.col("forced").alias("value"))
            back = of.where("label and not explained and left = 1").select(F.col("last").alias("c"), F.lit(True).alias("value"))
            one_left = F.col("must") & (F.col("open") == 1) & (F.lit(eager) | (F.col("falses") == 0))
            back = back.union(near.where(~F.col("label") & one_left).select("c", F.lit(False)))
            unknown = body.join(back, "c").join(known.select("t"), "t", "left_anti")
            found = forward.union(unknown.select("t", (F.col("value") != F.col("negated")).alias("value")))
            clash = of.where("(not label and forced) or (label and all_fail)").select(F.col("h").alias("t"))
            clashes.append(materialise(clash, "clashes"))
            new = materialise(told(found, k), "labels")
            if new.isEmpty():
                wrong = union_all(clashes).distinct().withColumn("wrong", F.lit(True))
                out = union_all(labels).join(wrong, "t", "left").join(names, "t")
                return keep(out.select("tuple", "value", "round", (F.col("conflict") | F.coalesce("wrong", F.lit(False))).alias("conflict")), "labels")
            labels.append(new)
            touched = heads.select("h").limit(0)
    raise RuntimeError(f"labels did not settle in {rounds} rounds")
