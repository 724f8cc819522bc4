"""Probabilistic inference over clause tables and factor graphs, as rounds of joins and grouped products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornfels.operators.clauses import parted, relation_of
from hornfels.operators.fixpoint import union_all
from hornfels.storage import materialise


def and_or(clauses: DataFrame, dob: DataFrame, p: Column, evidence: DataFrame | None = None) -> DataFrame:
    """``tuple`` and ``p`` of derived tuples: a clause holds with probability ``p`` (over ``rule``) if its body does.

    Bodies are conjunctions, heads disjunctions, antecedents are taken as independent: exact on trees. Inputs
    are true, or have the ``prior`` of ``evidence`` (tuple, prior). One round for each birth date; clauses over inputs only
    are read in the first, and not written. ``dob`` is as from ``births``.
    """
    born = dob.where("dob > 0")
    levels = [r["dob"] for r in born.select("dob").distinct().orderBy("dob").collect()]  # as many as rounds
    parts = []
    if evidence is not None:
        known = evidence.join(dob.where("dob = 0"), "tuple", "left_semi").select("tuple", F.coalesce("prior", F.lit(1.0)).alias("p"))
        parts = [materialise(known, "marginal")]
    given = len(parts)
    linked, plain, _ = parted(clauses, born)
    made = materialise(linked.select(relation_of("head").alias("name")).distinct(), "relations")
    when = born.join(made, relation_of("tuple") == F.col("name"), "left_semi").select(F.col("tuple").alias("head"), "dob")
    body = linked.join(materialise(when, "when"), "head").select("clause_id", "rule", "head", F.col("lit").alias("tuple"), "dob")
    # a head that is born later, as labels on its antecedents make it, has all its clauses in that round
    late = born.where("dob > 1").select(F.col("tuple").alias("head"), "dob")
    body = body.union(plain.join(late, "head").select("clause_id", "rule", "head", F.col("lit").alias("tuple"), "dob"))
    plain = plain.join(late, "head", "left_anti")
    body = materialise(body, "body", "dob")  # a folder a birth date, so that a round reads its own
    for k in levels:
        rows = body.where(F.col("dob") == k).drop("dob")
        if k == 1:  # clauses over inputs only
            rows = rows.union(plain.select("clause_id", "rule", "head", F.col("lit").alias("tuple")))
        if parts:
            held = rows.join(union_all(parts), "tuple", "left").groupBy("clause_id", "rule", "head").agg(F.product(F.coalesce("p", F.lit(1.0))).alias("q"))
        else:
            held = rows.select("clause_id", "rule", "head").distinct().withColumn("q", F.lit(1.0))
        some = held.groupBy("head").agg((1 - F.product(1 - p * F.col("q"))).alias("p"))
        parts.append(materialise(some.select(F.col("head").alias("tuple"), "p"), "marginal"))
    return union_all(parts[given:]) if levels else dob.select("tuple", F.lit(1.0).alias("p")).limit(0)


def soft_posterior(prior: Column, agreement: Column) -> Column:
    """Posterior of a tuple whose observer says true, by the table [p, 1-p, 1-p, p]."""
    yes = prior * agreement
    return yes / (yes + (1 - prior) * (1 - agreement))


def noisy_or(p: Column) -> Column:
    """Aggregate: probability that one of the grouped causes holds."""
    return 1 - F.product(1 - p)


def _tables(edges: DataFrame, domain: DataFrame) -> DataFrame:
    """A row a factor: ``slots``, its (var, state) in order, the entries' ``values``, and ``picks``, each entry's slots, filled up with -1."""
    slots = domain.groupBy("factor").agg(F.sort_array(F.collect_set(F.struct("var", "state"))).alias("slots"))
    at = slots.select("factor", F.posexplode("slots").alias("at", "s")).select("factor", "at", "s.var", "s.state")
    each = edges.join(at, ["factor", "var", "state"]).groupBy("factor", "entry").agg(F.first("value").alias("value"), F.collect_list("at").alias("picks"))
    most = F.max(F.size("picks"))
    rows = each.groupBy("factor").agg(F.collect_list(F.struct("value", "picks")).alias("rows"), most.alias("most"))
    full = lambda x: F.concat(x["picks"], F.array_repeat(F.lit(-1), F.col("most") - F.size(x["picks"])))
    filled = F.flatten(F.transform("rows", full))
    return rows.join(slots, "factor").select("factor", "slots", F.transform("rows", lambda x: x["value"]).alias("values"), filled.alias("picks"))


def _sent(values: pd.Series, picks: pd.Series, messages: pd.Series, maximum: bool) -> pd.Series:
    """For each factor what it sends to its slots: sums (or maxima) over entries of value times the other slots' messages."""
    out = []
    for v, p, m in zip(values, picks, messages, strict=True):
        at = np.asarray(p).reshape(len(v), -1)
        known = np.append(np.maximum(np.asarray(m, float), 1e-300), 1.0)[at]  # -1 is the last one
        ones = np.ones((len(v), 1))
        before = np.cumprod(np.hstack([ones, known[:, :-1]]), axis=1)
        behind = np.cumprod(np.hstack([ones, known[:, :0:-1]]), axis=1)[:, ::-1]
        x = np.asarray(v, float)[:, None] * before * behind
        sums = np.zeros(len(m) + 1)
        (np.maximum if maximum else np.add).at(sums, at.ravel() % (len(m) + 1), x.ravel())
        out.append(sums[:-1])
    return pd.Series(out)


def belief_propagation(entries: DataFrame, rounds: int = 60, tolerance: float = 1e-6, damping: float = 0.0, maximum: bool = False, strict: bool = True) -> DataFrame:
    """Marginals (var, state, p) of a factor graph by loopy sum-product, or max-product, in parallel rounds.

    ``entries`` has a row for each factor entry and variable: factor, entry, value, var, state. They are gathered once into
    a row a factor; messages are tables of a row a factor, variable and state. A round joins the two, multiplies within the
    factor's row and sums logarithms by variable, normalised for each edge. Variables without
    evidence need no row of their own. Stops once no message moved by more than ``tolerance``; if that takes more
    than ``rounds`` it is an error, unless ``strict`` is off, which gives the last beliefs as they are.
    """
    edges = materialise(entries.select("factor", "entry", "value", "var", "state"), "factors")
    domain = edges.select("factor", "var", "state").distinct()
    size = domain.groupBy("factor", "var").agg(F.count("*").alias("k"))
    messages = materialise(domain.join(size, ["factor", "var"]).select("factor", "var", "state", (1 / F.col("k")).alias("m")), "messages")  # from variables
    tables = materialise(_tables(edges, domain), "tables")
    up = messages
    for _ in range(rounds):
        slots = F.transform(F.sort_array(F.collect_list(F.struct("var", "state", "m"))), lambda x: x["m"])
        held = tables.join(messages.groupBy("factor").agg(slots.alias("m")), "factor")
        sent = F.pandas_udf(lambda v, t, m: _sent(v, t, m, maximum), "array<double>")
        up = held.select("factor", F.explode(F.arrays_zip("slots", sent("values", "picks", "m").alias("m"))).alias("x"))
        up = materialise(up.select("factor", "x.slots.var", "x.slots.state", "x.m"), "sent")
        norm = up.groupBy("factor", "var").agg(F.sum("m").alias("z"))
        up = materialise(up.join(norm, ["factor", "var"]).select("factor", "var", "state", (F.col("m") / F.col("z")).alias("m")), "messages")
        total = up.groupBy("var", "state").agg(F.sum(F.log(F.greatest("m", F.lit(1e-300)))).alias("l"))
        back = up.join(total, ["var", "state"]).withColumn("x", F.exp(F.col("l") - F.log(F.greatest("m", F.lit(1e-300)))))
        scale = back.groupBy("factor", "var").agg(F.sum("x").alias("z"))
        new = back.join(scale, ["factor", "var"]).select("factor", "var", "state", (F.col("x") / F.col("z")).alias("n"))
        both = new.join(messages, ["factor", "var", "state"]).select("factor", "var", "state", (F.col("n") * (1 - damping) + F.col("m") * damping).alias("m"), F.abs(F.col("n") - F.col("m")).alias("d"))
        both = materialise(both, "messages")
        moved = both.agg(F.max("d")).first()[0] or 0.0
        messages = both.drop("d")
        if moved <= tolerance:
            break
    else:
        if strict:
            raise RuntimeError(f"messages still moved by {moved} after {rounds} rounds")
    belief = up.groupBy("var", "state").agg(F.exp(F.sum(F.log(F.greatest("m", F.lit(1e-300))))).alias("b"))
    z = belief.groupBy("var").agg(F.sum("b").alias("z"))
    return belief.join(z, "var").select("var", "state", (F.col("b") / F.col("z")).alias("p"))


def clamped(clauses: DataFrame, dob: DataFrame, p: Column, labels: DataFrame) -> DataFrame:
    """``and_or`` once ``labels`` (tuple, value) are known: what false ones falsify is 0, true ones are 1.

    Labels act forward only; what they say about their own causes is for belief_propagation.
    """
    from hornfels.operators.clauses import push_false

    gone = push_false(clauses, labels).select("tuple", F.lit(0.0).alias("prior"))
    true = labels.where("value").select("tuple", F.lit(1.0).alias("prior"))
    known = materialise(gone.unionByName(true.join(gone, "tuple", "left_anti")), "labels")
    # a labelled tuple is like an input: its own clauses no longer speak
    open_ = clauses.join(known.select(F.col("tuple").alias("head")), "head", "left_anti")
    fixed = dob.join(known, "tuple", "left").select("tuple", F.when(F.col("prior").isNotNull(), 0).otherwise(F.col("dob")).alias("dob"))
    out = and_or(open_, fixed, p, known)
    return out.unionByName(known.join(dob.where("dob > 0").select("tuple"), "tuple", "left_semi").select("tuple", F.col("prior").alias("p")))


def carousel(clauses: DataFrame, dob: DataFrame, p: Column, alarms: DataFrame, steps: int) -> DataFrame:
    """Asks for the likeliest unlabelled alarm, ``steps`` times, ranking anew after each answer.

    ``alarms`` has ``tuple`` and ``truth``, the answers. Returns step, tuple, p and truth; a step reads one row.
    """
    spark = clauses.sparkSession
    asked: list[tuple] = []
    for step in range(steps):
        labels = spark.createDataFrame([(t, v) for _, t, _, v in asked], "tuple string, value boolean")
        scores = clamped(clauses, dob, p, labels)
        best = alarms.join(scores, "tuple").join(labels, "tuple", "left_anti").orderBy(F.desc("p"), "tuple").first()
        if best is None:
            break
        asked.append((step, best["tuple"], best["p"], best["truth"]))
    return spark.createDataFrame(asked, "step int, tuple string, p double, truth boolean")


def fit_rules(clauses: DataFrame, true: DataFrame, start: float = 0.5, most: float = 0.999, rounds: int = 200, tolerance: float = 1e-6) -> dict[str, float]:
    """Rules' probabilities by expectation maximisation, from the true tuples of a complete observation.

    A clause can fire only if its body is true; a true head was fired by some of its clauses (a head without
    any that can fire says nothing), a false one by none. One aggregation for each round; a row a rule
    reaches the driver. Probabilities that do not settle are an error.
    """
    known = true.select("tuple", F.lit(1).alias("t")).distinct()
    lits = clauses.join(known.withColumnRenamed("tuple", "lit"), "lit", "left")
    able = lits.groupBy("clause_id", "rule", "head").agg(F.min(F.when(F.col("lit").isNull(), 1).otherwise(F.coalesce("t", F.lit(0)))).alias("on")).where("on = 1")
    able = materialise(able.join(known.withColumnRenamed("tuple", "head"), "head", "left").select("clause_id", "rule", "head", F.coalesce("t", F.lit(0)).alias("t")), "fires")
    now = {r["rule"]: start for r in able.select("rule").distinct().collect()}
    for _ in range(rounds):
        table = F.create_map(*[F.lit(x) for kv in now.items() for x in kv])
        rows = able.withColumn("p", table[F.col("rule")])
        any_ = rows.groupBy("head").agg((1 - F.product(1 - F.col("p"))).alias("any"))
        share = F.when(F.col("t") == 1, F.col("p") / F.greatest("any", F.lit(1e-12))).otherwise(0.0)
        sums = rows.join(any_, "head").groupBy("rule").agg(F.avg(share).alias("p")).collect()
        new = {r["rule"]: min(r["p"], most) for r in sums}
        moved = max((abs(new[k] - now[k]) for k in new), default=0.0)
        now = new
        if moved <= tolerance:
            return now
    raise RuntimeError(f"probabilities did not settle in {rounds} rounds")
