"""The Bayes network of a clause table, its factors, and inference with labels and soft evidence.

A clause is an AND node over the derived literals of its body; a tuple with several clauses is an OR node over
them, one with a single clause is that clause's node. Inputs are true and no nodes, but for those with soft
evidence: such a tuple is an input node with a prior, and an observer node beside it agrees with it by a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornfels.operators.clauses import heads
from hornfels.operators.inference import belief_propagation
from hornfels.storage import materialise

#: Fixed value: the prior of an input with soft evidence.
PRIOR = 0.2


def network(clauses: DataFrame, soft: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes(node, kind, rule), arcs(node, parent) and names(tuple, node).

    Kinds are ``*`` (clause), ``+`` (tuple of several clauses), ``i`` (input with evidence) and ``^`` (its observer).
    ``soft`` has a column tuple; a derived tuple in it keeps its clauses and is observed only. Clauses must have
    no cycle (see clauses.forward).
    """
    own = materialise(heads(clauses), "heads")
    count = own.groupBy("head").agg(F.count("*").alias("n"), F.min("clause_id").alias("c"))
    names = count.select(F.col("head").alias("tuple"), F.when(F.col("n") == 1, F.col("c")).otherwise(F.col("head")).alias("node"))
    wide = count.where("n > 1").select("head")
    nodes = own.select(F.col("clause_id").alias("node"), F.lit("*").alias("kind"), "rule")
    nodes = nodes.union(wide.select("head", F.lit("+"), F.lit(None).cast("string")))
    arcs = own.join(wide, "head", "left_semi").select(F.col("head").alias("node"), F.col("clause_id").alias("parent"))
    if soft is not None:
        seen = soft.select("tuple").distinct()
        fresh = seen.join(names, "tuple", "left_anti")
        names = names.union(fresh.select("tuple", "tuple"))
        nodes = nodes.union(fresh.select("tuple", F.lit("i"), F.lit(None).cast("string")))
        nodes = nodes.union(seen.select(F.concat("tuple", F.lit("_t")), F.lit("^"), F.lit(None).cast("string")))
    names = materialise(names, "names")
    body = clauses.where("lit is not null").select(F.col("clause_id").alias("node"), F.col("lit").alias("tuple")).distinct()
    arcs = arcs.union(body.join(names.withColumnRenamed("node", "parent"), "tuple").select("node", "parent"))
    if soft is not None:
        arcs = arcs.union(seen.join(names, "tuple").select(F.concat("tuple", F.lit("_t")).alias("node"), F.col("node").alias("parent")))
    return materialise(nodes, "nodes"), materialise(arcs.distinct(), "arcs"), names


def factors(nodes: DataFrame, arcs: DataFrame, p: Column, agreement: DataFrame | None = None, prior: float = PRIOR, leak: float = 0.0, most: int = 16) -> DataFrame:
    """Entries (factor, entry, value, var, state) of every node's table given its parents, as belief_propagation takes them.

    ``p`` is a clause's probability over ``rule``; agreement(tuple, agreement) is the observers'. A node whose
    parents are not as it needs is true with ``leak``. A table has two to the power of the parents: a node with
    more than ``most`` is an error (see clauses.narrow).
    """
    too_wide = arcs.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > most).limit(1).collect()
    if too_wide:
        raise ValueError(f"{too_wide[0]['node']} has more than {most} parents")
    parents = arcs.groupBy("node").agg(F.sort_array(F.collect_list("parent")).alias("parents"))
    wide = nodes.join(parents, "node", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
    wide = wide.withColumn("rate", F.when(F.col("kind") == "*", p))
    if agreement is not None:
        wide = wide.join(agreement.select(F.concat("tuple", F.lit("_t")).alias("node"), "agreement"), "node", "left")
    else:
        wide = wide.withColumn("agreement", F.lit(None).cast("double"))
    k = F.size("parents")
    rows = wide.withColumn("entry", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2), k + 1) - 1).cast("int"))))
    on, above = F.col("entry").bitwiseAND(F.lit(1)) == 1, F.expr("shiftright(entry, 1)")
    every = above == (F.pow(F.lit(2), k) - 1).cast("int")
    true = F.when(F.col("kind") == "*", F.when(every, F.col("rate")).otherwise(leak)).when(F.col("kind") == "+", F.when(above != 0, F.lit(1.0)).otherwise(leak))
    true = true.when(F.col("kind") == "i", prior).otherwise(F.when(above != 0, F.col("agreement")).otherwise(1 - F.col("agreement")))
    rows = rows.withColumn("value", F.when(on, true).otherwise(1 - true))
    vars_ = F.concat(F.array("node"), "parents")
    each = rows.select(F.col("node").alias("factor"), F.col("entry").cast("string").alias("entry"), "value", F.posexplode(vars_).alias("at", "var"), F.col("entry").alias("bits"))
    return each.select("factor", "entry", "value", "var", F.expr("cast(shiftright(bits, at) & 1 as int)").alias("state"))


def clamped_entries(entries: DataFrame, known: DataFrame) -> DataFrame:
    """``entries`` with those that contradict ``known`` (var, value) at zero."""
    said = known.select("var", F.col("value").cast("int").alias("_v"))
    bad = entries.join(said, "var").where("state <> _v").select("factor", "entry").distinct().withColumn("_bad", F.lit(True))
    return entries.join(bad, ["factor", "entry"], "left").withColumn("value", F.when(F.col("_bad"), 0.0).otherwise(F.col("value"))).drop("_bad")


def marginals(clauses: DataFrame, p: Column, labels: DataFrame | None = None, agreement: DataFrame | None = None, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """``tuple`` and ``p``: the probability of each derived or softly observed tuple, given labels and observers.

    labels(tuple, value) are certain; each tuple of agreement(tuple, agreement) is observed to be true. Evidence acts
    forwards and backwards. Exact where the network is a tree.
    """
    nodes, arcs, names = network(clauses, agreement)
    entries = factors(nodes, arcs, p, agreement)
    known = None
    if agreement is not None:
        known = agreement.select(F.concat("tuple", F.lit("_t")).alias("var"), F.lit(True).alias("value"))
    if labels is not None:
        own = labels.join(names, "tuple").select(F.col("node").alias("var"), "value")
        known = own if known is None else known.union(own)
    if known is not None:
        entries = clamped_entries(entries, known)
    beliefs = belief_propagation(entries, rounds=rounds, tolerance=tolerance).where("state = 1")
    return names.join(beliefs, names["node"] == beliefs["var"]).select("tuple", "p")


def rankings(clauses: DataFrame, p: Column, alarms: DataFrame, agreement: DataFrame, labels: DataFrame) -> DataFrame:
    """``tuple`` of ``alarms`` with its probability by rules alone (prior), with soft evidence (soft), and with all labels (oracle).

    All three are over the same network, so what is softly observed has its prior in the first and third as well.
    """
    open_ = agreement.select("tuple", F.lit(0.5).alias("agreement"))  # an observer that says nothing
    out = alarms.select("tuple").distinct()
    for name, soft, hard in (("prior", open_, None), ("soft", agreement, None), ("oracle", open_, labels)):
        out = out.join(marginals(clauses, p, hard, soft).withColumnRenamed("p", name), "tuple", "left")
    return out


def fit_rules_hidden(clauses: DataFrame, labels: DataFrame, start: float = 0.5, rounds: int = 50, tolerance: float = 1e-4) -> dict[str, float]:
    """Rules' probabilities by expectation maximisation where most tuples are not observed: labels(tuple, value) are.

    The expectation is one belief propagation over the network: a clause's expected firings over its expected chances,
    summed by rule; a row a rule reaches the driver.
    """
    nodes, arcs, names = network(clauses)
    known = materialise(labels.join(names, "tuple").select(F.col("node").alias("var"), "value"), "labels")
    parents = arcs.join(nodes.where("kind = '*'").select("node"), "node", "left_semi")
    now = {r["rule"]: start for r in nodes.where("kind = '*'").select("rule").distinct().collect()}
    for _ in range(rounds):
        table = F.create_map(*[F.lit(x) for kv in now.items() for x in kv])
        belief = materialise(belief_propagation(clamped_entries(factors(nodes, arcs, table[F.col("rule")]), known), rounds=100).where("state = 1").select("var", "p"), "beliefs")
        able = parents.join(belief.withColumnRenamed("var", "parent"), "parent").groupBy("node").agg(F.product("p").alias("able"))
        fired = nodes.where("kind = '*'").join(belief.withColumnRenamed("var", "node"), "node").join(able, "node", "left")
        chance = F.greatest(F.coalesce("able", F.lit(1.0)), F.col("p"))
        sums = fired.groupBy("rule").agg((F.sum("p") / F.sum(chance)).alias("p")).collect()
        new = {r["rule"]: min(max(r["p"], 1e-6), 0.999) for r in sums}
        moved = max((abs(new[k] - now[k]) for k in new), default=0.0)
        now = now | new
        if moved <= tolerance:
            return now
    raise RuntimeError(f"not settled in {rounds} rounds; the last move was {moved}")
