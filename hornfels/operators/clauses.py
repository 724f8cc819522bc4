"""Operators on clause tables (see provenance): birth dates, pruning, rewriting, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornfels.operators.components import components
from hornfels.operators.fixpoint import fixpoint, union_all
from hornfels.storage import keep, materialise, scratch


def heads(clauses: DataFrame) -> DataFrame:
    return clauses.select("clause_id", "rule", "head").distinct()


def inputs(clauses: DataFrame) -> DataFrame:
    """``tuple``s that no clause derives."""
    lits = clauses.where("lit is not null").select(F.col("lit").alias("tuple")).distinct()
    return lits.join(clauses.select(F.col("head").alias("tuple")).distinct(), "tuple", "left_anti")


def relation_of(t: str) -> Column:
    """The name before a written tuple's terms."""
    return F.substring_index(t, "(", 1)


def _kinds(clauses: DataFrame) -> DataFrame:
    """``rule``, and the relations of heads (``name``) and literals (``lit``), each once, in one pass over the clauses."""
    return keep(clauses.select("rule", relation_of("head").alias("name"), relation_of("lit").alias("lit")).distinct(), "kinds")


def _by_rules(clauses: DataFrame, rules: DataFrame, few: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Clauses of the ``rules`` (column r), and all others. Where rules are few their names are in the plan, so that the text of the others' clauses is not even made."""
    some = [r["r"] for r in rules.limit(few + 1).collect()]
    if len(some) > few:
        same = clauses["rule"].eqNullSafe(rules["r"])
        return clauses.join(rules, same, "left_semi"), clauses.join(rules, same, "left_anti")
    hit = F.coalesce(F.col("rule").isin([r for r in some if r is not None]), F.lit(False))
    hit = hit | F.isnull("rule") if None in some else hit
    return clauses.where(hit), clauses.where(~hit)


def parted(clauses: DataFrame, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clauses of rules with a literal of a derived relation, all others, and the derived relations (column ``name``).

    A relation is derived if a head is in it, or a tuple of ``more``. Literals of the other clauses are inputs all of them,
    whatever their number, so rounds need not see them. A clause has one rule and one head. Relations and rules are few;
    where tuples bear no relation's name all is right, but each tuple is a relation.
    """
    kinds = _kinds(clauses)
    made = kinds.select("name").distinct()
    names = made if more is None else made.union(more.select(relation_of("tuple")).distinct()).distinct()
    names = keep(names, "relations")
    used = kinds.where("lit is not null").select("rule", F.col("lit").alias("name"))
    rules = keep(used.join(names, "name", "left_semi").select(F.col("rule").alias("r")).distinct(), "rules")
    return *_by_rules(clauses, rules), names


def _of_relations(lits: DataFrame, names: DataFrame, how: str) -> DataFrame:
    return lits.withColumn("name", relation_of("lit")).join(names, "name", how).drop("name")


def _numbered(linked: DataFrame, names: DataFrame, first: DataFrame, also: DataFrame | None = None, second: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the clauses ``linked``: t, tuple, whether a head and whether one of ``first``, or of ``second`` where that is given; c and each t of its body that is derived or in ``also``; c, its head h and how many those are."""
    rows = linked.join(names, relation_of("lit") == F.col("name"), "left").withColumn("seen", F.isnotnull("name"))
    if also is not None:
        rows = rows.join(also.select(F.col("tuple").alias("a")), F.col("lit") == F.col("a"), "left").withColumn("seen", F.col("seen") | F.isnotnull("a"))
    rows = rows.groupBy("clause_id", "head").agg(F.collect_set(F.when(F.col("seen"), F.col("lit"))).alias("lits"))
    wide = materialise(rows.select(F.monotonically_increasing_id().alias("c"), "head", "lits"), "wide")
    body = wide.select("c", F.explode("lits").alias("tuple"))
    flagged = lambda d, made, one: d.withColumn("derived", F.lit(made)).withColumn("first", F.lit(one))
    all_ = flagged(body.select("tuple"), False, False).union(flagged(wide.select("head"), True, False)).union(flagged(first.select("tuple"), True, True))
    all_ = all_.withColumn("second", F.lit(False))
    if second is not None:
        all_ = all_.union(flagged(second.select("tuple"), True, False).withColumn("second", F.lit(True)))
    tuples = all_.groupBy("tuple").agg(*[F.max(c).alias(c) for c in ("derived", "first", "second")])
    tuples = materialise(tuples.withColumn("t", F.monotonically_increasing_id()), "names")
    number = tuples.select("tuple", "t")
    body = materialise(body.join(number, "tuple").select("c", "t"), "body")
    waiting = wide.select("c", F.col("head").alias("tuple"), F.size("lits").alias("need")).join(number, "tuple").select("c", F.col("t").alias("h"), "need")
    return tuples, body, materialise(waiting, "waiting")


def _born(tuples: DataFrame, body: DataFrame, waiting: DataFrame, rounds: int) -> DataFrame:
    """``t`` and ``dob`` of all tuples that can be derived: 0 for those that are no heads, 1 for the first ones."""
    born = [materialise(tuples.where("not derived").select("t", F.lit(0).alias("dob")), "born")]
    for k in range(1, rounds):
        hits = body.join(born[-1].select("t"), "t").groupBy("c").agg(F.count("*").alias("n"))
        left = waiting.join(hits, "c", "left").select("c", "h", (F.col("need") - F.coalesce("n", F.lit(0))).alias("need"))
        left = materialise(left, "waiting")
        new = left.where("need <= 0").select(F.col("h").alias("t"))
        if k == 1:
            new = new.union(tuples.where("first").select("t"))
        if k == 2 and "second" in tuples.columns:
            new = new.union(tuples.where("second").select("t").join(born[-1].select("t"), "t", "left_anti"))
        new = materialise(new.distinct().withColumn("dob", F.lit(k)), "born")
        if new.isEmpty() and k > 1:
            return union_all(born)
        born.append(new)
        waiting = left.join(new.select(F.col("t").alias("h")), "h", "left_anti").select("c", "h", "need")
    raise RuntimeError(f"births not settled in {rounds} rounds")


def _settled(linked: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the clauses ``linked`` those of rules with a literal of a relation that some linked rule derives, all others, and the
    relations that the former's literals or any linked heads are in (column ``name``).

    The others' literals are inputs, or heads of clauses over inputs only, which are all born in round 1.
    """
    kinds = _kinds(linked)
    heads_ = kinds.select("name").distinct()
    used = kinds.where("lit is not null").select("rule", F.col("lit").alias("name")).distinct().join(names, "name", "left_semi")
    rules = keep(used.join(heads_, "name", "left_semi").select(F.col("rule").alias("r")).distinct(), "rules")
    seen = used.join(rules, used["rule"].eqNullSafe(rules["r"]), "left_semi").select("name").union(heads_)
    return *_by_rules(linked, rules), keep(seen.distinct(), "seen")


def births(clauses: DataFrame, rounds: int = 1000) -> DataFrame:
    """``tuple`` and ``dob``: 0 for inputs, else the least over its clauses of 1 + the latest antecedent.

    Clauses whose literals are all of relations that no head is in bear their heads in round 1, and those literals are
    inputs. Clauses over such heads and inputs only bear theirs in round 2, once and for all. Only what the other rules link is
    numbered, once, and the rounds run on numbers. A clause waits for as many
    antecedents of derived relations as its body has; a round takes off those that the last one bore, and clauses that
    wait for none bear their heads. Clauses whose head is born leave the table, so a round's work follows the new tuples
    and the clauses that still wait. A clause without body bears its head in round 1; a tuple that cannot be derived has
    no row. Rows of dob 0 are made when they are read, all others are written.
    """
    with scratch(clauses.sparkSession):
        linked, plain, names = parted(clauses)
        first = keep(plain.select(F.col("head").alias("tuple")).distinct(), "first")
        deep, near, seen = _settled(linked, names)
        # literals that no clause over inputs bears may be inputs of a derived relation, or heads that cannot be born: their clauses go the long way
        # as do clauses without a derived literal, which are born in round 1
        lits = _of_relations(near.where("lit is not null").select("clause_id", "head", "lit"), names, "left_semi")
        flagged = near.join(names, relation_of("lit") == F.col("name"), "left").groupBy("clause_id", "head").agg(F.max(F.isnotnull("name")).alias("of"))
        unborn = materialise(lits.select("lit").distinct().join(first.select(F.col("tuple").alias("lit")), "lit", "left_anti"), "unborn")
        odd = lits.join(unborn, "lit", "left_semi").select("clause_id", "head").union(flagged.where("not of").select("clause_id", "head"))
        odd = materialise(odd.distinct(), "odd")
        deep = deep.union(near.join(odd, ["clause_id", "head"], "left_semi").select(deep.columns))
        second = near.join(odd, ["clause_id", "head"], "left_anti").select(F.col("head").alias("tuple")).distinct()
        second = materialise(second, "second")
        if not odd.isEmpty():
            seen = names
        of = relation_of("tuple") == seen["name"]
        inside = materialise(first.join(seen, of, "left_semi"), "inside")
        tuples, body, waiting = _numbered(deep, names, inside, None, second)
        found = _born(tuples, body, waiting, rounds).join(tuples.select("t", "tuple"), "t").select("tuple", "dob")
        out = keep(found, "born")
        rest = first.join(seen, of, "left_anti").select("tuple", F.lit(1).alias("dob"))
    lits = clauses.where("lit is not null").select("lit")
    given_ = _of_relations(lits, names, "left_anti").select(F.col("lit").alias("tuple")).distinct()
    return out.union(rest).union(given_.select("tuple", F.lit(0).alias("dob")))


def forward(clauses: DataFrame, dob: DataFrame) -> DataFrame:
    """Clauses all of whose antecedents are older than the head; what is left has no cycle.

    ``dob`` is what ``births`` gives for these clauses. Those that have inputs only in their bodies stay as they are. Antecedents
    of a clause over inputs and heads of such clauses are born by round 1, so its head alone tells if that is later.
    """
    born = dob.where("dob > 0")
    linked, plain, names = parted(clauses, born)
    deep, near, seen = _settled(linked, names)
    within = lambda d: d.join(seen, relation_of("tuple") == F.col("name"), "left_semi")
    inside = materialise(within(born), "inside")
    later = inside.where("dob > 1").select(F.col("tuple").alias("head"))
    out = near.join(later, "head", "left_semi").select(clauses.columns).union(plain.select(clauses.columns))
    early = inside.where("dob = 1").select(F.col("tuple").alias("head"))
    low = [] if early.isEmpty() else [(near.join(early, "head", "left_semi"), born)]
    for rows, known in [(deep, inside), *low]:
        when = known.select(F.col("tuple").alias("lit"), F.col("dob").alias("lit_dob"))
        head = inside.select(F.col("tuple").alias("head"), F.col("dob").alias("head_dob"))
        latest = rows.join(when, "lit", "left").groupBy("clause_id", "head").agg(F.max(F.coalesce("lit_dob", F.lit(-1))).alias("latest"))
        kept = latest.join(head, "head").where("latest < head_dob").select("clause_id")
        out = out.union(rows.join(kept, "clause_id", "left_semi").select(clauses.columns))
    return out


def coreachable(clauses: DataFrame, outputs: DataFrame) -> DataFrame:
    """``tuple``s that some derivation of ``outputs`` uses, themselves included."""
    # repeated pairs stay: the rounds' rows are distinct, and a pass over all pairs in each round costs more than they do
    down = clauses.where("lit is not null").select(F.col("head").alias("tuple"), "lit")
    return fixpoint(outputs.select("tuple"), lambda new, _: new.join(down, "tuple").select(F.col("lit").alias("tuple")))


def active(clauses: DataFrame, outputs: DataFrame) -> DataFrame:
    """Clauses whose head is co-reachable."""
    return clauses.join(coreachable(clauses, outputs).select(F.col("tuple").alias("head")), "head", "left_semi")


def derive_inputs(clauses: DataFrame) -> DataFrame:
    """Adds a clause without body for each input, under one fresh rule for each relation."""
    t = F.col("tuple")
    name = F.substring_index(t, "(", 1)
    unit = inputs(clauses).select(F.concat(F.lit("edb["), t, F.lit("]")).alias("clause_id"), F.concat(F.lit("Edb_"), name).alias("rule"), t.alias("head"), F.lit(None).cast("string").alias("lit"))
    return clauses.unionByName(unit)


def elide_inputs(clauses: DataFrame) -> DataFrame:
    """Drops literals that no clause derives; a clause keeps a null literal where none is left."""
    known = clauses.select(F.col("head").alias("lit")).distinct()
    kept = clauses.join(known, "lit", "left_semi").select("clause_id", "rule", "head", "lit")
    empty = heads(clauses).join(kept.select("clause_id").distinct(), "clause_id", "left_anti").withColumn("lit", F.lit(None).cast("string"))
    return kept.unionByName(empty)


def observed(clauses: DataFrame, observations: DataFrame) -> DataFrame:
    """Adds ``Obs(t)`` derived from each observed ``tuple``."""
    t = F.col("tuple")
    more = observations.select(F.concat(F.lit("obs["), t, F.lit("]")).alias("clause_id"), F.concat(F.lit("RObs_"), t).alias("rule"), F.concat(F.lit("Obs("), t, F.lit(")")).alias("head"), t.alias("lit"))
    return clauses.unionByName(more)


def compress_chains(clauses: DataFrame, probability: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merges clauses over tuples with one source and one sink that are no query; ``probability``: clause_id, p.

    Clauses that such tuples link are one: its head is the last one's, its probability the product. Returns
    the clauses and their probabilities. Needs clauses without a cycle (see forward).
    """
    made = heads(clauses).groupBy(F.col("head").alias("tuple")).agg(F.count("*").alias("n"), F.first("clause_id").alias("src"))
    used = clauses.where("lit is not null").select(F.col("lit").alias("tuple"), "clause_id").distinct().groupBy("tuple").agg(F.count("*").alias("m"), F.first("clause_id").alias("dst"))
    gone = materialise(made.join(used, "tuple").where("n = 1 and m = 1").join(queries.select("tuple"), "tuple", "left_anti").select("tuple", "src", "dst"), "chain")
    group = components(gone.select(F.col("src").alias("u"), F.col("dst").alias("v"))).withColumnRenamed("node", "clause_id")
    named = clauses.join(group, "clause_id", "left").withColumn("root", F.coalesce("root", "clause_id"))
    inner = gone.select("tuple")
    last = heads(named.drop("lit").withColumn("lit", F.lit(None))).join(inner.withColumnRenamed("tuple", "head"), "head", "left_anti")
    last = last.join(group, "clause_id", "left").select(F.coalesce("root", "clause_id").alias("root"), "rule", "head")
    lits = named.where("lit is not null").join(inner.withColumnRenamed("tuple", "lit"), "lit", "left_anti").select("root", "lit").distinct()
    out = last.join(lits, "root", "left").select(F.col("root").alias("clause_id"), "rule", "head", "lit")
    p = probability.join(group, "clause_id", "left").groupBy(F.coalesce("root", "clause_id").alias("clause_id")).agg(F.product("p").alias("p"))
    return out, p


def narrow(clauses: DataFrame, width: int = 10, rounds: int = 32) -> DataFrame:
    """Heads with more than ``width`` clauses get a tree of tuples ``D<level>`` under the rule ``Rnarrow``.

    A wide head's clauses are dealt over as many groups as it needs, in order of their number within a partition,
    so no task holds all clauses of a head: groups have ``width`` clauses at most.
    """
    done, now = [], clauses
    for k in range(rounds):
        own = now.select("clause_id", "head")
        wide = materialise(own.distinct().groupBy("head").agg(F.count("*").alias("n")).where(F.col("n") > width), "wide")
        if wide.isEmpty():
            return union_all([*done, now])
        # a head's clauses in buckets of about a thousand; a bucket's clauses are numbered and cut, each on its own
        bucket = F.pmod(F.xxhash64("clause_id"), F.ceil(F.col("n") / 1000).cast("long"))
        split = own.join(wide, "head").distinct().withColumn("b", bucket)
        place = F.row_number().over(Window.partitionBy("head", "b").orderBy("clause_id")) - 1
        split = split.withColumn("g", F.concat_ws("_", "b", F.floor(place / width).cast("string")))
        split = materialise(split.select("clause_id", "head", F.concat(F.lit(f"D{k}<"), "head", F.lit(":"), F.col("g"), F.lit(">")).alias("mid")), "narrow")
        moved = now.join(split.select("clause_id", "mid"), "clause_id", "left")
        done.append(moved.select("clause_id", "rule", F.coalesce("mid", "head").alias("head"), "lit"))
        steps = split.select("mid", "head").distinct().select(F.concat(F.lit("narrow["), "mid", F.lit("]")).alias("clause_id"), F.lit("Rnarrow").alias("rule"), "head", F.col("mid").alias("lit"))
        now = materialise(steps, "narrow")  # no other head is wide any more
    raise RuntimeError("heads are still too wide")


def _gathered(clauses: DataFrame) -> DataFrame:
    """A row a clause, as it is where there are ``lits``."""
    if "lits" in clauses.columns:
        return clauses
    return materialise(clauses.groupBy("clause_id", "rule", "head").agg(F.collect_set("lit").alias("lits")), "wide")


def push_false(clauses: DataFrame, feedback: DataFrame) -> DataFrame:
    """``tuple``s that are false once the false ones of ``feedback`` (tuple, value) are pushed forward.

    A false antecedent falsifies its clause; a head whose clauses are all false is false. ``clauses`` may have a row a clause with
    its literals in the array ``lits`` (see provenance.wide), each clause once. Clauses over inputs only stand or fall with the
    feedback: they are counted by head, once, and only heads that fall or that other clauses have too are written. The rounds see
    the other clauses.
    """
    with scratch(clauses.sparkSession):
        false = [keep(feedback.where("not value").select("tuple").distinct(), "false")]
        wide = _gathered(clauses)
        names = materialise(wide.select(relation_of("head").alias("name")).distinct(), "relations")
        used = wide.select("rule", F.explode("lits").alias("lit")).select("rule", relation_of("lit").alias("name")).distinct()
        rules = materialise(used.join(names, "name", "left_semi").select(F.col("rule").alias("r")).distinct(), "rules")
        same = wide["rule"].eqNullSafe(rules["r"])
        linked = materialise(wide.join(rules, same, "left_semi").select("clause_id", "head", "lits"), "linked")
        own = materialise(linked.groupBy("head").agg(F.count_distinct("clause_id").alias("own")), "own")
        plain = wide.join(rules, same, "left_anti")
        lits = plain.select("clause_id", "head", F.explode("lits").alias("tuple"))
        said = materialise(false[0].select(relation_of("tuple").alias("name")).distinct(), "said")
        hit = lits.join(said, relation_of("tuple") == F.col("name"), "left_semi").join(false[0], "tuple", "left_semi").select("clause_id", "head").distinct()
        one, zero = F.lit(1), F.lit(0)
        count = plain.select("head", one.alias("n"), zero.alias("m")).union(hit.select("head", zero, one)).groupBy("head").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
        count = materialise(count.join(own, "head", "left").where("n = m or own is not null"), "count")
        lost = count.where("own is null").select(F.col("head").alias("tuple"))
        false.append(keep(lost.join(false[0], "tuple", "left_anti"), "false"))
        if own.isEmpty():
            return union_all(false)
        # of heads with linked clauses: how many must fall, those that have fallen already taken off
        total = own.join(count.select("head", (F.col("n") - F.col("m")).alias("open")), "head", "left").select("head", (F.col("own") + F.coalesce("open", zero)).alias("n"))
        total = materialise(total, "total")
        body = materialise(linked.select("clause_id", "head", F.explode("lits").alias("tuple")).distinct(), "body")
        new, dead = union_all(false), None
        while True:
            hit = body.join(new, "tuple").select("clause_id", "head").distinct()
            hit = materialise(hit if dead is None else hit.join(dead, ["clause_id", "head"], "left_anti"), "dead")
            dead = hit if dead is None else dead.union(hit)
            fallen = dead.groupBy("head").agg(F.count("*").alias("m")).join(total, "head").where("m = n").select(F.col("head").alias("tuple"))
            new = keep(fallen.join(union_all(false), "tuple", "left_anti"), "false")
            if new.isEmpty():
                return union_all(false)
            false.append(new)


def consistent_feedback(clauses: DataFrame, feedback: DataFrame) -> DataFrame:
    """Entries of ``feedback`` whose value survives ``push_false``."""
    gone = push_false(clauses, feedback).withColumn("gone", F.lit(True))
    return feedback.join(gone, "tuple", "left").where("value = (gone is null)").select("tuple", "value")


def least_derivation(clauses: DataFrame, roots: DataFrame) -> DataFrame:
    """The derivation of the ``roots`` (column tuple) that is born first: tuple, dob, clause_id, rule and lit, a row a literal.

    Every tuple has one clause, of those whose antecedents are all born before the tuple's own birth the one of the least id; a tuple that several
    others use is there once, so the tree is a graph without cycles and no larger than the clauses. Inputs have nulls; roots that cannot
    be derived are left out.
    """
    with scratch(clauses.sparkSession):
        born = births(clauses).where("dob > 0")
        linked, plain, names = parted(clauses)
        linked, first = materialise(linked, "linked"), born.where("dob = 1").select("tuple")
        missing = linked.where("lit is not null").select("lit")
        missing = _of_relations(missing, names, "left_semi").distinct().join(clauses.select(F.col("head").alias("lit")), "lit", "left_anti")
        given = missing.select("lit", F.lit(0).alias("lit_dob"))  # inputs of derived relations
        when = born.select(F.col("tuple").alias("lit"), F.col("dob").alias("lit_dob")).union(given)
        rows = linked.join(when, "lit", "left").join(names, relation_of("lit") == F.col("name"), "left")
        lit_dob = F.when(F.isnull("lit"), -1).when(F.isnull("name"), 0).otherwise(F.coalesce("lit_dob", F.lit(1 << 30)))
        own = materialise(rows.groupBy("clause_id", "head").agg(F.greatest(F.max(lit_dob), F.lit(0)).alias("latest")), "latest")
        of = own.join(born.withColumnRenamed("tuple", "head"), "head").where("dob > 1 and latest + 1 = dob")
        later = of.groupBy("head").agg(F.min("clause_id").alias("clause_id"))
        steps = materialise(linked.join(later, ["head", "clause_id"]).select(F.col("head").alias("tuple"), "clause_id", "rule", "lit"), "chosen")
        down = lambda new, _: new.join(steps, "tuple").where("lit is not null").select(F.col("lit").alias("tuple"))
        # tuples of dob 1 come from inputs: their clauses are looked for once the tree's others are known
        some = roots.select("tuple").distinct()
        lits = clauses.where("lit is not null").select(F.col("lit").alias("tuple")).join(some, "tuple", "left_semi").distinct()
        alone = lits.join(clauses.select(F.col("head").alias("tuple")).join(lits, "tuple", "left_semi"), "tuple", "left_anti")
        used = fixpoint(some.join(born, "tuple", "left_semi").union(alone), down)
        low = materialise(used.join(first, "tuple", "left_semi").select(F.col("tuple").alias("head")), "low")
        free = linked.join(own.where("latest = 0").select("clause_id", "head"), ["clause_id", "head"], "left_semi").select(clauses.columns)
        able = materialise(plain.select(clauses.columns).union(free).join(low, "head", "left_semi").select("head", "clause_id", "rule", "lit"), "able")
        last = able.join(able.groupBy("head").agg(F.min("clause_id").alias("clause_id")), ["head", "clause_id"])
        steps = materialise(steps.join(used, "tuple", "left_semi").union(last.select(F.col("head").alias("tuple"), "clause_id", "rule", "lit")), "steps")
        used = used.union(steps.where("lit is not null").select("lit")).distinct().join(born, "tuple", "left")
        return keep(used.select("tuple", F.coalesce("dob", F.lit(0)).alias("dob")).join(steps, "tuple", "left").select("tuple", "dob", "clause_id", "rule", "lit"), "derivation")


def needing(clauses: DataFrame, needed: DataFrame) -> DataFrame:
    """``tuple``s that cannot be derived without the tuples of ``needed`` (column tuple), themselves included.

    The clauses are read once: one with inputs only in its body stands or falls with these. The two runs of births, with the
    needed tuples and without, see what the other rules link only. Inputs that are not needed stay.
    """
    with scratch(clauses.sparkSession):
        gone = materialise(needed.select("tuple").distinct(), "needed")
        linked, plain, names = parted(clauses)
        hit = plain.join(gone.select(F.col("tuple").alias("lit"), F.lit(True).alias("hit")), "lit", "left").groupBy("clause_id", "head").agg(F.max(F.coalesce("hit", F.lit(False))).alias("hit"))
        first = materialise(hit.groupBy(F.col("head").alias("tuple")).agg(F.min("hit").alias("lost")), "first")
        tuples, body, waiting = _numbered(linked, names, first, gone)
        out_of = materialise(tuples.join(gone, "tuple", "left_semi").select("t"), "gone")
        born = materialise(_born(tuples, body, waiting, 1000).select("t"), "born")
        lost = first.where("lost").select("tuple", F.lit(True).alias("lost"))
        left = tuples.join(out_of, "t", "left_anti").join(lost, "tuple", "left").select("t", "derived", (F.col("first") & F.isnull("lost")).alias("first"))
        still = _born(materialise(left, "left"), body, waiting.join(out_of.withColumnRenamed("t", "h"), "h", "left_anti"), 1000)
        falls = born.join(still, "t", "left_anti").join(tuples.select("t", "tuple"), "t").select("tuple")
        given = _of_relations(clauses.where("lit is not null").select("lit"), names, "left_anti").select(F.col("lit").alias("tuple")).join(gone, "tuple", "left_semi")
        return keep(falls.union(given).distinct(), "needing")
