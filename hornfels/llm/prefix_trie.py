"""The trie of all conversations' prefixes, with what sharing them saves, by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that begin with it, and the smallest
of them owns it. The nodes that a conversation owns are a suffix of its path, so one number a conversation, the first
depth it owns, marks them all. What a subtree saves is the tokens of its occurrences less the tokens of its owned ones:
of a member's tail from a node on, the owned suffix cancels, so a member adds the tokens from that node up to its first
owned turn. A childless node is the end of its owner, so leaves are a flag of conversations, and a node's children
are the members that own a turn right below it. One group-by over the prefixes adds all of it up.

Prefixes are told apart by running exclusive ors of 128 hashed bits of each turn and its place. They run over blocks
of a conversation and the blocks' totals, so a conversation of any length is spread over many tasks, and so are the
members of a node: they meet in aggregates with partial sums only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hornfels.llm.common import WORD, read_table
from hornfels.storage import keep, materialise, scratch

#: Turns of a conversation that one task sums at a time, and characters of a role or text by which ranges are cut.
BLOCK, KEY = 4096, 64
#: A node that holds more than one in so many occurrences is looked up by broadcast: there are fewer of them than this.
HOT = 1000
#: Conversations that share a base, and the divisor of the hash that says how many turns they take from it.
FAMILY, TAKEN = 20, 4
#: Bits of ``monotonically_increasing_id`` that count within a partition.
WITHIN = 33


def _family(c: Column) -> tuple[Column, Column]:
    """The base of a conversation and the turns it takes from it."""
    return c - c % FAMILY, (F.crc32(c.cast("string").cast("binary")) % TAKEN).cast("long")


def ordered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, at, t1, t2, words) for each turn, and (conv_id, part, first, before) for each conversation and range.

    Turns are in the order of ``turn`` (null first), role and text; ``at`` grows with it, and a turn's place from 0 is
    ``at - first + before``. Rows without a conv_id are left out; null role or text becomes empty.
    """
    own = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", own("role"), own("text"))
    # ranges are cut by the beginnings of role and text, whose order is theirs, so that no whole text is part of a bound
    long = F.char_length("role") > KEY
    cuts = [F.col("conv_id"), F.col("turn"), F.substring("role", 1, KEY), long, F.when(~long, F.substring("text", 1, KEY))]
    placed = turns.repartitionByRange(*cuts).sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id",
        F.monotonically_increasing_id().alias("at"),
        F.xxhash64("role", "text").alias("t1"),
        F.xxhash64(F.lit(7), "text", "role").alias("t2"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    )
    placed = materialise(placed.withColumn("part", F.shiftright("at", WITHIN)), "turns")
    spans = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    return placed, materialise(spans.withColumn("before", F.coalesce(before, F.lit(0))), "spans")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth from 1, t1, t2, words) of every rebuilt turn, and (conv_id, length) of every conversation.

    A conversation takes its base's first turns and goes on with its own behind as many; a conversation whose base is
    absent and whose own turns are no more than those has the length 0.
    """
    placed, spans = ordered(conversations)
    base, taken = _family(F.col("conv_id"))
    own = placed.join(spans, ["conv_id", "part"]).withColumn("place", F.col("at") - F.col("first") + F.col("before"))
    heads = own.where(F.col("place") < TAKEN).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("place", "t1", "t2", "words"))).alias("head"))  # at most TAKEN
    known = spans.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumns({"base": base, "taken": taken})
    known = known.join(heads, "base", "left")
    head = F.when(F.isnull("head") | (F.col("taken") == 0), F.expr("slice(head, 1, 0)")).otherwise(F.slice("head", F.lit(1), F.greatest(F.col("taken"), F.lit(1)).cast("int")))
    known = known.withColumn("head", head).withColumn("led", F.coalesce(F.when(F.isnotnull("head"), F.size("head")), F.lit(0)).cast("long"))
    known = materialise(known.withColumn("length", F.col("led") + F.greatest(F.col("n") - F.col("taken"), F.lit(0))), "known")
    first = known.select("conv_id", F.explode("head").alias("h")).select("conv_id", (F.col("h.place") + 1).alias("depth"), "h.t1", "h.t2", "h.words")
    shift = spans.join(known.select("conv_id", "taken", "led"), "conv_id")
    later = placed.join(shift, ["conv_id", "part"]).withColumn("place", F.col("at") - F.col("first") + F.col("before")).where("place >= taken")
    later = later.select("conv_id", (F.col("place") + 1 - F.col("taken") + F.col("led")).alias("depth"), "t1", "t2", "words")
    return first.unionByName(later), known.select("conv_id", "length")


def occurrences(turns: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each turn and each conversation's empty prefix: conv_id, block, depth, a and b (the prefix), a0 and b0 (that before), ahead (tokens before); and (conv_id, block, length, total)."""
    block = F.floor((F.col("depth") - 1) / BLOCK).cast("long").alias("block")
    hashed = materialise(turns.select("conv_id", "depth", "words", F.xxhash64(F.lit(1), "depth", "t1", "t2").alias("x"), F.xxhash64(F.lit(2), "depth", "t1", "t2").alias("y"), block), "hashed")
    sums = hashed.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"), F.sum("words").alias("bw"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    whole = Window.partitionBy("conv_id")
    none = F.lit(0).cast("long")
    sums = sums.select("conv_id", "block", F.coalesce(F.bit_xor("bx").over(earlier), none).alias("bx"), F.coalesce(F.bit_xor("by").over(earlier), none).alias("by"), F.coalesce(F.sum("bw").over(earlier), none).alias("bw"), F.sum("bw").over(whole).alias("total"))
    sums = materialise(sums, "blocks")
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = hashed.join(sums, ["conv_id", "block"]).select(
        "conv_id",
        "block",
        "depth",
        F.col("bx").bitwiseXOR(F.bit_xor("x").over(so_far)).alias("a"),
        F.col("by").bitwiseXOR(F.bit_xor("y").over(so_far)).alias("b"),
        "x",
        "y",
        (F.col("bw") + F.sum("words").over(so_far) - F.col("words")).alias("ahead"),
    )
    rows = rows.select("conv_id", "block", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("a0"), F.col("b").bitwiseXOR(F.col("y")).alias("b0"), "ahead")
    root = members.select("conv_id", *[F.lit(v).cast("long").alias(k) for k, v in {"block": -1, "depth": 0, "a": 0, "b": 0, "a0": 0, "b0": 0, "ahead": 0}.items()])
    ends = sums.select("conv_id", "block", "total").unionByName(members.select("conv_id", F.lit(-1).cast("long").alias("block"), none.alias("total")))
    ends = ends.join(members, "conv_id").withColumn("total", F.max("total").over(whole))
    return materialise(rows.unionByName(root), "occurrences"), materialise(ends, "ends")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each prefix's ids, which come in order; only the running digest of one prefix is held."""
    names = ["depth", "a", "b", "ends_sha256"]
    key, running = None, None
    for batch in batches:
        if not len(batch):
            continue
        keys, ids, out = batch[names[:3]].to_numpy(), batch["conv_id"].tolist(), []
        cuts = [0, *((keys[1:] != keys[:-1]).any(axis=1).nonzero()[0] + 1).tolist(), len(ids)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            text, now = ",".join(map(str, ids[low:high])).encode(), tuple(keys[low].tolist())
            if now == key:
                running.update(b"," + text)
                continue
            if running:
                out.append((*key, running.hexdigest()))
            key, running = now, hashlib.sha256(text)
        yield pd.DataFrame(out, columns=names)
    if running:
        yield pd.DataFrame([(*key, running.hexdigest())], columns=names)


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, depth (from 1, without gaps), two hashes t1 and t2 of what is said, and words; ``members`` every
    conversation once with its length, also those without turns, which are members of the root alone. Without members
    there is no node.
    """
    with scratch(turns.sparkSession):
        rows, ends = occurrences(turns, members)
        prefix = ["depth", "a", "b"]
        with_length = rows.join(ends.select("conv_id", "block", "length"), ["conv_id", "block"])
        owned = with_length.groupBy(*prefix).agg(F.min(F.struct("conv_id", "ahead")).alias("own"), F.max("length").alias("longest"))
        first = F.min(F.struct("depth", F.col("own.ahead").alias("ahead"))).alias("first")
        owners = owned.groupBy("own.conv_id").agg(first, F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))
        marks = ends.join(owners, "conv_id", "left").select(
            "conv_id",
            "block",
            "length",
            F.coalesce("first.depth", F.col("length") + 1).alias("first"),
            F.coalesce("first.ahead", "total").alias("unowned"),
            F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"),
        )
        marked = materialise(rows.join(marks, ["conv_id", "block"]), "marked")
        below = F.col("depth") + 1
        nodes = marked.groupBy(*prefix).agg(
            F.min(F.struct("conv_id", "first", "a0", "b0")).alias("own"),
            F.count("*").alias("n_convs"),
            F.sum((below.between(F.col("first"), F.col("length"))).cast("long")).alias("n_children"),
            F.sum("leaf").alias("n_leaves"),
            F.sum(F.when(F.col("depth") < F.col("first"), F.col("unowned") - F.col("ahead")).otherwise(0)).alias("saved_tokens"),
        )
        nodes = materialise(nodes.select(*prefix, "own.*", "n_convs", "n_children", "n_leaves", "saved_tokens"), "nodes")
        ended = marked.where("depth = length").select(*prefix, "conv_id").repartition(*prefix).sortWithinPartitions(*prefix, "conv_id")
        digests = ended.mapInPandas(_digests, "depth long, a long, b long, ends_sha256 string")
        # only where a path enters what it owns another conversation owns the parent
        least = max(1, marked.count() // HOT)
        parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("a0"), F.col("b").alias("b0"), F.col("conv_id").alias("parent"), "n_convs")
        entered = nodes.where("depth = first and depth > 0").select("depth", "a", "b", "a0", "b0")
        hot = F.broadcast(parents.where(F.col("n_convs") > least).drop("n_convs"))
        looked = entered.join(hot, ["depth", "a0", "b0"], "left")
        rest = looked.where("parent is null").drop("parent").join(parents.where(F.col("n_convs") <= least).drop("n_convs"), ["depth", "a0", "b0"])
        found = looked.where("parent is not null").unionByName(rest).select(*prefix, "parent")
        out = nodes.join(found, prefix, "left").join(digests, prefix, "left").select(
            "conv_id",
            "depth",
            F.when(F.col("depth") == 0, F.lit(None)).otherwise(F.coalesce("parent", "conv_id")).cast("long").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
        return keep(out, "trie")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``trie`` of the rebuilt conversations. Rows without a conv_id are left out, other nulls are empty texts or come first;
    repeated rows are turns of their own, further columns are not looked at, and an empty table gives an empty result."""
    with scratch(conversations.sparkSession):
        return keep(trie(*rebuilt(conversations)), "trie")


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read_table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
           lambda s, c: list_reduce(range(8), lambda y, i: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END), xor(s, c)), 4294967295), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), seq AS (
  SELECT i.conv_id, 0 AS part, k, r, x FROM ids i JOIN t ON t.conv_id = i.base AND k <= h
  UNION ALL SELECT i.conv_id, 1, k, r, x FROM ids i JOIN t ON t.conv_id = i.conv_id AND k > h
), walk AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS d, r, x FROM seq
), path AS MATERIALIZED (
  SELECT conv_id, d, string_agg(sha256(r) || sha256(x), '') OVER (PARTITION BY conv_id ORDER BY d) AS p, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM walk
  UNION ALL SELECT conv_id, 0, '', 0 FROM ids
), node AS MATERIALIZED (
  SELECT d, p, min(conv_id) AS own, count(*) AS n, any_value(w) AS w FROM path GROUP BY d, p
), edge AS MATERIALIZED (
  SELECT node.d, node.p, node.own, node.n, node.w, up.p AS pp FROM node LEFT JOIN path up ON up.conv_id = node.own AND up.d = node.d - 1
), kids AS MATERIALIZED (
  SELECT d - 1 AS d, pp AS p, count(*) AS kids FROM edge WHERE d > 0 GROUP BY 1, 2
), sub AS MATERIALIZED (
  SELECT a.d, a.p, sum((u.n - 1) * u.w)::BIGINT AS saved, count(*) FILTER (WHERE kids.kids IS NULL)::BIGINT AS leaves
  FROM node u JOIN path a ON a.conv_id = u.own AND a.d <= u.d LEFT JOIN kids ON kids.d = u.d AND kids.p = u.p GROUP BY a.d, a.p
), fin AS MATERIALIZED (
  SELECT p.d, p.p, string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) AS e
  FROM path p JOIN (SELECT conv_id, max(d) AS d FROM path GROUP BY conv_id) l ON l.conv_id = p.conv_id AND l.d = p.d GROUP BY p.d, p.p
)
SELECT e.own AS conv_id, e.d::BIGINT AS depth, up.own AS parent_conv_id, e.n::BIGINT AS n_convs, coalesce(kids, 0)::BIGINT AS n_children, leaves AS n_leaves,
       saved AS saved_tokens, sha256(coalesce(fin.e, '')) AS ends_sha256
FROM edge e JOIN sub ON sub.d = e.d AND sub.p = e.p LEFT JOIN kids ON kids.d = e.d AND kids.p = e.p
LEFT JOIN node up ON up.d = e.d - 1 AND up.p = e.pp LEFT JOIN fin ON fin.d = e.d AND fin.p = e.p
"""
