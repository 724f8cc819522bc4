"""Near-duplicates by the Jaccard similarity of word shingles: SimHash and prefix filtering propose, an exact check links.

Every different text has a SimHash fingerprint of its shingles, and the index of ``simhash`` finds fingerprints within its
bits. A fingerprint proposes one text of its own and one of another for each: so many pairs as texts, however large a group
is. Two bits tell little of a similarity of 0.8, so what fingerprints miss is found as follows, and no link is lost.

Let the shingles of all texts have one order. Two sets of ``n`` and ``m`` shingles whose similarity is at least
``t`` share one of their first ``n - ceil(t n) + 1`` and ``m - ceil(t m) + 1``, whatever the order is. So an index
of these prefixes meets every pair: it is no sample and has no recall to state. If the first that they share has
``i`` and ``j`` others before it, they share ``min(n - i, m - j)`` at most, which must be ``t / (1 + t) (n + m)`` or
more; a posting keeps only what this leaves. The order decides the cost only: shingles that are common in a
sample of the texts come last. A copy with many changes then has its own shingles first, and meets none of the
others, and passages which many texts hold are not posted.

In a posting all texts are first compared with the one that has the most common shingles, near which a group of
copies lies; only texts whose links leave them in different components are then compared pair by pair. A large
group of texts whose similarity is mostly just below the bound still costs the square of its size. Equal texts
are one entry, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornfels.llm import simhash
from hornfels.llm.common import free_names, restored, small_batches, stashed
from hornfels.operators.components import components
from hornfels.storage import keep as kept
from hornfels.storage import materialise, scratch

#: Words a shingle, the hash's seed, and the similarity from which texts are linked, as a fraction.
SHINGLE, HASH_SEED, SIMILAR = 5, 42, (4, 5)
#: Texts in the sample that orders the shingles (one in so many where that is more, or pairs would grow with the square of the texts), in how
#: many of them a common one is, and common ones that are held, most common first: the order is free.
SAMPLE, ONE_IN, COMMON, HELD = 5000, 10, 5, 200_000
#: Rows an Arrow batch: one of pairs holds two whole texts a row, in the worker and outside the JVM's heap.
BATCH = 256


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The different 64-bit hashes of the text's shingles in order; of all words where they are fewer; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return np.empty(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[: len(words) - k] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def alike(a: np.ndarray, b: np.ndarray, similar: tuple[int, int] = SIMILAR) -> bool:
    """Whether the sets' Jaccard similarity is at least the fraction ``similar``, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return similar[1] * both >= similar[0] * (len(a) + len(b) - both)


def prefix(found: np.ndarray, common: tuple[np.ndarray, np.ndarray], similar: tuple[int, int] = SIMILAR) -> tuple[np.ndarray, float]:
    """The first shingles of a set by their count among the ``common`` ones (values in order, counts), then by hash; and the mean count."""
    n = len(found)
    take = n + similar[0] * n // -similar[1] + 1 if n else 0
    values, counts = common
    if not len(values) or not n:
        return found[:take], 0.0
    at = np.minimum(np.searchsorted(values, found), len(values) - 1)
    count = np.where(values[at] == found, counts[at], 0)
    return found[np.argsort(count, kind="stable")[:take]], float(count.mean())


def common_shingles(texts: DataFrame, shingle: int = SHINGLE, sample: int = SAMPLE, least: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that ``least`` texts or more of a hashed sample have, in order, and how many have them; ``texts`` has one column."""
    rows = texts.count()
    name = texts.columns[0]
    share = F.pmod(F.xxhash64(F.lit(HASH_SEED), F.monotonically_increasing_id()), F.lit(1 << 20)) < F.lit(int(min(1.0, max(sample, rows / ONE_IN) / max(1, rows)) * (1 << 20)))
    of = F.pandas_udf(lambda s: pd.Series([shingles(t or "", shingle) for t in s], dtype=object), "array<long>")
    each = texts.where(share).select(F.explode(of(F.col(name))).alias("shingle"))
    found = each.groupBy("shingle").count().where(F.col("count") >= least).orderBy(F.desc("count"), "shingle").limit(HELD).toPandas()
    found = found.sort_values("shingle")
    return found["shingle"].to_numpy(np.int64), found["count"].to_numpy(np.int64)


def _may_share(n: Column, i: Column, m: Column, j: Column, similar: tuple[int, int]) -> Column:
    """Whether sets of ``n`` and ``m`` shingles whose first common one has ``i`` and ``j`` before it can be similar."""
    p, q = similar
    return (q * F.least(n, m) >= p * F.greatest(n, m)) & ((p + q) * F.least(n - i, m - j) >= p * (n + m))


def _linked(pairs: DataFrame, sets: DataFrame, shingle: int, similar: tuple[int, int]) -> DataFrame:
    """The ``pairs`` (u and v, ids of ``sets``) whose texts are similar.

    Their prefixes are compared first, a fraction of the texts' bytes: what two sets share besides lies behind the
    prefix of one of them, and similar sets share ``t / (1 + t) (n + m)`` at least. Only what passes is compared whole.
    Of a prefix's hashes 16 bits travel with each pair; where some of one set fall together, so many more may be shared.
    """
    p, q = similar
    short = F.array_distinct(F.transform("posts", lambda x: (F.shiftrightunsigned(x, 48) - (1 << 15)).cast("smallint")))
    heads = sets.select("id", "n", short.alias("p"), F.size("posts").alias("all"))
    head = lambda k, c: heads.select(F.col("id").alias(k), F.col("n").alias(f"n{c}"), F.col("p").alias(f"p{c}"), (F.col("all") - F.size("p")).alias(f"l{c}"))
    behind = F.ceil(F.greatest("na", "nb") * p / q) - 1 + F.least("la", "lb")
    enough = F.size(F.array_intersect("pa", "pb")) + behind >= F.ceil((F.col("na") + F.col("nb")) * p / (p + q))
    pairs = materialise(pairs.join(head("u", "a"), "u").join(head("v", "b"), "v").where(enough).select("u", "v"), "likely")
    nodes = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    texts = materialise(sets.select("id", "text").join(nodes, "id", "left_semi"), "texts")
    side = lambda k, t: texts.select(F.col("id").alias(k), F.col("text").alias(t))

    def check(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last: tuple[str, np.ndarray] = ("", shingles("", shingle))
        for a, b in batches:
            out = []
            for x, y in zip(a, b, strict=True):
                if x != last[0]:
                    last = (x, shingles(x, shingle))
                out.append(alike(last[1], shingles(y, shingle), similar))
            yield pd.Series(out, dtype=bool)

    both = pairs.join(side("u", "_a"), "u").join(side("v", "_b"), "v")
    return materialise(both.where(F.pandas_udf(check, "boolean")("_a", "_b")).select("u", "v"), "similar")


def entries(docs: DataFrame, shingle: int, similar: tuple[int, int]) -> DataFrame:
    """A row for each different text of ``docs`` (columns t, its digest, and text): t, id, n, central, fp, posts and text."""
    common = common_shingles(docs.select("text"), shingle)

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = []
            for t in s:
                found = shingles(t, shingle)
                out.append((len(found), *prefix(found, common, similar), simhash.folded(found.astype(">i8").view(np.uint8).reshape(-1, 8))))
            yield pd.DataFrame(out, columns=["n", "posts", "central", "fp"])

    of = F.pandas_udf(work, "n int, posts array<long>, central double, fp long")
    made = docs.groupBy("t").agg(F.first("text").alias("text")).withColumn("_s", of("text"))
    return materialise(made.select("t", F.monotonically_increasing_id().alias("id"), "_s.*", "text"), "texts")


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """``u`` < ``v``, ids of ``sets``: each text with the first of its fingerprint, and that with the first of one near fingerprint."""
    rows = sets.where("n > 0").select("id", "fp")
    first = materialise(rows.groupBy("fp").agg(F.min("id").alias("first")), "fingerprints")
    own = rows.join(first, "fp").where("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v"))
    met = materialise(simhash.similar_pairs(first.select("fp")), "near")
    one = met.union(met.select("v", "u")).groupBy(F.col("u").alias("fp")).agg(F.min("v").alias("other"))
    ends = one.join(first, "fp").join(first.select(F.col("fp").alias("other"), F.col("first").alias("second")), "other")
    return own.union(ends.select(F.least("first", "second"), F.greatest("first", "second")))


def links(sets: DataFrame, shingle: int, similar: tuple[int, int]) -> DataFrame:
    """``id`` and ``root``, the least id that links reach from it, for all entries with a link; see the module's text."""
    p, q = similar
    index = sets.select("id", "n", F.posexplode("posts").alias("i", "shingle"))
    # of two similar sets the smaller one has the shingle early enough for a partner of its own size
    early = F.max((p + q) * (F.col("n") - F.col("i")) >= 2 * p * F.col("n"))
    shared = index.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("n").alias("least"), early.alias("early"))
    shared = materialise(shared.where("texts > 1 and early").select("shingle", "least"), "shared")
    # the fewest shingles of a partner; with so many before this one it is nobody's first common one
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * p / q))
    posted = index.join(shared, "shingle").where((p + q) * (F.col("n") - F.col("i")) >= p * (F.col("n") + partner))
    posted = materialise(posted.select("shingle", "id", "n", "i"), "postings")
    hubs = posted.join(sets.select("id", "central"), "id").groupBy("shingle").agg(F.max(F.struct("central", "id", "n", "i")).alias("hub")).select("shingle", "hub.id", "hub.n", "hub.i").toDF("shingle", "hub", "m", "j")
    near = posted.join(hubs, "shingle").where("id <> hub").where(_may_share(F.col("n"), F.col("i"), F.col("m"), F.col("j"), similar))
    near = near.select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v"))
    pairs = materialise(fingerprint_pairs(sets).union(near).distinct(), "pairs")
    without = sets.where("n = 0").select("id")  # texts without words are alike
    least = without.agg(F.min("id")).first()[0]
    found = _linked(pairs, sets, shingle, similar).union(without.select(F.col("id").alias("u"), F.lit(least).cast("long").alias("v")))
    roots = materialise(components(found).withColumnRenamed("node", "id"), "roots")
    members = posted.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    apart = members.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    members = materialise(members.join(apart, "shingle", "left_semi"), "postings")
    a, b = members.alias("a"), members.alias("b")
    met = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.root") != F.col("b.root")) & (F.col("a.id") < F.col("b.id"))
    rest = a.join(b, met & _may_share(F.col("a.n"), F.col("a.i"), F.col("b.n"), F.col("b.i"), similar))
    rest = rest.select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct().join(pairs, ["u", "v"], "left_anti")
    more = _linked(materialise(rest, "pairs"), sets, shingle, similar)
    return components(found.union(more)).withColumnRenamed("node", "id")


def resembling(docs: DataFrame, *keep: str, text: str = "text", shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The ``keep`` columns, ``key`` of the row's text and ``root``: the least key that links reach from it.

    Every row has a key, also empty and null texts and others without words, which are alike, so rows are neither
    lost nor added. A new column has underscores behind its name where ``keep`` has it.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    with scratch(docs.sparkSession), small_batches(docs.sparkSession, BATCH):
        sets = entries(docs.select(F.md5(own).alias("t"), own.alias("text")), shingle, similar)
        roots = links(sets, shingle, similar)
        named = kept(sets.select("t", F.col("id").alias("key")).join(roots.withColumnRenamed("id", "key"), "key", "left"), "roots")
    rows = docs.select(*stashed(keep), F.md5(own).alias("_t")).join(named.withColumnRenamed("t", "_t"), "_t")
    return restored(rows.withColumn("root", F.coalesce("root", "key")), keep, "key", "root")


def representatives(docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the least doc_id (null last).

    Fingerprints propose pairs and the index of prefixes all that these miss; the similarity of word shingles links.
    Ties of doc_id go by the text's hash, then source and language; equal rows leave one.
    """
    k1, k2 = free_names(docs.columns, "_k1", "_k2")
    sep = [F.xxhash64("doc_id", F.isnull("doc_id")).alias(k1), F.xxhash64("text", "source", "lang", F.isnull("text")).alias(k2)]
    keyed = docs.select("*", *sep)
    found = resembling(keyed, "doc_id", k1, k2, shingle=shingle, similar=similar)
    root = found.columns[-1]
    best = found.groupBy(root).agg(F.min(F.struct(F.isnull("doc_id").alias("late"), "doc_id", k2, k1)).alias("best")).select(f"best.{k1}", f"best.{k2}")
    left = keyed.join(best.distinct(), [k1, k2], "left_semi").dropDuplicates([k1, k2])
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
