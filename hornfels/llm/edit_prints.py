"""Document fingerprints by a randomised edit embedding, bit-sampled banding and verification.

A pointer walks over the characters of a text: at each step the character under it is put out, and shared random bits, one
for each pair of step and character, say whether the pointer moves on. Where two texts are the same up to an edit, their walks fall
into step again soon behind it, so the number of steps at which the outputs differ, a Hamming distance, is small where
the edit distance is. The output is sampled at shared random steps; a text of any length has ``SAMPLES`` of them: sample ``s`` is
taken at the step below the walk's length that has the least of the shared random ranks of ``s``, so texts of nearly equal
lengths sample nearly the same steps. A sample is one byte, hashed from the step and the ``READ`` characters from the pointer on: single
characters are so few that unrelated texts would share bands by chance. A fingerprint is the bytes of all samples.

Bands of samples are the keys of an index. Two fingerprints that differ in fewer samples than there are bands agree on a band, so
the index meets every pair of that likeness, and each candidate is verified on all samples.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hornfels.llm.common import free_names, read_table, small_batches
from hornfels.operators.components import components
from hornfels.storage import keep, materialise, scratch

SEED, SAMPLES, READ = 13, 128, 3
#: Steps after which the shared bits repeat, and classes into which characters are hashed for them.
PERIOD, CLASSES = 4096, 256
#: Characters whose steps are added up at a time, and the steps that the ranks of the samples cover.
PIECE, STEPS = 1 << 20, 1 << 44
#: Fingerprints are linked if so many samples agree (four in five), and rows of a batch of whole texts.
LINKED, BATCH = -(-4 * SAMPLES // 5), 256
#: A band more than the samples that may differ.
BANDS = SAMPLES - LINKED + 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _moves() -> list[list[int]]:
    """For each class and step (modulo PERIOD): the step after the one at which the pointer moves on."""
    bits = np.random.default_rng(SEED).integers(0, 2, (CLASSES, PERIOD), dtype=np.int8)
    steps = list(range(PERIOD))  # one object a number, for all rows
    rows = []
    for row in bits:
        on = np.flatnonzero(row)
        at = np.searchsorted(on, np.arange(PERIOD))
        rows.append([steps[k] for k in (on[at % len(on)] + 1) % PERIOD])
    return rows


@lru_cache(maxsize=1)
def _ranks() -> np.ndarray:
    """For each sample the steps that have a lower rank than all before them, in order; then STEPS."""
    rng = np.random.default_rng(SEED + 1)
    lists = []
    for _ in range(SAMPLES):
        lows, at = [0], 0
        while True:
            at = int((at + 1) / max(rng.random(), 1e-15))  # the chance that none of m steps is lower is (at + 1) / (m + 1)
            if at >= STEPS:
                break
            lows.append(at)
        lists.append(lows)
    out = np.full((SAMPLES, max(map(len, lists)) + 1), STEPS, np.int64)
    for row, lows in zip(out, lists, strict=True):
        row[: len(lows)] = lows
    return out


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def walk(points: np.ndarray, state: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The steps that the pointer stays on each character, from the step ``state`` on, and the step (modulo PERIOD) behind each."""
    moves = _moves()
    classes = ((points.astype(np.uint64) * _GOLD) >> np.uint64(56)).astype(np.uint8).tobytes()
    k = state
    behind = np.frombuffer(array("H", [k := row[k] for row in map(moves.__getitem__, classes)]), np.uint16) if len(classes) else np.empty(0, np.uint16)
    before = np.r_[np.uint16(state), behind[:-1]] if len(behind) else behind
    return ((behind.astype(np.int32) - before - 1) % PERIOD + 1).astype(np.uint16), behind


def sampled(points: np.ndarray, stays: np.ndarray) -> bytes:
    """The fingerprint of characters and the steps that the pointer stays on them; bytes from 1, and zeros for an empty text."""
    length = int(stays.sum(dtype=np.int64))
    if not length:
        return bytes(SAMPLES)
    ranks = _ranks()
    steps = ranks[np.arange(SAMPLES), (ranks < length).sum(axis=1) - 1]
    order = np.argsort(steps)
    found, base, done = np.zeros(SAMPLES, np.uint64), 0, 0
    for at in range(0, len(points), PIECE):
        ends = base + np.cumsum(stays[at : at + PIECE], dtype=np.int64)
        base = int(ends[-1])
        upto = int(np.searchsorted(steps[order], base))
        mine = order[done:upto]
        under = at + np.searchsorted(ends, steps[mine], side="right")
        for k in range(READ):
            inside = under + k < len(points)
            found[mine] = found[mine] * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(inside, points[np.minimum(under + k, len(points) - 1)], 0).astype(np.uint64) + np.uint64(1)
        done = upto
    mixed = (found * np.uint64(0xC2B2AE3D27D4EB4F) + steps.astype(np.uint64)) * _GOLD
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _GOLD
    return (1 + (mixed >> np.uint64(40)) % np.uint64(255)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of samples that agree."""
    return float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())


class Text:
    """A text with its walk and fingerprint."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.points = characters(self.text)
        self.stays, self.behind = walk(self.points)
        self.print = sampled(self.points, self.stays)

    def edited(self, other: Text) -> tuple[str, bytes]:
        """The text with its last half replaced by the other's first characters, and its fingerprint; the walk over the rest is kept."""
        cut = len(self.points) - len(self.points) // 2
        new = other.points[: len(self.points) - cut]
        stays, _ = walk(new, int(self.behind[cut - 1]) if cut else 0)
        return self.text[:cut] + other.text[: len(new)], sampled(np.concatenate((self.points[:cut], new)), np.concatenate((self.stays[:cut], stays)))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds ``name`` (hexadecimal) for each row; null text counts as empty. A new column whose name is taken has underscores behind it."""
    of = F.pandas_udf(lambda s: pd.Series([Text(t).print.hex() for t in s], dtype=object), "string")
    return docs.withColumn(*free_names(docs.columns, name), of(F.col(f"`{text}`")))


def _differing(a: Column, b: Column) -> Column:
    """Bytes in which two arrays of longs differ."""

    def nonzero(x: Column) -> Column:
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit({4: 0x0F0F0F0F0F0F0F0F, 2: 0x3F3F3F3F3F3F3F3F, 1: 0x7F7F7F7F7F7F7F7F}[shift])))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return reduce(add, [nonzero(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SAMPLES // 8)])


def _words(fingerprint: Column) -> Column:
    """A hexadecimal fingerprint as longs."""

    def word(i: int) -> Column:
        high, low = (F.conv(F.substring(fingerprint, 16 * i + 1 + k, 8), 16, 10).cast("long") for k in (0, 8))
        return F.shiftleft(high, 32).bitwiseOR(low)

    return F.array(*[word(i) for i in range(SAMPLES // 8)])


def links(prints: DataFrame) -> DataFrame:
    """``id`` and ``root``, the least id that links reach, for the different fingerprints of ``prints`` (id, words) that have a link.

    A bucket's members are first held against its hub, the one with most company; then only members that this leaves in
    different components meet, and the join itself verifies them, so it puts out links alone. No bucket is cut.
    """
    cuts = [round(k * SAMPLES / BANDS) for k in range(BANDS + 1)]
    digits = F.array_join(F.transform("words", lambda w: F.lpad(F.hex(w), 16, "0")), "")
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("_digits", 2 * a + 1, 2 * (b - a))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
    index = prints.select("id", digits.alias("_digits")).select("id", F.explode(keys).alias("key"))
    shared = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    posted = materialise(index.join(shared, "key"), "postings")
    company = posted.groupBy("id").agg(F.sum("n").alias("company"))
    posted = materialise(posted.join(company, "id").select("key", "id", "company"), "postings")
    hubs = posted.groupBy("key").agg(F.max(F.struct("company", F.negative("id").alias("id"))).alias("hub")).select("key", (-F.col("hub.id")).alias("hub"))
    near = posted.join(hubs, "key").where("id <> hub").select("id", "hub").distinct()
    side = lambda k, w: prints.select(F.col("id").alias(k), F.col("words").alias(w))
    near = near.join(side("id", "a"), "id").join(side("hub", "b"), "hub").where(_differing(F.col("a"), F.col("b")) <= SAMPLES - LINKED)
    near = materialise(near.select(F.col("id").alias("u"), F.col("hub").alias("v")), "near")
    roots = materialise(components(near).withColumnRenamed("node", "id"), "roots")
    members = posted.select("key", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    apart = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    members = materialise(members.join(apart, "key", "left_semi").join(prints, "id"), "apart")
    a, b = members.alias("a"), members.alias("b")
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.root") != F.col("b.root"))
    more = a.join(b, met & (_differing(F.col("a.words"), F.col("b.words")) <= SAMPLES - LINKED)).select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    return components(near.unionByName(more.distinct())).withColumnRenamed("node", "id")


def grouped(rows: DataFrame, fingerprint: str = "fingerprint", key: str = "doc_id", name: str = "near_id") -> DataFrame:
    """Adds ``name``: the least ``key`` of the rows that links of four in five samples or more reach, the row itself included (null: none has one)."""
    near = free_names(rows.columns, name)[0]
    with scratch(rows.sparkSession):
        values = rows.select(F.col(f"`{fingerprint}`").alias("_fp")).distinct()
        prints = materialise(values.select("_fp", F.monotonically_increasing_id().alias("id"), _words(F.col("_fp")).alias("words")), "prints")
        roots = links(prints.select("id", "words"))
        named = prints.select("_fp", "id").join(roots, "id", "left").select("_fp", F.coalesce("root", "id").alias("_root"))
        named = materialise(named, "named")
        least = rows.groupBy(F.col(f"`{fingerprint}`").alias("_fp")).agg(F.min(f"`{key}`").alias("_key")).join(named, "_fp")
        least = least.join(least.groupBy("_root").agg(F.min("_key").alias("_least")), "_root").select("_fp", "_least")
        least = keep(least, "groups")
    return rows.join(least, rows[fingerprint] == least["_fp"]).select(*[rows[c] for c in rows.columns], F.col("_least").alias(near))


_OUT = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edge int, part int, text string"


def _outcome(doc_id: str | None, own: Text, after: Text) -> tuple:
    edited, its = own.edited(after)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(own.points), sha, own.print.hex(), its.hex(), likeness(own.print, its), likeness(own.print, after.print)


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each document with the next one of its range; the first (edge 1) and the last (edge 2) of the range with their texts besides."""
    names = [c.split()[0] for c in _OUT.split(", ")]
    part, last = TaskContext.get().partitionId(), None
    edge = lambda which, doc: (doc[0], *[None] * 6, which, part, doc[1].text)
    for batch in batches:
        out = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            now = (doc_id, Text(text))
            out.append(edge(1, now) if last is None else (*_outcome(*last, now[1]), 0, part, None))
            last = now
        yield pd.DataFrame(out, columns=names)
    if last is not None:
        yield pd.DataFrame([edge(2, last)], columns=names)


def successions(docs: DataFrame) -> DataFrame:
    """Each row's doc_id, n_chars, fingerprint, that of its edited text (last half replaced by the start of the next document), and likenesses.

    The next document is that of the next doc_id (null last, ties by the text's hash, equal rows are interchangeable), after the last one the first.
    Rows are sorted by ranges, and a range's documents pass through its task one after the other; only the two at the ends of a range, of
    which there are as many as partitions, are joined to their neighbours. Null text counts as empty; an empty table gives an empty result.
    """
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text").asc(), F.asc("_row")]  # no whole text is part of a range's bound
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_row"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    with small_batches(docs.sparkSession, BATCH):
        made = materialise(placed.mapInPandas(_in_order, _OUT), "prints")
        parts = made.where("edge = 1").select("part")
        ahead = Window.orderBy("part")  # a row a partition
        after = parts.select("part", F.coalesce(F.lead("part").over(ahead), F.min("part").over(ahead)).alias("after"))
        first = made.where("edge = 1").select(F.col("part").alias("after"), F.col("text").alias("next"))
        seams = made.where("edge = 2").select("doc_id", "part", "text").join(after, "part").join(first, "after")

        def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([_outcome(i, Text(t), Text(n)) for i, t, n in zip(b["doc_id"], b["text"], b["next"], strict=True)], columns=_OUT.replace(",", "").split()[:14:2])

        schema = ", ".join(_OUT.split(", ")[:7])
        ends = materialise(seams.select("doc_id", "text", "next").mapInPandas(joined, schema), "seams")
    whole = made.where("edge = 0").select(ends.columns).unionByName(ends)
    return whole.withColumn("doc_id", F.col("doc_id").cast(kind))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(successions(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
