"""SimHash near-duplicates by an inverted index of byte positions with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most ``k`` bits differ in
at most ``k`` bytes, so they share at least 8 - k positional bytes: the guaranteed minimum. Postings of
single bytes would pair a fixed share of all fingerprints, so the index posts every set of 8 - k positional
bytes (28 for k = 2); a pair that meets in a posting has its shared bytes tallied, must reach the minimum,
is kept in the first of its common postings only, and is verified bit by bit in the join itself, which so
gives links and nothing else. Equal fingerprints are one entry, and at most 2^(8k) different ones can meet
in a posting, however many copies there are.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornfels.llm.common import read_table, restored, stashed
from hornfels.operators.components import components
from hornfels.storage import materialise

#: Words a shingle, the hash's seed, and bits by which linked fingerprints differ at most.
SHINGLE, HASH_SEED, MAX_BITS = 3, 42, 2
BYTES = 8


def folded(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of big-endian hashes (rows of eight bytes): a bit is set if over half of them have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash: a bit is set if over half of the shingles' hashes have it; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[: len(words) - k] + 1)).tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]), np.uint8)
    return folded(hashes.reshape(-1, 8))


def fingerprints(docs: DataFrame, *keep: str, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The ``keep`` columns and ``fp`` (with underscores behind it where ``keep`` has it) for each row; null text counts as empty."""
    of = F.pandas_udf(lambda s: pd.Series([fingerprint(t or "", shingle) for t in s], dtype="int64"), "long")
    return restored(docs.select(*stashed(keep), of(F.col(text)).alias("fp")), keep, "fp")


def _byte(x: Column, at: int) -> Column:
    return F.shiftrightunsigned(x, 8 * at).bitwiseAND(F.lit(255))


def _first_set(mask: int, left_out: list[tuple[int, ...]]) -> int:
    """The first posting that a pair shares whose bytes in ``mask`` differ: it leaves all of them out; -1 for none."""
    return next((i for i, out in enumerate(left_out) if all(mask >> b & 1 == 0 or b in out for b in range(BYTES))), -1)


def similar_pairs(values: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``u`` < ``v`` for all different fingerprints of ``values`` (column ``fp``, each once) within ``max_bits``."""
    left_out = list(combinations(range(BYTES), max_bits))
    masks = [sum(255 << (8 * b) for b in range(BYTES) if b not in out) for out in left_out]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    posts = F.explode(F.array(*[F.struct(F.lit(i).alias("set"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(signed)]))
    index = values.select("fp", posts.alias("p")).select("fp", "p.set", "p.bytes")
    # Spark sizes the postings as if explode added no rows, and would broadcast an index many times its threshold
    a, b = index.alias("a"), index.hint("merge").alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    differ = reduce(add, [(_byte(x, i) != 0).cast("int") * (1 << i) for i in range(BYTES)])  # a bit a byte
    tally = BYTES - F.bit_count(differ)
    first = F.element_at(F.lit([_first_set(mask, left_out) for mask in range(1 << BYTES)]), differ + 1)
    same = (F.col("a.set") == F.col("b.set")) & (F.col("a.bytes") == F.col("b.bytes")) & (F.col("a.fp") < F.col("b.fp"))
    kept = (F.bit_count(x) <= max_bits) & (tally >= BYTES - max_bits) & (first == F.col("a.set"))
    return a.join(b, same & kept).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def near_duplicates(docs: DataFrame, *keep: str, text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The ``keep`` columns, ``fp`` and ``root``: the least fingerprint that links reach from this row's.

    Every row has a fingerprint, also empty and null texts (0), so rows are neither lost nor added. Repeated
    rows share a root. An empty table gives an empty result. A new column has underscores behind its name where
    ``keep`` has it.
    """
    held = docs.select(*stashed(keep), F.col(text).alias("_text"))
    rows = materialise(fingerprints(held, *[f"_keep{i}" for i in range(len(keep))], text="_text", shingle=shingle), "simhash")
    values = rows.select("fp").distinct()
    links = similar_pairs(values, max_bits)
    roots = materialise(components(links).withColumnRenamed("node", "fp"), "roots")
    return restored(rows.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), keep, "fp", "root")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    found = materialise(found, "simhash")
    least = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))  # a row a group, nearly as many as documents: never to the driver
    return found.join(least.hint("merge"), "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
