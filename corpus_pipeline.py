"""A corpus pipeline of five stages, each on all that the one before kept.

toxicity drops documents, near_duplicates keeps one of each group, secrets redacts texts, mixing repeats or
drops documents towards target weights, packing returns the pieces of the packed sequences. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornfels.llm import mixing, packing, resemblance, secrets, toxicity
from hornfels.llm.common import free_names
from hornfels.storage import materialise

#: The score from which a document counts as toxic: higher than the report's, so that clean ones stay.
REJECT = 0.6


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below REJECT, repeated ones each; empty and null texts have no toxic window and stay.

    All columns of ``docs`` stay, here and in the next three stages, whatever they hold or are called, and an empty table stays empty.
    """
    model = toxicity.train(docs, toxicity.toxic_labels(spark, sf_dir))
    scored = toxicity.score(docs, model)
    return scored.where(F.col(scored.columns[-1]) < REJECT).select(*_own(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id (null last) of each group of near-duplicates (five-word shingles, similarity 0.8), and all without any.

    SimHash fingerprints and an index of prefixes propose pairs, which are compared exactly. Texts without words, null ones too, are one group. Of rows that are equal in doc_id, text, source and language one stays.
    """
    return resemblance.representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets in its text replaced by their kind; n_chars, where there is one, follows the text. Null texts stay null."""
    forest, vocabulary = secrets.default_forest(spark)
    clean = secrets.redact(docs, forest, vocabulary)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.isnull("text"), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, a row of it each time; texts without words, null ones too, are taken 0 times.

    A null source is a source. Rows that are equal in all columns are interchangeable, so their copies are added up.
    """
    k1, k2 = free_names(docs.columns, "_k1", "_k2")
    missing = [F.isnull(c) for c in _own(docs)]
    keyed = docs.select("*", F.xxhash64(*_own(docs)).alias(k1), F.xxhash64(*missing, *_own(docs)).alias(k2))
    taken = mixing.mix(keyed.select(k1, k2, "text", "source"), k1, k2)
    times = taken.groupBy(k1, k2).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0").toDF("t1", "t2", "_copies", "_rows")
    joined = keyed.join(times, (F.col(k1) == F.col("t1")) & (F.col(k2) == F.col("t2")))
    own, copies = [keyed[f"`{c}`"] for c in docs.columns], F.explode(F.sequence(F.lit(1), times["_copies"]))
    single = joined.where(times["_rows"] == 1).select(*own, copies)
    several = joined.where(times["_rows"] > 1).dropDuplicates([k1, k2]).select(*own, copies)
    return single.union(several).toDF(*[f"c{i}" for i in range(len(own) + 1)]).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a document that the mix repeats is packed each time, an empty or null text as its end id.

    An empty table gives no pieces.
    """
    return packing.pack(docs.select("doc_id", "text", "source"), "doc_id", path=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the scores nor the rounding; tests hold every stage against loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
