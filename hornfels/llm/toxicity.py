"""Compression-distance classification of toxic text with two trained zstandard dictionaries.

zstandard's trainer makes one dictionary from windows of ordinary documents and one from toxic text: the words
of toxic documents that hold character 5-grams which occur in significantly more toxic documents. A window is
compressed with the ordinary dictionary alone and with the toxic one behind it; bytes of zero stand for the
toxic one in the first, so that all else lies equally far. The bytes saved are the window's difference. A
document's score is a logistic curve over its windows' differences: the largest, and how many reach each
threshold.

What is learned comes from a bounded, hashed sample of labelled documents (``SAMPLE`` a class); one
part makes the dictionaries, the other calibrates. Scoring covers every window of every text.
"""

from __future__ import annotations

import math
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornfels.llm.common import crc_of_id, free_names, read_table, sigmoid
from hornfels.storage import materialise

WINDOW_WORDS, GRAM = 12, 5
#: Labelled documents sampled for each class, and windows of ordinary ones given to the trainer.
SAMPLE, ORDINARY_WINDOWS = 5000, 40_000
TOXIC_BYTES, ORDINARY_BYTES = 4096, 110_000
#: Bytes a segment of the trainer has, and those that it counts; the level has matches of three bytes.
SEGMENT, COUNTED, LEVEL = 24, 6, 13
#: Bits of the compressors' tables, which hold the dictionaries whole; the level's own are for texts of megabytes.
TABLES = 18
#: A 5-gram is distinctive in this share of the toxic documents or more (and in three), if its document frequency is higher by so many deviations and times.
SHARE, DEVIATIONS, RATIO, SEED = 0.025, 5.0, 4.0, 19
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8)
#: Begins each window, so that a block of a few bytes compresses at all, and ends the dictionaries, whose last bytes are not indexed.
LEAD = b" the of and to in for is on that by this with you it "


def normalised(text: str) -> str:
    return f" {' '.join(text.lower().split())} "


def windows(text: str, words: int = WINDOW_WORDS) -> list[bytes]:
    """Consecutive windows over the whole text, with a blank at both ends; one of a blank for an empty text.

    A word of any length is whole in one window.
    """
    w = text.lower().split()
    return [f" {' '.join(w[i : i + words])} ".encode("utf-8", "surrogatepass") for i in range(0, len(w), words)] or [b" "]


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...] = ()
    #: Classes with too little text for the trainer, whose dictionaries are the text itself or empty.
    untrained: tuple[str, ...] = ()


@lru_cache(maxsize=4)
def _compressors(toxic: bytes, ordinary: bytes) -> list[zstandard.ZstdCompressor]:
    made = []
    for content in (ordinary + bytes(len(toxic)) + LEAD, ordinary + toxic + LEAD):
        size = {"write_content_size": 0, "write_checksum": 0, "write_dict_id": 0, "window_log": TABLES, "chain_log": TABLES, "hash_log": TABLES}
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, **size)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
    return made


def differences(text: str, model: Model) -> np.ndarray:
    """Bytes by which the toxic dictionary shortens each window."""
    plain, toxic = (c.compress for c in _compressors(model.toxic, model.ordinary))
    return np.array([len(plain(w)) - len(toxic(w)) for w in (LEAD + w for w in windows(text))])


def features(text: str, model: Model) -> list[float]:
    d = differences(text, model)
    counts = [(d >= t).sum() for t in THRESHOLDS]
    return [float(d.max()), math.log1p(max(0, int(d.sum()))), *map(float, np.log1p(counts)), math.log(len(d)), *(float(c / len(d)) for c in counts[1::2]), 1.0]


def _grams(text: str) -> set[str]:
    t = normalised(text)
    return {t[i : i + GRAM] for i in range(len(t) - GRAM + 1)}


def distinctive(sample: DataFrame, toxic: int, ordinary: int) -> set[str]:
    """5-grams of significantly more toxic documents; counted by Spark."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for label, part in b.groupby("label"):
                c = Counter()
                for t in part["text"]:
                    c.update(_grams(t or ""))
                yield pd.DataFrame({"gram": list(c), "a": [v * label for v in c.values()], "b": [v * (1 - label) for v in c.values()]})

    counts = sample.select("label", "text").mapInPandas(count, "gram string, a long, b long").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    p = (F.col("a") + F.col("b")) / (toxic + ordinary)
    lift = F.col("a") / toxic - F.col("b") / ordinary
    noise = F.sqrt(p * (1 - p) * (1 / toxic + 1 / ordinary)) + 1e-9
    hot = counts.where((F.col("a") >= max(3.0, SHARE * toxic)) & (lift > DEVIATIONS * noise) & (F.col("a") / toxic > RATIO * (F.col("b") + 0.5) / ordinary))
    return {r["gram"] for r in hot.select("gram").collect()}  # of SAMPLE toxic documents at most


#: The first bytes of a dictionary in zstandard's format.
MAGIC = bytes.fromhex("37a430ec")


def trained(samples: list[bytes], size: int) -> bytes:
    """zstandard's dictionary, which begins with MAGIC; too little text for its trainer is taken as it is."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=COUNTED, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, x.T @ (p - y) + ridge * w), -5, 5)
    return w


def sampled(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """label, part (0: dictionaries, two thirds; 1: calibration) and text of at most ``size`` documents a class.

    The ids of the sample are bounded by ``size``, so the join can broadcast them. A row of ``labels`` or ``docs``
    that occurs twice counts twice; a null or empty text is a document without words.
    """
    known = labels.where(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label"))
    picks = [known.where(F.col("label") == k).orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(size) for k in (0, 1)]
    ids = picks[0].unionByName(picks[1]).withColumn("part", (F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(3)) == 2).cast("int"))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("label", "part", "text")


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Labels have doc_id and label. Without toxic or ordinary rows every score is that of the prior.

    A class with too little text for the trainer is named in the model's ``untrained`` and in a warning: scores then rest on the
    raw text, or where it is empty on the length alone.
    """
    sample = materialise(sampled(docs, labels, size), "toxicity")
    made = sample.where("part = 0")
    n = {r["label"]: r["count"] for r in made.groupBy("label").count().collect()}
    hot = distinctive(made, n[1], n[0]) if n.get(1) and n.get(0) else set()

    def toxic_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = Counter(w for t in b["text"] for w in (f" {w} " for w in (t or "").lower().split()) if any(w[i : i + GRAM] in hot for i in range(len(w) - GRAM + 1)))
            yield pd.DataFrame({"word": list(c), "n": list(c.values())})

    def ordinary_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"window": [w for t in b["text"] for w in windows(t or "")]})

    words = made.where("label = 1").select("text").mapInPandas(toxic_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")) if hot else None
    found = [w for r in words.orderBy("word").collect() for w in [r["word"].encode("utf-8", "surrogatepass")] * r["n"]] if hot else []
    found = [found[k] for k in np.random.default_rng(SEED).permutation(len(found))]  # the trainer takes a segment of each stretch
    plain = made.where("label = 0").select("text").mapInPandas(ordinary_windows, "window binary")
    plain = [bytes(r["window"]) for r in plain.orderBy(F.xxhash64("window"), "window").limit(ORDINARY_WINDOWS).collect()]
    dictionaries = {"toxic": trained(found, TOXIC_BYTES), "ordinary": trained(plain, ORDINARY_BYTES)}
    untrained = tuple(k for k, d in dictionaries.items() if not d.startswith(MAGIC))
    if untrained:
        warnings.warn(f"too little text to train a dictionary for: {', '.join(untrained)}", stacklevel=2)
    model = Model(dictionaries["toxic"], dictionaries["ordinary"])
    seen = sample.where("part = 1").select("label", F.pandas_udf(lambda s: pd.Series([features(t or "", model) for t in s]), "array<double>")("text").alias("x")).collect()
    x, y = np.array([r["x"] for r in seen]), np.array([r["label"] for r in seen])
    weights = tuple(logistic(x, y)) if len(seen) else (0.0,) * (len(features("", model)) - 1) + (-3.0,)
    return Model(model.toxic, model.ordinary, weights, untrained)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Adds ``name``, 0 to 1, over every window of the whole text; null text counts as empty, repeated rows score alike.

    Where ``docs`` has such a column the new one has underscores behind its name; an empty table gives an empty result.
    """
    weights = np.array(model.weights)

    def of(t: str | None) -> float:
        return float(sigmoid(np.dot(features(t or "", model), weights)))

    # rows and not Arrow: a batch of whole texts would be held several times over, in the worker and outside the JVM's heap
    return docs.withColumn(*free_names(docs.columns, name), F.udf(of, "double", useArrow=False)(F.col(text)))


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; rows of remainder 2 are held out of training."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_of_id(F.col("doc_id")) % 4 == 2
    model = train(docs, toxic_labels(spark, sf_dir).where(~held))
    out = score(docs, model).select("doc_id", held.alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
