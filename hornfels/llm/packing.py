"""Mixture-controlled packing: deficit round-robin over source queues fills windows of fixed length.

Each source is a queue of token ids: its documents, in a hashed order, end to end. A round adds every
queue's quantum, its share of a window, to the queue's deficit; the queue sends the whole tokens of its
deficit and carries the fraction on. Windows are cut from the rounds laid end to end, so every window is
full and has the target proportions to within a token or two a source; when a queue is empty the others go
on in their proportions. As a token is the smallest packet, the deficit after any number of rounds has a
closed form: ``sent(r) = min(total, r * quantum)``. So a task places its documents from the queues' totals
alone, at any point of the stream: deficits carry over windows and partitions without a pass from one to the
next, and no queue or window is ever gathered in one place.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hornfels.llm.common import bucket_bases, crc, free_names, hash_bucket, key_of, n_buckets, read_table, small_batches, stashed
from hornfels.llm.token_counts import in_parts
from hornfels.storage import materialise

LENGTH, END_ID, SEED = 4096, 2, 29
#: Sources with a queue of their own, largest first, and queues that the others share by hash, in a round-robin of each one's own.
QUEUES, SHARED = 256, 64
#: A quantum is a whole number of these parts of a token.
PARTS = 16
#: The same between the sources of a shared queue, whose rounds are of one token.
FINE = 24
#: Entries of the cache of a Python worker and their longest piece: a bound of its memory.
PIECES, LONG = 400_000, 64
#: What stands between pieces that are encoded together, and how many are.
BETWEEN, JOINED = "\x01", 500
#: Text that the vocabulary's normaliser only lower-cases, character by character: Latin letters, common marks and blanks.
_EASY = re.compile("[\t\n\r -~\u00a1-\u012f\u0131-\u017f\u2010-\u2027\u20ac]*").fullmatch
#: The vocabulary's own splitting rule on such text in lower case.
_LETTERS, _NUMBERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+").findall


class PieceEncoder:
    """Ids of a vocabulary that drops white space, as little-endian 16-bit bytes, piece by piece.

    The library encodes each piece that is not in the cache, and whole lines that hold other characters than
    the splitting rule here is written for.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.pieces: dict[str, bytes] = {}
        ids = self.library.encode(f" {BETWEEN} ", add_special_tokens=False).ids
        if len(ids) != 1:
            raise ValueError(f"{BETWEEN!r} has the ids {ids} in {path}")
        self.between = ids[0]

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        """The library's ids of each piece; pieces are encoded in long texts."""
        texts = [f" {BETWEEN} ".join(pieces[k : k + JOINED]) + f" {BETWEEN}" for k in range(0, len(pieces), JOINED)]
        made = {}
        for k, e in enumerate(self.library.encode_batch_fast(texts, add_special_tokens=False)):
            ids = array("H", e.ids)
            ends = np.flatnonzero(np.frombuffer(ids, np.uint16) == self.between).tolist()
            for p, start, end in zip(pieces[k * JOINED : (k + 1) * JOINED], [0, *(x + 1 for x in ends[:-1])], ends, strict=True):
                made[p] = ids[start:end].tobytes()
        return made

    def ids_of(self, texts: list[str]) -> list[bytes]:
        known = self.pieces
        parts = [_SPLIT(t.lower()) if _EASY(t) and "<|" not in t else None for t in texts]
        new = [p for p in set(chain.from_iterable(x for x in parts if x is not None)) if p not in known]
        room = max(0, PIECES - len(known))
        known.update(self._encode(new))
        get = known.__getitem__
        out = [b"".join(map(get, x)) if x is not None else b"" for x in parts]
        for k, p in enumerate(new):
            if k >= room or len(p) > LONG:
                del known[p]
        for k, t in enumerate(texts):
            if parts[k] is None:
                lines = t.split("\n")
                hard = [x for x in lines if not _EASY(x) or "<|" in x]
                found = dict(zip(hard, (array("H", e.ids).tobytes() for e in self.library.encode_batch_fast(hard, add_special_tokens=False)), strict=True))
                easy = [x for x in lines if x not in found]
                found.update(zip(easy, self.ids_of(easy), strict=True))
                out[k] = b"".join(map(found.__getitem__, lines))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def with_ids(docs: DataFrame, path: str, text: str = "text", end_id: int = END_ID) -> DataFrame:
    """``docs`` without the text, with ``ids``: 16-bit ids of the whole text and the end id. Null text is empty."""
    end = np.array([end_id], "<u2").tobytes()

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for s in batches:
            yield pd.Series([x + end for part in in_parts(s) for x in own.ids_of(part)], dtype=object)

    return docs.withColumn("ids", F.pandas_udf(work, "binary")(F.col(text))).drop(text)


class RoundRobin:
    """Deficit round-robin over queues of known totals (in their order), with weights that say the proportions."""

    def __init__(self, totals: list[int], weights: list[float] | None = None, length: int = LENGTH, parts: int = PARTS):
        self.parts = parts
        self.totals = np.array(totals, np.int64)
        w = np.array(totals if weights is None else weights, float)
        share = w / max(w.sum(), 1e-300)
        self.quantum = np.maximum(1, np.ceil(share * (length << parts))).astype(np.int64)
        self.length = length

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue has sent before each of ``rounds``; (rounds, queues)."""
        return np.minimum(self.totals, (rounds[:, None] * self.quantum) >> self.parts)

    def deficit(self, rounds: np.ndarray) -> np.ndarray:
        """What each queue that is not empty carries into each round, in tokens; always below one."""
        due = rounds[:, None] * self.quantum
        return np.where(due >> self.parts < self.totals, (due & ((1 << self.parts) - 1)) / (1 << self.parts), 0.0)

    def pieces(self, queue: int, start: int, tokens: int) -> Iterator[tuple[int, int, int]]:
        """(first token, tokens, place in the stream) of the pieces of a queue's tokens [start, start + tokens)."""
        q = int(self.quantum[queue])
        first, last = (((start + 1) << self.parts) - 1) // q, (((start + tokens) << self.parts) - 1) // q
        at, end = start, start + tokens
        step = max(1, min(4096, (1 << 20) // len(self.totals)))
        if q >= 1 << self.parts:
            rounds = range(first, last + 1)
        else:  # only those in which the queue sends a token
            rounds = ((np.arange(start + 1, end + 1) << self.parts) - 1) // q
        for block in range(0, len(rounds), step):
            of = np.asarray(rounds[block : block + step], np.int64)
            then, sent = self.sent(of), self.sent(of + 1)
            before = sent[:, :queue].sum(1) + then[:, queue + 1 :].sum(1)
            for k, base in enumerate(before.tolist()):
                stop = min(end, int(sent[k, queue]))
                while at < stop:
                    place = base + at
                    n = min(stop - at, self.length - place % self.length)
                    yield at - start, n, place
                    at += n


_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, *keep: str, path: str, source: str = "source", text: str = "text", weights: dict[str, float] | None = None, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """The ``keep`` columns and a row for each piece: its place in its document and in its sequence.

    ``weights`` names target proportions of sources (null's key is "n", others "s" and the name); by default
    they are the sources' own tokens, so that all queues end together. Every row of ``docs``, repeated ones
    too, is packed whole; an empty or null text is its end id. An empty table gives no pieces. Only the last
    sequence can be short. A new column has underscores behind its name where ``keep`` has it.
    """
    held = [f"_keep{i}" for i in range(len(keep))]
    rows = docs.select(*stashed(keep), key_of(source).alias("_queue"), F.col(text).alias("_text"))
    with small_batches(docs.sparkSession):
        tokens = materialise(with_ids(rows, path, "_text").withColumn("_row", F.monotonically_increasing_id()), "tokens")
    sizes = tokens.select(*held, "_row", "_queue", (F.octet_length("ids") / 2).cast("long").alias("n"))
    large = [r[0] for r in sizes.groupBy("_queue").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "_queue").limit(QUEUES).collect()]
    buckets = n_buckets(sizes.count())
    sizes = sizes.withColumn("_hash", F.xxhash64(F.lit(seed), *held))
    sizes = sizes.withColumn("_bucket", hash_bucket(F.col("_hash"), buckets))
    sums = materialise(sizes.groupBy("_queue", "_bucket").agg(F.sum("n").alias("n")), "queues")
    own = F.col("_queue").isin(large)
    shared: Column = F.when(~own, F.concat(F.lit("o"), F.pmod(F.xxhash64("_queue"), F.lit(SHARED)).cast("string")))
    weight = F.udf(lambda q: float(weights.get(q, 0.0)), "double")("_queue") if weights else F.col("n").cast("double")
    sources = sums.groupBy("_queue").agg(F.sum("n").alias("n")).select("_queue", shared.alias("_shared"), "n", weight.alias("w"))
    sources = materialise(sources, "sources")
    top = sources.groupBy(F.coalesce("_shared", "_queue").alias("q")).agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect()  # QUEUES + SHARED rows at most
    top = {r["q"]: r for r in top}
    names = sorted(top)
    robin = RoundRobin([top[q]["n"] for q in names], [top[q]["w"] for q in names] if weights else None, length)
    number = {q: k for k, q in enumerate(names)}
    # a shared queue's sources in order, beside each of them
    listed = sources.where("_shared is not null").groupBy("_shared").agg(F.sort_array(F.collect_list(F.struct("_queue", "n", "w"))).alias("l"))
    own = listed.select(F.posexplode("l._queue").alias("_k", "_queue"))
    inner = sources.select("_queue", "_shared").join(own, "_queue", "left")
    lists = listed.select("_shared", F.col("l.n").alias("_totals"), F.col("l.w").alias("_weights"))
    within = Window.partitionBy("_queue", "_bucket").orderBy("_hash", "n", "_row").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_own", F.coalesce(F.sum("n").over(within), F.lit(0))).join(bucket_bases(sums, ["_queue"], "_bucket", "n", buckets), ["_queue", "_bucket"])
    offsets = offsets.select("_row", (F.col("_own") + F.col("base")).alias("_at"))
    placed = tokens.join(offsets.hint("shuffle_hash"), "_row").join(inner, "_queue").join(lists, "_shared", "left")

    def spread(name: str, at: int, n: int, second: RoundRobin | None, k: int) -> Iterator[tuple[int, int, int]]:
        if second is None:
            yield from robin.pieces(number[name], at, n)
            return
        last: tuple[int, int, int] | None = None
        for start, m, there in second.pieces(k, at, n):
            for begin, size, place in robin.pieces(number[name], there, m):
                if last and last[2] + last[1] == place and place % length:
                    last = (last[0], last[1] + size, last[2])
                    continue
                if last:
                    yield last
                last = (start + begin, size, place)
        if last:
            yield last

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seconds: dict[str, RoundRobin] = {}
        for b in batches:
            out, which = [], []
            for k, (name, tail, at, ids, i, totals, shares) in enumerate(zip(*[b[c] for c in ("_queue", "_shared", "_at", "ids", "_k", "_totals", "_weights")], strict=True)):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                tail = tail if isinstance(tail, str) else None
                if tail is not None and tail not in seconds:
                    seconds[tail] = RoundRobin(list(totals), list(shares), 1, FINE)
                second = None if tail is None else seconds[tail]
                for start, n, place in spread(tail or name, int(at), len(wide), second, 0 if tail is None else int(i)):
                    out.append((start, n, crc(wide[start : start + n].tobytes()), len(wide), place // length, place % length))
                    which.append(k)
            pieces = pd.DataFrame(out, columns=["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], dtype="int64")
            yield pd.concat([b[held].iloc[which].reset_index(drop=True), pieces], axis=1)

    kept = "".join(f"{h} {tokens.schema[h].dataType.simpleString()}, " for h in held)
    found = placed.select(*held, "_queue", "_shared", "_at", "ids", "_k", "_totals", "_weights").mapInPandas(cut, f"{kept}{_PIECES}")
    with small_batches(docs.sparkSession):
        found = materialise(found, "pieces")
    return found.toDF(*keep, *free_names(keep, *found.columns[len(keep) :]))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return pack(docs, "doc_id", path=public_tokenizers.path("word_bpe_49k.json"))
