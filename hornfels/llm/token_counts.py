"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair merges.

The last token of a prefix's encoding is the one token that ends there and that the merges leave beside the
last token of the rest. So counts and last tokens of all prefixes follow from left to right without encoding
anything twice: ``count[j] = count[i] + 1`` for that token [i, j). A text falls into units at blanks between
words, across which no token reaches; a unit's counts are kept as differences from one character to the
next, in a cache of bounded size, and a text's prefix counts are the running sum of its units' differences.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornfels.llm.common import read_table, restored, small_batches, stashed
from hornfels.storage import materialise

#: Entries of the caches of a Python worker and their longest unit: a bound of its memory; other units are computed anew.
UNITS, PAIRS, LONG = 500_000, 400_000, 64
LIMIT = 1024
#: Punctuation that is a piece of its own after letters: ASCII's but for the apostrophe.
MARKS = string.punctuation.replace("'", "")
CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class PrefixCounter:
    """Prefix counts for a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_symbols()
        as_bytes = lambda s: bytes(of[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(merges)}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.longest = max(map(len, vocab))
        self.vocab = vocab
        self.pairs: dict[int, bool] = {}
        self.units: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.pieces = regex.compile(public_tokenizers.PATTERN)

    def encode(self, data: bytes) -> list[bytes]:
        """Plain merging, lowest rank first; only for pairs of tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 30) for p in zip(parts, parts[1:], strict=False)]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == 1 << 30:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _stay(self, a: bytes, b: bytes) -> bool:
        return self.encode(a + b) == ([a, b] if a else [b])

    def prefixes(self, data: bytes) -> list[int]:
        """Token counts of data[:0], data[:1], ...; data holds no boundary of the splitting pattern."""
        return self._extend(data, [0], [b""], [len(self.vocab)])

    def _extend(self, data: bytes, count: list[int], last: list[bytes], ident: list[int]) -> list[int]:
        """Carries on counts and last tokens from data[: len(count) - 1] to all of data, in place."""
        vocab, pairs, longest = self.vocab.get, self.pairs, self.longest
        for j in range(len(count), len(data) + 1):
            for i in range(max(0, j - longest), j):
                t = vocab(data[i:j])
                if t is None:
                    continue
                key = ident[i] << 20 | t
                ok = pairs.get(key)
                if ok is None:
                    ok = self._stay(last[i], data[i:j])
                    if len(pairs) < PAIRS:
                        pairs[key] = ok
                if ok:
                    count.append(count[i] + 1)
                    last.append(data[i:j])
                    ident.append(t)
                    break
            else:
                raise ValueError(f"no token ends at byte {j} of {data!r}")
        return count

    def _learn(self, words: set[str], lead: str) -> dict[str, bytes]:
        """Steps of unknown words after ``lead``, a blank or nothing. Sorted words carry on from what they share with the one before."""
        stems: dict[bytes, bytes] = {}
        plain = {w: stem for w in words if (stem := w.rstrip(MARKS)).isalpha()}
        count, last, ident, before = [0], [b""], [len(self.vocab)], b""
        for data in sorted({f"{lead}{stem}".encode() for stem in plain.values()}):
            k, top = 0, min(len(before), len(data))
            while k < top and before[k] == data[k]:
                k += 1
            del count[k + 1 :], last[k + 1 :], ident[k + 1 :]
            counts = self._extend(data, count, last, ident)
            before = data
            if not data.isascii():  # keep what the last byte of each character has
                counts = [0, *(c for c, b in zip(counts[1:], [*data[1:], 0], strict=True) if b & 0xC0 != 0x80)]
            stems[data] = bytes([(b - a) & 255 for a, b in zip(counts, counts[1:], strict=False)])
        made = {}
        for w in words:
            stem = plain.get(w)
            if stem is None:
                made[w] = self._steps(f"{lead}{w}")
            else:
                made[w] = stems[f"{lead}{stem}".encode()] + (self._mark(w[len(stem) :]) if len(w) > len(stem) else b"")
        return made

    def _mark(self, marks: str) -> bytes:
        """Steps of marks after letters, which are a piece of their own."""
        made = self.marks.get(marks)
        if made is None:
            made = self._steps(marks)
            if len(self.marks) < UNITS // 10:
                self.marks[marks] = made
        return made

    def _chars(self, piece: str) -> list[int]:
        """Counts after each character of a piece of the splitting pattern."""
        if piece in CONTRACTIONS:  # until its last letter comes it is two pieces
            return [1, 1 + self._chars(piece[1])[0], self.prefixes(piece.encode())[-1]]
        data = piece.encode("utf-8")
        counts = self.prefixes(data)
        if len(data) == len(piece):
            return counts[1:]
        return [counts[e] for e in np.cumsum([len(c.encode("utf-8")) for c in piece])]

    def _plain(self, text: str) -> list[int]:
        """Counts after each character of a text without special tokens."""
        out: list[int] = []
        done, lead = 0, ""
        for m in _RUNS.finditer(text):
            run = m[0]
            if m[1]:
                out += [done + c for c in self._chars(run)]  # the run is one piece as long as nothing follows
                if len(run) > 1:
                    done += self._chars(run[:-1])[-1]
                lead = " " if run[-1] == " " else ""
                done += 0 if lead else self._chars(run[-1])[-1]
                continue
            skip = len(lead)
            for p in self.pieces.findall(lead + run):
                counts = self._chars(p)
                out += [done + c for c in counts[skip:]]
                done, skip = done + counts[-1], 0
            lead = ""
        return out

    def unit(self, text: str) -> list[int]:
        """Counts after each character of any text; a special token counts one once it is complete."""
        if not self.special or not self.special.search(text):
            return self._plain(text)
        out, done, at = [], 0, 0
        for m in self.special.finditer(text):
            counts = self._plain(text[at : m.end()])
            before = counts[m.start() - at - 1] if m.start() > at else 0
            out += [done + c for c in counts[:-1]] + [done + before + 1]
            done, at = done + before + 1, m.end()
        return out + [done + c for c in self._plain(text[at:])]

    def _steps(self, unit: str) -> bytes:
        counts = self.unit(unit)
        return bytes([(b - a) & 255 for a, b in zip([0, *counts], counts, strict=False)])

    def steps_of(self, texts: list[str]) -> list[bytes]:
        """For each text an int8 for each character: by how much the count of the prefix that ends with it differs from the one before.

        Where white space is single, a new line is a token and the word after it has no blank.
        """
        head, unit = self.heads.get, self.units.get
        out: list[list[list[bytes | None]]] = []
        gaps = []  # of lines that have unknown words
        for t in texts:
            lines = []
            for x in ([_SAFE.split(t)] if _ODD.search(t) else [x.split(" ") for x in t.split("\n")]) if t else []:
                got = [head(x[0]), *map(unit, x[1:])]
                lines.append(got)
                if None in got:
                    gaps.append((x, got))
            out.append(lines)
        new_heads = self._learn({x[0] for x, got in gaps if got[0] is None}, "")
        new_units = self._learn({w for x, got in gaps for w, g in zip(x[1:], got[1:], strict=True) if g is None}, " ")
        for x, got in gaps:
            got[:] = [got[0] or new_heads[x[0]], *(g or new_units[w] for w, g in zip(x[1:], got[1:], strict=True))]
        for known, new in ((self.heads, new_heads), (self.units, new_units)):
            room = UNITS - len(self.heads) - len(self.units)
            known.update([(w, made) for w, made in new.items() if len(w) <= LONG][: max(0, room)])
        return [b"\1".join(map(b"".join, lines)) for lines in out]

    def steps(self, text: str) -> bytes:
        return self.steps_of([text])[0]

    def forget(self) -> None:
        """Empties the caches of units at the end of a task; which tokens stay beside which serves the worker's next task."""
        self.units.clear()
        self.heads.clear()

    def counts(self, text: str) -> np.ndarray:
        """Exact token counts of text[:1], text[:2], ..., text."""
        return np.cumsum(np.frombuffer(self.steps(text), np.int8), dtype=np.int64)


#: White space beside white space or at an end of the text; and blanks between other characters.
_ODD, _SAFE = re.compile(r"\s\s|\A\s|\s\Z"), re.compile(r"(?<=\S) (?=\S)")


_RUNS = regex.compile(r"(\s+)|\S+")


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_count(steps: bytes, chars: int | None = None) -> int:
    """Tokens of the first ``chars`` characters (all by default)."""
    return int(np.frombuffer(steps, np.int8)[:chars].sum(dtype=np.int64))


def longest_prefix(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def in_parts(texts: pd.Series, chars: int = 2_000_000) -> Iterator[list[str]]:
    """The texts, null as empty, in lists of about so many characters; a longer text is a list of its own."""
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def _by_steps(path: str, of: Callable[[list[bytes]], list], kind: str) -> Callable[[Column], Column]:
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(path)
        try:
            for s in batches:
                yield pd.Series([x for part in in_parts(s) for x in of(own.steps_of(part))], dtype="int64" if kind == "long" else object)
        finally:
            own.forget()

    return F.pandas_udf(work, kind)


def prefix_table(docs: DataFrame, *keep: str, path: str, text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``steps`` (see PrefixCounter.steps_of), a byte a character; null text counts as empty.

    A row each, repeats included; ``steps`` has an underscore behind it where ``keep`` has that name.
    """
    return restored(docs.select(*stashed(keep), _by_steps(path, list, "binary")(F.col(text)).alias("steps")), keep, "steps")


def truncated(docs: DataFrame, budget: int, path: str, text: str = "text") -> DataFrame:
    """``docs`` with each text cut to its longest prefix of at most ``budget`` tokens; null stays null, other columns stay.

    Equal rows are cut alike; an empty table gives an empty result.
    """
    cut = F.pandas_udf(lambda s: pd.Series([t if t is None else t[: longest_prefix(counter(path).steps(t), budget)] for t in s]), "string")
    return docs.withColumn(text, cut(F.col(text)))


def with_token_counts(docs: DataFrame, *keep: str, path: str, text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``n_tokens`` of the whole text, the last of its prefix counts; null text has none.

    A row each, repeats included; ``n_tokens`` has an underscore behind it where ``keep`` has that name.
    """
    of = _by_steps(path, lambda steps: [token_count(x) for x in steps], "long")
    return restored(docs.select(*stashed(keep), of(F.col(text)).alias("n_tokens")), keep, "n_tokens")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    with small_batches(spark):
        out = materialise(with_token_counts(docs.withColumn("n_bytes", size), "doc_id", "n_bytes", path=public_tokenizers.path("byte_bpe_50k.json")), "counts")
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
