"""The conversations' prefix trie against a loop over all prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hornfels.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(ts)] for c, ts in own.items()}
    said = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        said[c] = tuple(own.get(base, [])[:h] + ts[h:])
    nodes = {}
    for c, ts in said.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    out = set()
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].split()) for q in under if q)
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in nodes) for q in under)
        children = sum(len(q) == len(p) + 1 for q in under)
        ends = ",".join(map(str, sorted(c for c in members if len(said[c]) == len(p))))
        parent = min(nodes[p[:-1]]) if p else None
        out.add((min(members), len(p), parent, len(members), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations():
    """Families that share turns, equal and empty conversations, absent bases, ties, nulls, repeats and a long one."""
    rng = random.Random(7)
    rows = []
    for c in [*range(0, 45), *range(81, 99), -3, 7_000_000_001]:
        if rng.random() < 0.1:
            continue
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["hello there", "", None, "a b c", f"own {c}"])))
    rows += [(100, None, "user", "null turn"), (100, None, "bot", "another"), (100, 0, "user", "later"), (None, 0, "user", "nobody's")]
    rows += [(101, 0, "user", "same")] * 6 + [(120, t, "user", f"word {t}") for t in range(40)] + [(121, t, "user", f"word {t}") for t in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "hot"), [(P.BLOCK, P.HOT), (4, 3)])
def test_trie_is_that_of_a_loop(spark, monkeypatch, block, hot):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "HOT", hot)
    rows = conversations()
    table = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("x") for c in ("a", "b", "depth", "at", "words", "own")})
    got = P.conversation_trie(table).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == expected(rows)


def test_empty_tables_and_conversations_without_turns(spark):
    assert P.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert P.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(lone, 0, "user", "one two")]
    got = [tuple(r) for r in P.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())] and set(got) == expected(rows)


def test_digests_do_not_depend_on_batches():
    import pandas as pd

    rows = pd.DataFrame({"depth": [1, 1, 1, 2], "a": [5, 5, 5, 5], "b": [1, 1, 1, 1], "conv_id": [2, 9, 10, 2]})
    whole = pd.concat(P._digests(iter([rows])))
    single = pd.concat([p for p in P._digests(rows.iloc[k : k + 1] for k in range(4)) if len(p)])
    assert whole.to_numpy().tolist() == single.to_numpy().tolist()
    assert whole["ends_sha256"].tolist() == [hashlib.sha256(s).hexdigest() for s in (b"2,9,10", b"2")]
