"""Edit fingerprints: the walk, successions and groups against loops."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hornfels.llm import edit_prints as P

SCHEMA = "doc_id long, text string"
WORDS = "quartz lime basalt gneiss schist marble slate chalk granite flint".split()


def edited_copy(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.4:
            out[at] = rng.choice("xyz")
        elif kind < 0.7:
            out.insert(at, "q")
        else:
            del out[at]
    return "".join(out)


def texts():
    """Long and short texts, copies with a few edits, equal texts, empty and null ones, characters of four bytes."""
    rng = random.Random(2)
    made = [" ".join(rng.choice(WORDS) + str(rng.randrange(100)) for _ in range(rng.choice([3, 40, 400]))) for _ in range(30)]
    made += [edited_copy(rng, t, 2) for t in made[:20] if len(t) > 200] + [made[0], "", None, "a", "ab", "ä日😀x", " \n", ""]
    return made


def test_the_walk_is_step_by_step():
    """Against a pointer that moves by the shared bits, one step after the other."""
    bits = np.random.default_rng(P.SEED).integers(0, 2, (P.CLASSES, P.PERIOD), dtype=np.int8)
    text = "abc 日本 xyz " * 700
    points = P.characters(text)
    stays, behind = P.walk(points)
    at, step, out = 0, 0, []
    kinds = ((points.astype(np.uint64) * P._GOLD) >> np.uint64(56)).tolist()
    while at < len(points):
        out.append(at)
        at += int(bits[kinds[at], step % P.PERIOD])
        step += 1
    assert np.repeat(np.arange(len(points)), stays).tolist() == out and int(behind[-1]) == step % P.PERIOD
    split = 777
    rest, _ = P.walk(points[split:], int(behind[split - 1]))
    assert np.concatenate((stays[:split], rest)).tolist() == stays.tolist()


def test_samples_do_not_depend_on_pieces(monkeypatch):
    points = P.characters(" ".join(map(str, range(3000))))
    stays, _ = P.walk(points)
    whole = P.sampled(points, stays)
    monkeypatch.setattr(P, "PIECE", 100)
    assert P.sampled(points, stays) == whole and len(whole) == P.SAMPLES and 0 not in whole


def test_likeness_follows_the_edits():
    rng = random.Random(3)
    text = " ".join(rng.choice(WORDS) for _ in range(3000))
    own = P.Text(text).print
    few, other = P.Text(edited_copy(rng, text, 5)).print, P.Text(" ".join(rng.choice(WORDS) for _ in range(3000))).print
    assert P.likeness(own, own) == 1 and P.likeness(own, few) > 0.8 and P.likeness(own, other) < 0.3


def brute_groups(prints, ids):
    """The least id that links of four in five samples reach."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if sum(a == b for a, b in zip(prints[i], prints[j], strict=True)) >= 0.8 * P.SAMPLES:
                root[find(i)] = find(j)
    groups = {}
    for i, k in enumerate(ids):
        groups.setdefault(find(i), []).append(k)
    return [min((k for k in groups[find(i)] if k is not None), default=None) for i in range(len(ids))]


def test_the_query_is_that_of_a_loop(spark, tmp_path):
    rows = [(k if k != 11 else None, t) for k, t in enumerate(texts())]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumns({c: F.lit("x") for c in ("fingerprint", "near_id", "edge", "part")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in P.op13_document_fingerprints(spark, str(tmp_path)).collect()}
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    assert got.keys() == {i for i, _ in rows}
    near = brute_groups([P.Text(t).print for _, t in rows], [i for i, _ in rows])
    assert len(set(near)) < len(rows) - 8
    for at, (i, t) in enumerate(rows):
        text, after = t or "", rows[(at + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.near_id) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), near[at])
        own, its, other = (P.Text(x).print for x in (text, edited, after))
        assert (r.fingerprint, r.edited_fingerprint) == (own.hex(), its.hex())
        assert (r.near_edited, r.near_next) == (P.likeness(own, its), P.likeness(own, other))


@pytest.mark.parametrize("rows", [[], [(5, "alone here")], [(None, None), (None, "a"), (2, "b"), (2, "b"), (2, "c")]])
def test_few_rows_ties_and_none(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = P.grouped(P.successions(docs)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))


def test_a_large_group_and_columns_that_clash(spark):
    """Near copies of one text, some just below the bound, and texts of their own; a row each, columns kept."""
    rng = random.Random(8)
    base = " ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(60))
    copies = [edited_copy(rng, base, rng.choice([1, 2, 6])) for _ in range(120)] + [" ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(50)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(copies)), SCHEMA).repartition(4).withColumn("near_id", F.lit("kept"))
    got = P.grouped(P.fingerprints(docs)).orderBy("doc_id").collect()
    assert {r.near_id for r in got} == {"kept"} and got[0].__fields__[-1] == "near_id_"
    assert [r.near_id_ for r in got] == brute_groups([P.Text(t).print for t in copies], range(len(copies)))
