"""Queries and edges held against brute force: planted secrets, stored files, the discriminant, and columns that clash."""

import hashlib
import random
import string
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from hornfels.llm import media, mixing, packing, quality_classifier, queries, secrets, sharding, simhash, token_counts, toxicity

WORDS = path("word_bpe_49k.json")


def folder_of(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_discriminant_against_numpy():
    rng = np.random.default_rng(2)
    x = [rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5)), rng.normal(size=(60, 5)) + 0.5]
    n, total, square = np.array([80.0, 60.0]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x])
    model = quality_classifier.fit_discriminant(n, total, square, 0.2, 0.1)
    own = [np.cov(a.T, bias=True) for a in x]
    within = (80 * own[0] + 60 * own[1]) / 140
    logs = []
    points = rng.normal(size=(30, 5))
    for k in range(2):
        c = 0.8 * own[k] + 0.2 * within
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-6 * np.eye(5)
        d = points - x[k].mean(0)
        logs.append(np.log((n[k] + 1) / 142) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(model.difference(points), logs[1] - logs[0])


def test_secrets_planted_into_documents(spark, tmp_path):
    """Keys in texts that the generator never saw: all are found where they stand, and ordinary words are none."""
    rng = random.Random(11)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    alnum = string.ascii_letters + string.digits
    rows, planted = [], set()
    for k in range(120):
        words = ["".join(rng.choice(["ta", "ri", "on", "ke", "lu", "st", "er"]) for _ in range(rng.randint(1, 4))) for _ in range(40)]
        if k % 3 == 0:
            kind, key = rng.choice([("aws_access_key", "AKIA" + pick(string.ascii_uppercase + string.digits, 16)), ("github_token", "ghp_" + pick(alnum, 36)), ("google_api_key", "AIza" + pick(alnum, 35))])
            at = rng.randrange(len(words))
            text = " ".join([*words[:at], key, *words[at:]])
            planted.add((k, text.index(key), len(key)))
        else:
            text = " ".join(words)
        rows.append((k, text, "en", f"src{k % 4}", len(text)))
    out = queries.QUERIES["op2_secret_scans"](spark, folder_of(spark, tmp_path, rows)).where("is_secret").collect()
    found = {(r.doc_id, r.start, r.length) for r in out}
    assert len(found & planted) >= 0.97 * len(planted) and len(found - planted) <= 1
    texts = {k: t for k, t, *_ in rows}
    assert all(r.secret_crc32 == zlib.crc32(texts[r.doc_id][r.start : r.start + r.length].encode()) for r in out)


def test_media_query_reads_back_what_was_stored(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", "a", "x" * 191, "y" * 192, "ä日😀 " * 60, "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(3000)), "a"]
    folder = folder_of(spark, tmp_path, [(k, t, "en", "s", 0) for k, t in enumerate(texts)])
    got = {r.doc_id: r for r in queries.QUERIES["op3_media_columns"](spark, folder).collect()}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        full = data + b" " * (-len(data) % 192 if data else 192)
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].payload_sha256) == (len(data), len(full), hashlib.sha256(full).hexdigest())
        assert got[k].tail_crc32 == zlib.crc32(full[-16:]) and got[k].problem is None
        (file,) = media.write_files([full])
        assert (got[k].media_bytes, got[k].media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    assert got[2].feature == got[7].feature and got[2].media_sha256 == got[7].media_sha256


def test_bad_files_are_reported_alone(spark):
    (good,) = media.write_files([media.payload(b"some text")])
    files = [good, b"junk", b"", good[: len(good) // 2], None, good.replace(b"\xff\xc2", b"\xff\xc0"), good[:40] + bytes([255 - x for x in good[40:]])]
    rows = spark.createDataFrame(list(enumerate(files)), "k int, media binary")
    got = {r.k: r for r in media.tensors(rows).collect()}
    assert got[0].problem is None and len(got[0].tensor) == 3 * got[0].height * got[0].width
    assert all(got[k].tensor is None and got[k].problem for k in (1, 2, 5))
    assert got[4].tensor is None and got[4].problem is None
    assert all(got[k].problem or got[k].tensor for k in (3, 6))
    assert media.tensors(rows.where("k = 0"), most=10).first().problem == "ValueError: 64 pixels"


CLASH = ("fp", "root", "score", "size", "target", "copies", "source_size", "ids", "length", "start", "shard", "slot", "position", "steps", "n_tokens", "stats", "media", "tensor", "height", "problem", "kind", "key")


def test_clashing_columns_stay_as_they_are(spark):
    docs = spark.createDataFrame([(1, "one two three four token = 9885103314b39ed955fd8ac9efa74c6fd87b66ee", "a"), (2, None, None)], "doc_id long, text string, source string")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in CLASH})
    forest = secrets.train(secrets.generated_findings(spark, 200), WORDS)
    model = toxicity.Model(b" x ", b" and of ", (0.0,) * len(toxicity.features("", toxicity.Model(b"", b""))))
    keep = ("doc_id", *CLASH)
    outs = {
        "score": toxicity.score(docs, model), "shard": sharding.shard(docs), "media": media.with_media(docs), "mix": mixing.mix(docs, *keep), "simhash": simhash.near_duplicates(docs, *keep),
        "packing": packing.pack(docs, *keep, path=WORDS), "steps": token_counts.prefix_table(docs, *keep, path=path("byte_bpe_50k.json")), "tokens": token_counts.with_token_counts(docs, *keep, path=path("byte_bpe_50k.json")),
        "stats": quality_classifier.statistics(docs, "text", *keep), "scan": secrets.scan(docs, forest, WORDS, *keep), "redact": secrets.redact(docs, forest, WORDS),
        "tensors": media.tensors(media.with_media(docs, "file"), "file"), "digests": media.digests(media.with_media(docs, "file"), "file"),
    }
    for name, out in outs.items():
        assert len({c.lower() for c in out.columns}) == len(out.columns), name
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in CLASH), name


def test_the_session_keeps_its_batch_size(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    queries.QUERIES["op5_token_counts"](spark, "/root/testdata/sf0.001").count()
    assert spark.conf.get(key) == before


@pytest.mark.parametrize("rows", [0, 1, 50])
def test_interleaving_is_the_plain_sort(spark, rows):
    docs = spark.createDataFrame([(k, "ab c"[k % 4 : k % 4 + 1]) for k in range(rows)], "doc_id long, source string").repartition(3)
    got = sharding.interleaved(docs.withColumn("h", F.xxhash64(F.lit(sharding.SEED), "doc_id")), "source", ["doc_id"]).collect()
    ranked = []
    for s in {r.source for r in got}:
        own = sorted((r for r in got if r.source == s), key=lambda r: (r.h, r.doc_id))  # one bucket, whose hashes are signed
        ranked += [((2 * k + 1) / (2 * len(own)), s, k, r.doc_id) for k, r in enumerate(own)]
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == [x[3] for x in sorted(ranked)]
