"""The pipeline's stages against brute force on small fixtures."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hornfels.llm import resemblance, secrets, toxicity
from public_tokenizers import path

SCHEMA = "doc_id string, text string, lang string, source string, n_chars long"


def rows_of(spark, texts):
    return spark.createDataFrame([(f"d{k:03d}" if k != 5 else None, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], SCHEMA).repartition(3)


def near_copies():
    """Random texts, copies with one to seven words replaced, exact copies, short, empty and null texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(8):
        base = [word() for _ in range(rng.choice([40, 300]))]
        texts.append(" ".join(base))
        for n in (1, 2, 3, 4, 5, 6, 7):
            copy = list(base)
            for at in rng.sample(range(len(copy)), n):
                copy[at] = word()
            texts.append(" ".join(copy))
    return [*texts, texts[0], texts[8].upper(), "one two", "one  two", "", None, " "]


def brute_groups(texts):
    """The least index of each text's group, by all pairs of sets of five-word shingles."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return root


def test_near_duplicates_are_those_of_all_pairs(spark):
    texts = near_copies()
    docs, groups = rows_of(spark, texts), brute_groups(texts)
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    name = lambda k: f"d{k:03d}" if k != 5 else None
    least = {g: min((name(k) is None, name(k) or "") for k in range(len(texts)) if groups[k] == g) for g in groups}
    assert sorted((d is None, d or "") for d in kept) == sorted(least.values())
    assert len(kept) < len(texts) - 20


def test_groups_with_common_passages(spark, monkeypatch):
    """Texts that share a passage, in a group whose ends are not alike: no link is lost, whatever the order."""
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    chain = [f"w{k}" for k in range(200)]
    texts = [f"{passage} " + " ".join(str(rng.random()) for _ in range(rng.choice([3, 12, 60]))) for _ in range(30)]
    for k in range(12):
        chain = chain[3:] + [f"x{k}{j}" for j in range(3)]
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    groups = brute_groups(texts)
    docs = rows_of(spark, texts)
    for least in (2, 10**6):
        monkeypatch.setattr(resemblance.common_shingles, "__defaults__", (resemblance.SHINGLE, resemblance.SAMPLE, least))
        found = {r.text: r.root for r in resemblance.resembling(docs, "text").collect()}
        for i, a in enumerate(texts):
            for j, b in enumerate(texts[:i]):
                assert (found[a] == found[b]) == (groups[i] == groups[j])


def test_fingerprints_propose_pairs_of_the_stage(spark):
    """Each text meets the first of its fingerprint, each fingerprint one within two bits of it, and nothing else is proposed."""
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate([*near_copies()[:16], "", "a b c d e f", "a b c d e f e f"])], "t string, text string")
    sets = resemblance.entries(docs, 5, resemblance.SIMILAR)
    rows = {r.id: r for r in sets.collect() if r.n}
    for r in rows.values():
        bits = [sum(int(h) >> b & 1 for h in resemblance.shingles(r.text)) for b in range(64)]
        assert r.fp & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * bits[b] > r.n)
    differ = lambda a, b: bin((rows[a].fp ^ rows[b].fp) & (2**64 - 1)).count("1")
    pairs = [(r.u, r.v) for r in resemblance.fingerprint_pairs(sets).collect()]
    assert pairs and all(u < v and differ(u, v) <= 2 for u, v in pairs)
    met = {x for p in pairs for x in p}
    assert all((a in met) == any(differ(a, b) <= 2 for b in rows if b != a) for a in rows)


def test_prefixes_in_few_bits_lose_no_pair(spark):
    """Hashes that fall together in 16 bits count as shared."""
    text = " ".join(f"w{k}" for k in range(20_000))
    sets = resemblance.entries(spark.createDataFrame([("a", text), ("b", text + " end"), ("c", text[: len(text) // 2])], "t string, text string"), 5, resemblance.SIMILAR)
    ids = {r.t: r.id for r in sets.select("t", "id").collect()}
    both = spark.createDataFrame([(ids["a"], ids["b"]), (ids["a"], ids["c"])], "u long, v long")
    assert [tuple(r) for r in resemblance._linked(both, sets, 5, resemblance.SIMILAR).collect()] == [(ids["a"], ids["b"])]


ODD = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, None, None, "b", None), (2, None, None, "b", None), (3, "same words here", "en", None, 15), (3, "same words here", "en", None, 15), (4, " \n", "en", "a", 2)]
KEY = 'token = "9885103314b39ed955fd8ac9efa74c6fd87b66ee"'


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones, secrets, copies and odd rows, further columns with names that the stages use, and labels."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = list(ODD)
    for k in range(10, 200):
        words = [word() for _ in range(rng.randint(20, 60))]
        if k % 4 == 0:
            words[5:5] = "you worthless idiot scum pathetic loser".split()
        if k % 10 == 1:
            words[9:9] = [KEY]
        rows.append((k, " ".join(words), "en", f"s{k % 3}", 0))
    rows += [(500 + k, rows[40 + k][1] + " more", "en", "s1", 0) for k in range(6)]
    at = tmp_path_factory.mktemp("docs")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(c) for c in ("score", "_k1", "copies", "root", "key", "row")}).withColumn("odd name", F.col("doc_id") % 7)
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    docs.where("doc_id >= 10").select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")).write.parquet(f"{at}/labels.parquet")
    return str(at)


def rows_in(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), folder).count() == 0


def test_toxic_documents_go_and_others_stay_as_they_are(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = rows_in(corpus_pipeline.drop_toxic(spark, docs, folder))
    model = toxicity.train(docs, toxicity.toxic_labels(spark, folder))
    score = lambda t: 1 / (1 + 2.718281828459045 ** -sum(a * b for a, b in zip(toxicity.features(t or "", model), model.weights, strict=True)))
    assert kept == Counter({r: n for r, n in rows_in(docs).items() if score(r[1]) < corpus_pipeline.REJECT})
    assert not any("worthless" in (r[1] or "") for r in kept) and sum(kept.values()) > 140


def test_secrets_go_from_texts_and_nothing_else(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = rows_in(corpus_pipeline.redact_secrets(spark, docs, folder))
    forest, vocabulary = secrets.default_forest(spark)
    want = Counter()
    for r, n in rows_in(docs).items():
        text, at, out = r[1], 0, ""
        for c in secrets.merged(secrets.judged(text or "", r[3] or "", forest, vocabulary), secrets.LIMIT):
            out, at = out + text[at : c.start] + f"[{c.kind}]", c.end
        text = text if not text else out + text[at:]
        want[r[0], text, *r[2:4], r[4] if text is None else len(text), *r[5:]] += n
    assert after == want and not any("9885103314" in (r[1] or "") for r in after) and any("[assigned]" in (r[1] or "") for r in after)


def test_the_mix_repeats_whole_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, after = rows_in(docs), rows_in(corpus_pipeline.mix_sources(spark, docs, folder))
    assert after == rows_in(corpus_pipeline.mix_sources(spark, docs.repartition(5), folder)) and after.keys() <= before.keys()
    assert all(n <= 3 * before[r] for r, n in after.items()) and not any(not (r[1] or "").strip() for r in after)
    words = lambda rows, s: sum(n * len((r[1] or "").split()) for r, n in rows.items() if r[3] == s)
    total = sum(words(before, s) for s in {r[3] for r in before})
    # by code point, null last: a (no words), b (none), s0, s1, s2, null; weights 1, 2, 3, 1, 2, 3
    own, weight = {s: words(before, s) for s in ("s0", "s1", "s2", None)}, {"s0": 3, "s1": 1, "s2": 2, None: 3}
    target = {None: 3.0 * own[None]}
    for s in ("s0", "s1", "s2"):
        target[s] = (total - target[None]) * weight[s] / 6
    assert all(target[s] <= 3 * own[s] for s in own) and all(abs(words(after, s) - target[s]) <= 60 for s in own)


def test_the_run_is_the_stages_in_order(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    tokens = __import__("tokenizers").Tokenizer.from_file(path("word_bpe_49k.json"))
    want = Counter((r.doc_id, len(tokens.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    assert Counter((r.doc_id, r.doc_tokens) for r in out if r.start == 0) == want
    assert sum(r.length for r in out) == sum(n * k for (_, n), k in want.items())
    for s in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length


def test_whole_texts_travel_in_small_batches(spark, folder, monkeypatch):
    """No stage holds thousands of whole texts in one Arrow batch; the session's own setting stays."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for df in (toxicity.score(docs, toxicity.Model(b"", b"", (0.0,) * len(toxicity.features("", toxicity.Model(b"", b""))))), secrets.redact(docs, [], path("word_bpe_49k.json"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    before = spark.conf.get(key)
    for name in ("entries", "_linked"):
        real = getattr(resemblance, name)
        monkeypatch.setattr(resemblance, name, lambda *a, real=real: (seen.append(int(spark.conf.get(key))), real(*a))[1])
    corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert seen and max(seen) <= 256 and spark.conf.get(key) == before
