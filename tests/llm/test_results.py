"""Results held against brute force, exact round trips and held-out accuracy."""

import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hornfels.llm import jpeg, media, mixing, packing, queries, sharding, simhash, token_counts, toxicity
from hornfels.operators import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")


def test_prefix_counts_equal_the_library():
    c, library = token_counts.counter(path("byte_bpe_50k.json")), Tokenizer.from_file(path("byte_bpe_50k.json"))
    rng = random.Random(3)
    alphabet = "ab'srelv \n\t.-1é日😀<|>"
    texts = ["a  b \n\n c", "<|endoftext|> hi <|endoftext|>", "it's we're 'r 're !'re", "x <|endoftext| y", "a\x1c b", "\n\n\n", "a\nb c"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    for t in texts:
        want = [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(1, len(t) + 1)]
        assert c.counts(t).tolist() == want, t
        fits = [k + 1 for k, n in enumerate(want) if n <= 4]
        assert token_counts.longest_prefix(c.steps(t), 4) == max(fits, default=0)


def test_token_counts_of_documents(spark, docs):
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for r in queries.QUERIES["op5_token_counts"](spark, SF).collect():
        assert r.n_tokens == len(library.encode(docs.text[r.doc_id], add_special_tokens=False).ids)


def test_word_ids_equal_the_library():
    e, library = packing.encoder(path("word_bpe_49k.json")), Tokenizer.from_file(path("word_bpe_49k.json"))
    rng = random.Random(3)
    alphabet = "ab'srelv \n\t.-1é日😀<|>Σİ̸́="
    texts = ["<|endoftext|> hi x<|endoftext|>y", "(it's) 'dog'!", "≮abc ΣΑΣ. İx", ""]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(500)]
    for t, got in zip(texts, e.ids_of(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_packing_is_whole_and_gapless(spark, docs):
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    out = queries.QUERIES["op4_packing"](spark, SF).toPandas()
    for i, g in out.sort_values("start").groupby("doc_id"):
        ids = np.array([*library.encode(docs.text[i], add_special_tokens=False).ids, 2], "<u4")
        assert g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(g.start, g.length, g.ids_crc32, strict=True))
    assert set(out.doc_id) == set(docs.index)
    fill = []
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        fill.append(g.length.sum())
    assert all(n == packing.LENGTH for n in fill[:-1])
    mix = out.assign(source=docs.source.reindex(out.doc_id).to_numpy()).groupby(["sequence_id", "source"]).length.sum().unstack(fill_value=0)
    share = mix.sum() / mix.sum().sum() * packing.LENGTH
    assert (abs(mix.iloc[:-1] - share) <= share * 0.02 + len(share) + 2).all().all()


def test_round_robin_matches_a_stepwise_one():
    totals, length = [1000, 5, 377, 60], 64
    robin = packing.RoundRobin(totals, [3, 1, 2, 1], length)
    left, deficit, stream = list(totals), [0] * 4, []
    while any(left):
        for q in range(4):
            deficit[q] += int(robin.quantum[q])
            n = min(left[q], deficit[q] >> packing.PARTS)
            stream += [q] * n
            left[q], deficit[q] = left[q] - n, deficit[q] - (n << packing.PARTS)
    got = [None] * len(stream)
    for q, total in enumerate(totals):
        at = 0
        while at < total:
            n = min(random.Random(at).randint(1, 90), total - at)
            for start, m, place in robin.pieces(q, at, n):
                assert place // length == (place + m - 1) // length
                got[place : place + m] = [(q, at + start + k) for k in range(m)]
            at += n
    assert [g[0] for g in got] == stream
    assert all([g[1] for g in got if g[0] == q] == list(range(t)) for q, t in enumerate(totals))


def _scalar_scan(bits, table, coef, ss, se, ah, al, blocks):
    """A plain decoder of one AC scan, bit by bit, after the standard's figures."""
    at = 0

    def take(n):
        nonlocal at
        at += n
        return int(bits[at - n : at] or "0", 2)

    def symbol():
        nonlocal at
        e = table[int(bits[at : at + 16].ljust(16, "1"), 2)]
        at += int(e & 31)
        return int(e >> 5)

    eob = 0
    for b in blocks:
        k = ss
        while k <= se:
            if eob:
                eob -= 1
                if ah:
                    for j in range(k, se + 1):
                        if coef[b, j] and take(1):
                            coef[b, j] += np.sign(coef[b, j]) << al
                break
            r, s = divmod(symbol(), 16)
            if s == 0 and r < 15:
                eob = (1 << r) + take(r)
                continue
            if not ah:
                k += r
                if s:
                    v = take(s)
                    coef[b, k] = (v if v >> (s - 1) else v - (1 << s) + 1) << al
                k += 1
                continue
            new = (1 if take(1) else -1) << al if s else 0
            while k <= se:
                if coef[b, k]:
                    if take(1):
                        coef[b, k] += np.sign(coef[b, k]) << al
                elif r == 0:
                    coef[b, k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1


def test_scans_against_a_plain_decoder():
    rng = np.random.default_rng(5)
    coef = (rng.integers(-90, 90, (40, 3, 64)) * (rng.random((40, 3, 64)) < np.array([0.9, 0.3, 0.05])[:, None])).astype(np.int16)
    coef[:, :, 0] = rng.integers(-300, 300, (40, 3))
    (file,) = jpeg.encode([(8, 5)], coef, [b"units 40"])
    images, got = jpeg.decode([file])
    assert (got.reshape(3, 40, 64).transpose(1, 0, 2) == coef).all()
    plain = np.zeros((3, 40, 64), np.int64)
    for comps, ss, se, ah, al, _, ac, interval, data in images[0].scans:
        if ss:
            parts = bytes(data).replace(b"\xff\0", b"\xfe\xfe").split(b"\xff")
            parts = [(p if k == 0 else p[1:]).replace(b"\xfe\xfe", b"\xff") for k, p in enumerate(parts)]
            for k, p in enumerate(parts):
                _scalar_scan("".join(f"{x:08b}" for x in p), jpeg.huffman_table(ac[:16], ac[16:]), plain[comps[0]], ss, se, ah, al, range(k * interval, min(40, (k + 1) * interval)))
    assert (plain[:, :, 1:] == got.reshape(3, 40, 64)[:, :, 1:]).all()


def test_chroma_is_upsampled():
    n = 6
    comps = [jpeg.Component(2, 2, 0, 4, 2, 4, 2, 0), jpeg.Component(1, 1, 0, 2, 1, 2, 1, 8), jpeg.Component(1, 1, 0, 2, 1, 2, 1, 10)]
    image = jpeg.Image(30, 15, comps, {0: np.full(64, 2.0, np.float32)})
    coef = np.zeros((12, 64), np.int16)
    coef[:8, 0], coef[8, 0], coef[9, 0] = 40 * n, 100, -100
    x = jpeg.rgb(image, coef)
    assert x.shape == (15, 30, 3) and (x[:, :16] == x[0, 0]).all() and (x[:, 16:] == x[0, 16]).all()
    y, cb = 128 + 80 * n / 8, 25
    assert np.allclose(x[0, 0], np.clip([y, y - 0.344136 * cb, y + 1.772 * cb], 0, 255), atol=1)
    samples = jpeg.inverse(np.eye(64, dtype=np.int16)[:1] * 80, np.ones(64, np.float32))
    assert (samples == 138).all()


def test_inverse_is_the_cosine_transform():
    rng = np.random.default_rng(2)
    coef = rng.integers(-60, 60, (5, 64))
    k = np.arange(8)
    c = np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    square = np.zeros((5, 64))
    square[:, jpeg.ZIGZAG] = coef
    want = np.clip(np.rint(np.einsum("kx,nkl,ly->nxy", c, square.reshape(5, 8, 8), c) + 128), 0, 255)
    assert (abs(jpeg.inverse(coef.astype(np.int16), np.ones(64, np.float32)) - want) <= 1).all()


def test_media_round_trip():
    rng = random.Random(1)
    data = [media.payload(bytes(rng.randrange(256) for _ in range(rng.randint(0, 2000)))) for _ in range(30)] + [media.payload(b"")]
    files = media.write_files(data)
    both = list(media.read_files(files))
    assert [p for p, _ in both] == data
    assert media.write_files(data[3:4]) == files[3:4]
    assert all((next(media.read_files([f]))[1] == x).all() for f, (_, x) in zip(files, both, strict=True))


def test_pivotal_rounding_keeps_words_and_expectations():
    rng = np.random.default_rng(4)
    size, share = rng.integers(64, 128, 200).astype(float), rng.random(200)
    taken = np.zeros(200)
    for _ in range(400):
        x = mixing.pivot(size, share, rng.random(200), 0)
        assert ((x > mixing.EPS) & (x < 1 - mixing.EPS)).sum() <= 1
        assert abs((x * size).sum() - (share * size).sum()) < 1e-6
        taken += x
        x = mixing.settle(size, mixing.pivot(size, share, rng.random(200)), rng.random(200))
        assert set(x) <= {0.0, 1.0}
        assert abs((x * size).sum() - (share * size).sum()) <= size.max()
    assert abs(taken / 400 - share).max() < 0.12


def test_mix_targets_and_reruns(spark):
    out = queries.QUERIES["op6_mixing"](spark, SF).toPandas().set_index("doc_id").sort_index()
    again = queries.QUERIES["op6_mixing"](spark, SF).toPandas().set_index("doc_id").sort_index()
    assert out.equals(again)
    source = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id").source.reindex(out.index)
    by = out.groupby(source).agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.source_size).all()
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(by.index))}
    left, open_, target = float(by["size"].sum()), set(by.index), {}
    while True:  # water filling by hand
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * by["size"][s]}
        if not over:
            break
        target |= {s: 3.0 * by["size"][s] for s in over}
        left, open_ = left - sum(target[s] for s in over), open_ - over
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    assert all(abs(by.target[s] - target[s]) < 1e-6 * max(1, target[s]) for s in by.index)
    assert (abs(by.taken - by.target) <= np.maximum(0.05 * by.target, out["size"].groupby(source).median())).all()
    assert (out.taken <= 3 * out["size"]).all()


def test_shards_match_the_mixture(spark, docs):
    out = queries.QUERIES["op10_sharding"](spark, SF).toPandas()
    assert sorted(out.doc_id) == sorted(docs.index)
    counts = out.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and len(counts) == 16
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    mix = out.groupby(["shard", docs.source.reindex(out.doc_id).to_numpy()]).size().unstack(fill_value=0)
    assert (mix.max() - mix.min() <= 2).all()
    row = out.iloc[0]
    assert row.text_crc32 == zlib.crc32(docs.text[row.doc_id].encode()) and row["size"] == len(docs.text[row.doc_id].encode()) + 1


def test_interleaving_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr("hornfels.llm.common.BUCKET_ROWS", 8)
    monkeypatch.setattr("hornfels.llm.common.FANOUT", 4)
    rows = spark.range(700).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source")
    out = sharding.interleaved(rows, "source", ["doc_id"]).toPandas()
    assert sorted(out.position) == list(range(700))
    hot = np.sort(out.position[out.source == "hot"])
    assert abs(np.diff(hot).mean() - 700 / len(hot)) < 0.1 and np.diff(hot).max() <= 8  # the other seven tie


def _brute_fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_against_all_pairs(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    out = queries.QUERIES["op7_simhash_near_dedup"](spark, SF).toPandas().set_index("doc_id")
    ids, fps = frame.doc_id.tolist(), [_brute_fingerprint(t) for t in frame.text]
    assert all(out.fingerprint[i] == f"{f:016x}" for i, f in zip(ids, fps, strict=True))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    assert all(out.component_id[i] == find(i) for i in ids)


def test_links_of_dense_and_chained_fingerprints(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    values = {base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(64)} | {rng.getrandbits(64) for _ in range(50)}
    x = base
    for k in range(40):  # a chain
        x ^= 3 << (k % 60)
        values.add(x)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    links = simhash.similar_pairs(spark.createDataFrame([(v,) for v in signed], "fp long"))
    got = [(r.u, r.v) for r in links.collect()]
    want = {(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert len(got) == len(want) and set(got) == want


def test_postings_are_not_broadcast(spark):
    """The explode makes 28 rows of one, which Spark's sizes do not know: under the default threshold all would go to the driver."""
    values = spark.range(50000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.similar_pairs(values)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 300)] + [(7, k) for k in range(8, 60)] + [(5, 5), (7, 8)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**{k: 100 for k in range(100, 301)}, **{k: 7 for k in range(7, 60)}, 5: 5}


def _auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / n / (len(y) - n)


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality_classifier", "quality", 0.97), ("op8_toxicity", "toxic", 0.75)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    out = queries.QUERIES[name](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert _auc(held.score.to_numpy(), held[label].to_numpy()) >= least


def test_a_trained_dictionary_shortens_toxic_windows_only():
    rng = random.Random(8)
    plain = [" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(12)).encode() for _ in range(2000)]
    toxic = toxicity.trained([f" {w} ".encode() for _ in range(400) for w in ("idiot", "scumbag", "worthless")], toxicity.TOXIC_BYTES)
    assert all(w in toxic for w in (b"idiot", b"scumbag", b"worthles"))
    model = toxicity.Model(toxic, toxicity.trained(plain, toxicity.ORDINARY_BYTES))
    assert toxicity.differences("abcd efgh an idiot of these abba", model).max() >= 2
    assert toxicity.differences("", model).max() <= 0
    assert max(toxicity.differences(w.decode(), model).max() for w in plain[:300]) <= 2


def test_little_text_is_its_own_dictionary():
    assert toxicity.trained([b" idiot ", b" scum ", b" idiot "], 100) == b" idiot  scum "
    assert toxicity.trained([], 100) == b""


def test_differences_are_those_of_plain_compression():
    """Held against two compressors built here, on whole texts: every window counts."""
    import zstandard

    model = toxicity.Model(b" idiot  scum ", b" and of the words " * 9)
    text = " ".join(f"word{k} and of the " + ("scum" if k % 7 == 3 else "other") for k in range(40))
    words = text.split()
    size = {"write_content_size": 0, "write_checksum": 0, "write_dict_id": 0, "window_log": toxicity.TABLES, "chain_log": toxicity.TABLES, "hash_log": toxicity.TABLES}
    params = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, **size)
    sides = [zstandard.ZstdCompressionDict(model.ordinary + x + toxicity.LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x in (bytes(len(model.toxic)), model.toxic)]
    for d in sides:
        d.precompute_compress(compression_params=params)
    length = lambda d, w: len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(w))
    wins = [toxicity.LEAD + f" {' '.join(words[k : k + toxicity.WINDOW_WORDS])} ".encode() for k in range(0, len(words), toxicity.WINDOW_WORDS)]
    assert toxicity.differences(text, model).tolist() == [length(sides[0], w) - length(sides[1], w) for w in wins]


def test_quality_rules_equal_sql(spark):
    name, sf = "op9_quality_rules", "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    key = lambda f: f.sort_values("doc_id").reset_index(drop=True)
    assert key(got).equals(key(want))


def test_secret_forest_on_unseen_findings(spark):
    from hornfels.llm import secrets

    vocabulary = path("word_bpe_49k.json")
    forest = secrets.train(secrets.generated_findings(spark, 1500), vocabulary)
    unseen = [secrets.example(np.random.default_rng(10_000_000 + k)) for k in range(400)]
    right = 0
    for text, where, start, end, label in unseen:
        kind = next((c.kind for c in secrets.candidates(text) if c.start < end and start < c.end), "mixed")
        p = secrets.predict(forest, np.array([secrets.features(text, secrets.Candidate(start, end, kind), where, vocabulary)]))[0]
        right += (p >= 0.5) == label
    assert right >= 390
