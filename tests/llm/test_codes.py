"""Vector codes by filtering Lloyd against plain assignment in whole numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hornfels.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(points, entries):
    far = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    return far.argmin(axis=1), far.min(axis=1)


@pytest.mark.parametrize("spread", [1, 3, 40, 5000])
def test_a_tree_assigns_as_all_pairs_do(spread):
    rng = np.random.default_rng(spread)
    points = rng.integers(-spread, spread + 1, (900, 3))
    points[:300] = points[0]
    entries = rng.integers(-spread, spread + 1, (64, 3))
    entries[7] = entries[30] = entries[3]  # equal entries: the lowest index
    tree = V.Tree(points)
    code, far = plain(points, entries)
    got, error = tree.codes(entries)
    assert got.tolist() == code.tolist() and error.tolist() == far.tolist()
    count, total = tree.totals(entries)
    assert count.tolist() == np.bincount(code, minlength=64).tolist()
    assert total.tolist() == [points[code == k].sum(axis=0).tolist() for k in range(64)]


def test_subtrees_are_assigned_whole():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 20, (500, 4)) for c in (-4000, 0, 4000)]).astype(int)
    looked = [len(where) for kind, where, _ in V.Tree(points).filtered(np.array([[-4000] * 4, [0] * 4, [4000] * 4])) if kind == "parts"]
    assert sum(looked) <= 2 * V.LEAF  # leaves that lie across two clusters


def expected(rows, width):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, *r[1]))
    parts = np.array([np.floor(256 * np.r_[r[1], np.zeros(width - len(r[1]))]) for r in kept], np.int64).reshape(len(kept), 16, -1)
    codes, errors, books = [], [], []
    for p in range(16):
        part = parts[:, p]
        book = part[:64].copy()
        for _ in range(2):
            code, _ = plain(part, book)
            book = np.array([part[code == k].sum(axis=0) // (code == k).sum() if (code == k).any() else book[k] for k in range(len(book))])
        code, error = plain(part, book)
        codes.append(code)
        errors.append(error)
        books.append(book)
    hexed = ["".join(f"{c:02x}" for c in row) for row in np.array(codes).T]
    return [(r[0], h, int(e)) for r, h, e in zip(kept, hexed, np.sum(errors, axis=0), strict=True)], np.array(books)


def vectors():
    rng = np.random.default_rng(4)
    rows = [(k, (rng.integers(-6, 7, 32) / 8).tolist(), int(k % 3) if k % 5 else None) for k in range(150)]
    rows += [(3, rows[9][1], 1), (160, rows[9][1], 1), (160, rows[9][1], 1), (None, rows[11][1], 2)]
    rows += [(170, None, 1), (171, [float("nan")] + [0.0] * 31, 1), (172, [None] + [0.0] * 31, 1), (173, [float("-inf")] * 32, 1), (174, [], 1), (175, [0.5] * 7, 1)]
    return rows


@pytest.mark.parametrize("block", [V.BLOCK, 1])
def test_compress_is_plain_lloyd(spark, block):
    rows = vectors()
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("code", "error_", "_row")})
    coded, books = V.compress(table, block=block)
    want, entries = expected(rows, 32)
    assert coded.columns == ["vec_id", "label", "code", "error_", "_row", "code_", "error"]
    assert sorted(((r.vec_id, r.code_, r.error) for r in coded.collect()), key=str) == sorted(want, key=str)
    assert books.tolist() == entries.tolist()


def test_few_rows_and_none(spark):
    few = [(k, [float(k)] * 5, 0) for k in range(3)]
    coded, books = V.compress(spark.createDataFrame(few, SCHEMA))
    assert books.shape == (16, 3, 1) and sorted((r.vec_id, r.code, r.error) for r in coded.collect()) == expected(few, 16)[0]
    coded, books = V.compress(spark.createDataFrame([(1, None, 0)], SCHEMA))
    assert coded.count() == 0 and books.size == 0
    huge, _ = V.compress(spark.createDataFrame([(1, [3e38] * 16, 0), (2, [-3e38] * 16, 0)], SCHEMA))
    assert huge.count() == 2
