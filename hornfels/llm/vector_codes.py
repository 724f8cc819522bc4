"""Product codes of vectors by filtering Lloyd: kd-trees over the parts, whole subtrees assigned at once.

A vector is cut into equal parts, each coded by the nearest entry of its place's codebook. Rows go into blocks once; a block
has one kd-tree for each place, whose nodes keep the count and the sum of their parts, and is written as one row. A round
sends the codebooks, which are small, down every tree: at a node an entry is dropped if another one is at least as near
to every point of the node's box, and a node with one entry left adds its cached count and sum to that entry without
looking at its parts. Blocks return one sum and count for each entry, which add up to the next codebooks. A last pass sends the
final codebooks down the same trees for the codes.

All is whole numbers, so every result is exact whatever the blocks are: an entry is farther from every point of a box than
another if it is so at the one corner that lies most in its direction, and ties go to the lower index.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornfels.llm.common import free_names, read_table, small_batches
from hornfels.storage import keep, materialise, scratch

#: Parts of a vector, entries of a codebook, rounds, and the factor before components are cut to whole numbers.
PARTS, ENTRIES, ROUNDS, FACTOR = 16, 64, 2, 256
#: Components of a block's vectors, parts of a leaf, and nodes that are held against all entries at a time.
BLOCK, LEAF, AT_ONCE = 1 << 18, 8, 1024


class Tree:
    """A kd-tree over the rows of ``points``, level by level: nodes are ranges of ``order``; -1 for the child of a leaf."""

    def __init__(self, points: np.ndarray) -> None:
        order = np.arange(len(points))
        starts, ends, children = [0], [len(points)], []
        level = np.array([0]) if len(points) else np.array([], int)
        while len(level):
            first, last = np.array(starts)[level], np.array(ends)[level]
            node = np.repeat(np.arange(len(level)), last - first)
            at = _ranges(first, last)
            held = points[order[at]]
            low, high = np.minimum.reduceat(held, np.r_[0, np.cumsum(last - first)[:-1]]), np.maximum.reduceat(held, np.r_[0, np.cumsum(last - first)[:-1]])
            wide = (high - low).argmax(axis=1)
            split = (last - first > LEAF) & ((high - low).max(axis=1) > 0)
            order[at] = order[at][np.lexsort((held[np.arange(len(held)), wide[node]], node))]
            new = []
            for k in range(len(level)):
                if not split[k]:
                    children.append(-1)
                    continue
                middle = int(first[k] + last[k]) // 2
                children.append(len(starts))  # and the next one
                new += [len(starts), len(starts) + 1]
                starts += [int(first[k]), middle]
                ends += [middle, int(last[k])]
            level = np.array(new, int)
        self.order, self.points = order.astype(np.int32), points[order].astype(np.int32)
        self.starts, self.ends, self.children = np.array(starts, np.int32), np.array(ends, np.int32), np.array(children, np.int32)
        if len(points):
            sums = np.r_[np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, axis=0, dtype=np.int64)]
            self.sums = sums[self.ends] - sums[self.starts]
            self.low = np.array([self.points[a:b].min(axis=0) for a, b in zip(self.starts, self.ends, strict=True)], np.int64)
            self.high = np.array([self.points[a:b].max(axis=0) for a, b in zip(self.starts, self.ends, strict=True)], np.int64)

    def filtered(self, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes, entry) of whole nodes that have one entry left, then (positions, entry) of the parts of other leaves, as ("nodes"|"parts", ...)."""
        level, alive = np.array([0]), np.ones((1, len(entries)), bool)
        while len(level):
            kept_level, kept_alive = [], []
            for at in range(0, len(level), AT_ONCE):
                nodes, left = level[at : at + AT_ONCE], alive[at : at + AT_ONCE]
                low, high = self.low[nodes], self.high[nodes]
                best = _nearest((low + high)[:, None, :], 2 * entries, left)  # to the middle of the box, doubled to stay whole
                lead = entries[best]
                corner = np.where(entries[None] > lead[:, None], high[:, None], low[:, None])
                farther = ((corner - entries[None]) ** 2).sum(axis=2) - ((corner - lead[:, None]) ** 2).sum(axis=2)
                left = left & ((farther < 0) | ((farther == 0) & (np.arange(len(entries))[None] < best[:, None])))
                left[np.arange(len(nodes)), best] = True
                one = left.sum(axis=1) == 1
                yield "nodes", nodes[one], best[one]
                rest, left = nodes[~one], left[~one]
                leaf = self.children[rest] < 0
                for n, mask in zip(rest[leaf], left[leaf], strict=True):
                    where = np.arange(self.starts[n], self.ends[n])
                    yield "parts", where, _nearest(self.points[where].astype(np.int64)[:, None, :], entries, mask[None])
                inner = rest[~leaf]
                kept_level.append(np.column_stack((self.children[inner], self.children[inner] + 1)).ravel())
                kept_alive.append(np.repeat(left[~leaf], 2, axis=0))
            level, alive = np.concatenate(kept_level), np.concatenate(kept_alive)

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the parts that each entry is the nearest to."""
        count, total = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
        for kind, where, entry in self.filtered(entries):
            np.add.at(count, entry, self.ends[where].astype(np.int64) - self.starts[where] if kind == "nodes" else 1)
            np.add.at(total, entry, self.sums[where] if kind == "nodes" else self.points[where])
        return count, total

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest entry and squared distance, in the order of the rows."""
        code = np.empty(len(self.order), np.int64)
        for kind, where, entry in self.filtered(entries):
            at = _ranges(self.starts[where], self.ends[where]) if kind == "nodes" else where
            code[at] = np.repeat(entry, self.ends[where] - self.starts[where]) if kind == "nodes" else entry
        far = ((self.points.astype(np.int64) - entries[code]) ** 2).sum(axis=1)
        out = np.empty((2, len(self.order)), np.int64)
        out[:, self.order] = code, far
        return out[0], out[1]


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    n = last - first
    return np.arange(n.sum()) + np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) if len(n) else np.array([], int)


def _nearest(points: np.ndarray, entries: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The nearest of the entries that are ``left``, the first of equally near ones."""
    far = ((points - entries[None]) ** 2).sum(axis=2)
    return np.where(left, far, np.iinfo(np.int64).max).argmin(axis=1)


def whole(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros to ``width`` and held within a limit that keeps squares and their sums exact in 64 bits."""
    limit = math.isqrt((1 << 62) // width) // 4
    out = np.zeros((len(vectors), width), np.float64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return np.clip(np.floor(FACTOR * out), -limit, limit).astype(np.int64)


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has no null or non-finite component and is not null itself."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(v.isNotNull() & finite)


def _blocks(rows: DataFrame, width: int, size: int) -> DataFrame:
    """One row a block of ``size`` vectors: their row numbers and their trees, one for each place."""

    def made(pending: list[pd.DataFrame]) -> pd.DataFrame:
        block = pd.concat(pending, ignore_index=True)
        values = whole(block["_v"].tolist(), width).reshape(len(block), PARTS, -1)
        trees = [Tree(np.ascontiguousarray(values[:, p])) for p in range(PARTS)]
        return pd.DataFrame({"rows": [block["_row"].tolist()], "trees": [pickle.dumps(trees, protocol=5)]})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending, n = [], 0
        for b in batches:
            for at in range(0, len(b), size):
                pending.append(b.iloc[at : at + size])
                n += len(pending[-1])
                if n >= size:
                    yield made(pending)
                    pending, n = [], 0
        if n:
            yield made(pending)

    return rows.mapInPandas(work, "rows array<long>, trees binary")


def _entries(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codebooks(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """``rounds`` of assigning all parts and replacing each used entry by its parts' mean, cut down to whole numbers."""
    spark = blocks.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            total = np.zeros(sent.value.shape[:2] + (sent.value.shape[2] + 1,), np.int64)
            for b in batches:
                for trees in b["trees"]:
                    for p, tree in enumerate(pickle.loads(trees)):
                        count, part = tree.totals(sent.value[p])
                        total[p] += np.column_stack((count, part))
            used = np.argwhere(total[:, :, 0] > 0)
            yield pd.DataFrame({"part": used[:, 0], "entry": used[:, 1], "sums": [total[p, e].tolist() for p, e in used]})

        found = blocks.select("trees").mapInPandas(sums, "part long, entry long, sums array<long>").select("part", "entry", F.posexplode("sums").alias("at", "x"))
        added = found.groupBy("part", "entry", "at").agg(F.sum("x").alias("x")).collect()  # parts * entries * (width of a part + 1) numbers
        total = np.zeros(books.shape[:2] + (books.shape[2] + 1,), np.int64)
        for r in added:
            total[r["part"], r["entry"], r["at"]] = r["x"]
        count = total[:, :, :1]
        books = np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books)
    return books


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """The columns of ``vectors`` but the vector, ``code`` (two hex digits a part) and ``error``; and the codebooks (part, entry, component).

    Rows whose vector is null or holds null or non-finite components are left out; others stay, repeated ones too. Codebooks begin
    as the parts of the 64 rows of the least ``key`` (null last, ties by vector); fewer rows make fewer entries. Vectors that are shorter
    than the longest, or whose length is no multiple of 16, are filled up with zeros; components beyond 2^29 / sqrt(length) / 256 count as that (262,144 for 64). An empty
    table gives an empty result and no codebooks. A new column whose name is taken has underscores behind it.
    """
    spark = vectors.sparkSession
    others = [c for c in vectors.columns if c != vector]
    code_name, error_name = free_names(others, "code", "error")
    kept = usable(vectors, vector).select(F.monotonically_increasing_id().alias("_row"), *[F.col(f"`{c}`").alias(f"_keep{k}") for k, c in enumerate(others)], F.col(f"`{key}`").alias("_id"), F.col(f"`{vector}`").cast("array<double>").alias("_v"))
    with scratch(spark):
        kept = materialise(kept, "vectors")  # the row numbers are the same from here on
        longest = kept.agg(F.max(F.size("_v"))).first()[0]
        width = PARTS * max(1, -(-(longest or 0) // PARTS))
        first = kept.orderBy(F.asc_nulls_last("_id"), "_v").select("_v").limit(ENTRIES).collect()
        books = whole([np.array(r["_v"]) for r in first], width).reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2)
        size = max(64, block // width)
        with small_batches(spark, size):
            blocks = materialise(_blocks(kept.select("_row", "_v"), width, size), "blocks")
        with small_batches(spark, 1):
            if len(first):
                books = codebooks(blocks, books, rounds)
            sent = spark.sparkContext.broadcast(books)

            def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                digits = np.array([f"{k:02x}" for k in range(256)])
                for b in batches:
                    for rows, trees in zip(b["rows"], b["trees"], strict=True):
                        code, error = zip(*[tree.codes(sent.value[p]) for p, tree in enumerate(pickle.loads(trees))], strict=True)
                        yield pd.DataFrame({"_row": rows, "_code": ["".join(r) for r in digits[np.array(code).T]], "_error": np.sum(error, axis=0)})

            codes = materialise(blocks.select("rows", "trees").mapInPandas(coded, "_row long, _code string, _error long"), "codes")
        own = [F.col(f"_keep{k}").alias(c) for k, c in enumerate(others)]
        out = kept.drop("_v").join(codes, "_row").select(*own, F.col("_code").alias(code_name), F.col("_error").alias(error_name))
        return keep(out, "codes"), books


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(_entries(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Assign and update in turn, as plain all-pairs SQL over parts and entries."""
    assign = """a{k} AS MATERIALIZED (
  SELECT rid, part, arg_min(entry, dist * 64 + entry) AS entry, min(dist) AS dist FROM (
    SELECT p.rid, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
    FROM parts p JOIN b{k} b ON b.part = p.part) GROUP BY rid, part
)"""
    update = """b{n} AS MATERIALIZED (
  SELECT b.part, b.entry, CASE WHEN any_value(s.v) IS NULL THEN any_value(b.v) ELSE any_value(s.v) END AS v FROM b{k} b LEFT JOIN (
    SELECT part, entry, list(m ORDER BY i) AS v FROM (
      SELECT a.part, a.entry, u.i, floor_div(sum(u.x), count(*)) AS m
      FROM a{k} a JOIN flat u ON u.rid = a.rid AND u.part = a.part GROUP BY a.part, a.entry, u.i) GROUP BY part, entry
  ) s ON s.part = b.part AND s.entry = b.entry GROUP BY b.part, b.entry
)""".replace("floor_div(sum(u.x), count(*))", "((sum(u.x) - ((sum(u.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT")
    steps = [assign.format(k=0)]
    for k in range(ROUNDS):
        steps += [update.format(k=k, n=k + 1), assign.format(k=k + 1)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT rid, part, v[(part * len(v)) // 16 + 1:((part + 1) * len(v)) // 16] AS v FROM kept, range(16) r(part)
), flat AS MATERIALIZED (
  SELECT rid, part, unnest(v) AS x, unnest(range(len(v))) AS i FROM parts
), b0 AS MATERIALIZED (
  SELECT part, rid - 1 AS entry, v FROM parts WHERE rid <= 64
), {", ".join(steps)}, total AS (
  SELECT rid, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid
), book AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM b{ROUNDS}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN total USING (rid), book
"""


ORACLE = _oracle()
