"""Nearest neighbours by inner product with an inverted multi-index.

Each half of a vector is quantised with its own centroids, so a vector lies in the cell of a centroid pair. A query walks
the pairs from the largest sum of its two inner products on, with a heap, until the cells hold enough rows, and the rows of those cells are reranked exactly.
How many rows are enough is measured: for a bounded sample of queries the true neighbours among all rows are found
by brute force, and the walk goes as far as `target_recall` of them needs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.stream import joined, record_batch
from pulsegrid.llm.text import lean
from pulsegrid.session import stage_table


@dataclass(frozen=True)
class Settings:
    """`sample` vectors fit the centroids, `probe_queries` measure recall; both are collected, so they are bounds.

    The centroids of a half grow with the square root of the rows, for some `rows_per_cell` rows a cell, up to `max_centroids`;
    the codebook is then 2 ** 20 cell counts (8 MB) and as many centroids. `block` rows of a cell, or of neighbouring cells, are
    reranked together.
    """

    k: int = 20
    target_recall: float = 0.95
    sample: int = 20_000
    rounds: int = 10
    rows_per_cell: int = 200
    max_centroids: int = 1024
    probe_queries: int = 128
    block: int = 4096
    seed: int = 7


def usable(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, vector) of rows that take part, and their dimension.

    Rows without id, and vectors that are null, zero, or hold a null or non-finite component take no part, nor do vectors
    of another length than the most frequent one (ties: the longer).
    """
    v = F.col("vector")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    return rows.where(F.size("vector") == d), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat, dtype=np.float64).reshape(-1, d) if len(column) else np.zeros((0, d))


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids; an empty one is moved to a random vector."""
    centre = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = nearest(x, centre)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre**2).sum(1)[None, :] - 2 * (x @ centre.T), axis=1)


@dataclass(frozen=True)
class Codebook:
    """Centroids of both halves, the rows in each cell, and how rows are grouped in blocks."""

    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray
    width: int
    chunks: np.ndarray

    @property
    def k(self) -> int:
        return len(self.left)

    @property
    def spans(self) -> int:
        return -(-self.k // self.width)

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = self.left.shape[1]
        return nearest(x[:, :h], self.left) * self.k + nearest(x[:, h:], self.right)

    def group(self, cell: np.ndarray) -> np.ndarray:
        """Cells with the same left centroid and neighbouring right ones share a group."""
        return cell // self.k * self.spans + cell % self.k // self.width

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Cells from the largest summed inner product on; a heap holds the frontier of pairs of ranks."""
        h = self.left.shape[1]
        a, b = self.left @ q[:h], self.right @ q[h:]
        i, j = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        a, b = (-np.sort(-a)).tolist(), (-np.sort(-b)).tolist()
        heap, k = [(-(a[0] + b[0]), 0, 0)], self.k
        while heap:
            _, x, y = heapq.heappop(heap)
            yield i[x] * k + j[y]
            if y + 1 < k:
                heapq.heappush(heap, (-(a[x] + b[y + 1]), x, y + 1))
            if y == 0 and x + 1 < k:
                heapq.heappush(heap, (-(a[x + 1] + b[0]), x + 1, 0))

    def probed(self, q: np.ndarray, enough: int) -> list[int]:
        """Non-empty cells of the walk until they hold `enough` rows."""
        out, held = [], 0
        for cell in self.walk(q):
            n = int(self.counts[cell])
            if n:
                out.append(cell)
                held += n
                if held >= enough:
                    break
        return out


def exact(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, summed alike for equal rows."""
    return (rows * q).sum(axis=1)


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact first `k` by score, then id; `scores` may be off by rounding, so near ties are scored again."""
    scores = np.where(ids == own, -np.inf, scores)
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(float(least)) if np.isfinite(least) else 1.0))
    else:
        at = np.arange(len(scores))
    at = at[np.isfinite(scores[at])]
    sure = exact(rows[at], q)
    order = np.lexsort((ids[at], -sure))[:k]
    return ids[at][order], sure[order]


def _top(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
FOUND = "query_id long, vec_id long, score double"


def brute_force(rows: DataFrame, queries: list[tuple[int, list[float]]], d: int, k: int) -> DataFrame:
    """Exact `k` neighbours of a bounded list of queries among all rows (id, vector): first per batch, then of all batches."""
    shared = rows.sparkSession.sparkContext.broadcast((np.array([q for q, _ in queries]), np.array([v for _, v in queries])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        for batch in batches:
            if batch.num_rows:
                x, ids = matrix(batch.column(1), d), np.asarray(batch.column(0))
                for one, vector, scores in zip(own.tolist(), q, q @ x.T, strict=True):
                    names, sure = best(scores, ids, x, vector, one, k)
                    yield record_batch(_FOUND, [np.full(len(names), one), names, sure])

    return _top(rows.select("id", "vector").mapInArrow(lean(run), FOUND), k)


def build(rows: DataFrame, d: int, n: int, s: Settings) -> tuple[Codebook, DataFrame]:
    """Centroids from a bounded sample, and all rows with their `cell`, staged."""
    spark = rows.sparkSession
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(share < s.sample / max(n, s.sample)).orderBy("id").limit(2 * s.sample).select("vector").toArrow()
    x = matrix(sample["vector"].combine_chunks(), d)
    if not len(x):  # all ids fell outside the share
        x = matrix(rows.limit(s.sample).select("vector").toArrow()["vector"].combine_chunks(), d)
    k = int(min(max(round(math.sqrt(n / s.rows_per_cell)), 1), s.max_centroids))
    rng, h = np.random.default_rng(s.seed), max(d // 2, 1)
    books = kmeans(x[:, :h], k, s.rounds, rng), kmeans(x[:, h:], k, s.rounds, rng)
    shared = spark.sparkContext.broadcast(Codebook(*books, np.zeros(0), 1, np.zeros(0)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = shared.value.cells(matrix(batch.column(1), d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["id", "vector", "cell"])

    indexed = stage_table(rows.mapInArrow(lean(assign), "id long, vector array<double>, cell int"), "cells")
    counts = np.zeros(k * k, dtype=np.int64)
    for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most max_centroids squared
        counts[r["cell"]] = r["n"]
    width = int(min(max(math.ceil(s.block * k * k / max(n, 1)), 1), k))
    book = Codebook(*books, counts, width, np.zeros(0))
    sizes = np.bincount(book.group(np.arange(k * k)), weights=counts, minlength=k * book.spans)
    return Codebook(*books, counts, width, np.maximum(np.ceil(sizes / s.block), 1).astype(np.int64)), indexed


def enough_rows(indexed: DataFrame, queries: DataFrame, book: Codebook, d: int, s: Settings) -> int:
    """Rows that a walk must reach so that `target_recall` of the true neighbours of sampled queries are among them."""
    picked = queries.orderBy(F.xxhash64("id"), "id").limit(s.probe_queries).select("id", "vector").collect()
    if not picked:
        return 0
    true = brute_force(indexed, [(r["id"], r["vector"]) for r in picked], d, s.k)
    cells = true.join(indexed.select(F.col("id").alias("vec_id"), "cell"), "vec_id").select("query_id", "cell").collect()
    by: dict[int, list[int]] = {}
    for r in cells:
        by.setdefault(r["query_id"], []).append(r["cell"])
    needed = []
    for r in picked:
        held, reached = 0, {}
        wanted = set(by.get(r["id"], []))
        for cell in book.walk(np.array(r["vector"])):
            held += int(book.counts[cell])
            if cell in wanted:
                reached[cell] = held
                if len(reached) == len(wanted):
                    break
        needed += [reached[c] for c in by.get(r["id"], [])]
    return int(np.quantile(needed, s.target_recall, method="higher")) if needed else 0


def search(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, settings: Settings | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the `k` nearest rows by inner product of each query row, nearest first.

    `is_query` is a condition over the column `id`. All usable rows are candidates but those with the query's own id; ties go to the
    smaller id; repeated rows count each, a repeated query once. With fewer candidates than `k` all that the walk
    reached are returned, and it reaches at least 2 k rows. A cell of more than `block` rows is split by hash of the row, so
    a vector that fills a third of the table spreads over tasks; queries stream past a block's rows. An empty table, or one
    without a usable vector, gives no rows. Other columns are not read, whatever their names.
    """
    s = settings or Settings()
    rows, d = usable(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    rows = stage_table(rows, "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    book, indexed = build(rows, d, n, s)
    queries = indexed.where(is_query).dropDuplicates(["id"])
    most_alike = rows.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    enough = max(enough_rows(indexed, queries, book, d, s), 2 * s.k + most_alike)
    shared = spark.sparkContext.broadcast(book)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block of cells that a query visits, with the bits of those it wants there."""
        held = shared.value
        schema = pa.schema([("group", pa.int32()), ("chunk", pa.int32()), ("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("wanted", pa.int64())])
        for batch in batches:
            x, out = matrix(batch.column(1), d), []
            for one, vector in zip(batch.column(0).to_pylist(), x, strict=True):
                cells = np.array(held.probed(vector, enough))
                group, which = np.unique(held.group(cells), return_inverse=True)
                bits = np.zeros(len(group), dtype=np.uint64)
                np.bitwise_or.at(bits, which, np.uint64(1) << (cells % held.k % held.width).astype(np.uint64))
                for g, b in zip(group.tolist(), bits.view(np.int64).tolist(), strict=True):
                    out += [(g, c, one, vector, b) for c in range(int(held.chunks[g]))]
                if len(out) > 4000:
                    yield record_batch(schema, list(zip(*out, strict=True)))
                    out = []
            if out:
                yield record_batch(schema, list(zip(*out, strict=True)))

    asked = queries.select("id", "vector").mapInArrow(lean(probe), "group int, chunk int, id long, vector array<double>, wanted long")
    asked = asked.select("group", "chunk", F.lit(1).alias("side"), "id", "vector", F.lit(0).alias("cell"), "wanted")
    groups = F.floor(F.col("cell") / book.k) * book.spans + F.floor((F.col("cell") % book.k) / book.width)
    many = F.element_at(F.lit(book.chunks.tolist()), F.col("group") + 1)
    there = indexed.withColumn("group", groups.cast("int")).select(
        "group",
        F.pmod(F.xxhash64("id", "vector"), many).cast("int").alias("chunk"),
        F.lit(0).alias("side"),
        "id",
        "vector",
        "cell",
        F.lit(0).cast("long").alias("wanted"),
    )
    both = there.unionByName(asked).repartition("group", "chunk").sortWithinPartitions("group", "chunk", "side")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for block, part in _sided(batches):
            x, ids = matrix(block.column(4), d), np.asarray(block.column(3))
            bit = np.uint64(1) << (np.asarray(block.column(5)) % held.k % held.width).astype(np.uint64)
            for at in range(0, part.num_rows, 512):
                asked_now = part.slice(at, 512)
                q, own = matrix(asked_now.column(4), d), np.asarray(asked_now.column(3))
                wanted = np.asarray(asked_now.column(6)).view(np.uint64)
                scores = q @ x.T
                out = ([], [], [])
                for one, vector, mask, row in zip(own.tolist(), q, wanted, scores, strict=True):
                    keep = np.flatnonzero(bit & mask)
                    names, sure = best(row[keep], ids[keep], x[keep], vector, one, s.k)
                    out[0].append(np.full(len(names), one))
                    out[1].append(names)
                    out[2].append(sure)
                yield record_batch(_FOUND, [np.concatenate(c) for c in out])

    found = _top(both.mapInArrow(lean(rerank), FOUND), s.k)
    return found.select("query_id", "rank", "vec_id", "score")


def _sided(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """(rows, queries) of each sorted (group, chunk, side): a block's rows are kept, its queries stream in pieces."""
    key, held, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in range(3)]
        fresh = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            fresh[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(fresh).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now, part = (int(columns[0][a]), int(columns[1][a])), batch.slice(a, b - a)
            if now != key:
                key, held, block = now, [], None
            if columns[2][a] == 0:
                held.append(part)
            elif held or block is not None:
                block = joined(held) if block is None else block
                held = []
                yield block, part
