"""Approximate nearest neighbours by an inverted multi-index, ranked by inner product.

The two halves of the vectors are quantised by codebooks of their own, so a pair of centroids is a cell. A query walks the
pairs in order of their summed distance with a heap until the cells passed hold enough entries; those are reranked exactly.
Codebooks are fitted on a bounded sample (SAMPLE vectors, the least hashes of their ids). The same sample, searched by brute
force, tells which distance orders the cells better and what share of the entries a walk must pass for the wanted recall, so
data without structure is searched widely and clustered data narrowly. Every vector is indexed.

Entries are dealt into blocks of about BLOCK_ROWS in the order of their cells, a cell's own by hash, so a cell with a third of
all rows spreads over many blocks. An entry is sent once. A query is sent to each block that holds a cell of its walk; in a
task the queries stream past the block's entries, and only the entries of walked cells are multiplied with it. Each query keeps
its k best of the block.

Defined cases: vectors that are null, zero, of another length than most, or hold a null or non-finite component, and rows
without an id take no part; every other row is a candidate, so rows of one id are found and ask one by one; fewer candidates
than k give fewer rows; ties go to the smaller id; an empty table gives an empty result. Columns other than the id and the
vector are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, staged, wide_partitions

SAMPLE = 16_384
#: Entries that a cell holds on average, as long as the sample allows SAMPLE_PER_CENTROID vectors for each centroid of a half.
CELL_ROWS, SAMPLE_PER_CENTROID = 64, 32
BLOCK_ROWS = 16_384
#: Queries that meet a block at once.
QUERY_ROWS = 128
ITERATIONS = 15


def centroids_for(rows: int, sample: int) -> int:
    """Of each half: as many as give CELL_ROWS entries a cell."""
    return int(np.clip(np.sqrt(rows / CELL_ROWS), 4, max(4, sample // SAMPLE_PER_CENTROID)))


def half_distances(q: np.ndarray, books: list[np.ndarray], plain: bool) -> list[np.ndarray]:
    """From each query to each half's centroids: squared distance, or minus the inner product."""
    cut = [slice(0, q.shape[1] // 2), slice(q.shape[1] // 2, None)]
    return [-(q[:, s] @ c.T) if plain else (c * c).sum(1) - 2 * (q[:, s] @ c.T) for s, c in zip(cut, books, strict=True)]


def cells_of(v: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    first, second = (d.argmin(1) for d in half_distances(v, books, False))
    return first * len(books[1]) + second


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: float) -> list[int]:
    """Cells by rising summed distance, until they hold enough entries."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, a, b = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist()
    heap, cells, passed = [(x[0] + y[0], 0, 0)], [], 0
    while heap and passed < enough:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * len(b) + b[j]
        cells.append(cell)
        passed += counts[cell]
        if j + 1 < len(b):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return cells


def _fit_half(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ITERATIONS):
        near = (x @ centers.T - 0.5 * (centers * centers).sum(1)).argmax(1)
        for j in np.unique(near):
            centers[j] = x[near == j].mean(0)
    return centers


def fit(sample: np.ndarray, recall: float, k: int, centroids: int, seed: int = 3) -> tuple[list[np.ndarray], bool, float]:
    """Codebooks, whether cells go by inner product, and the share of entries that a walk passes."""
    half = sample.shape[1] // 2
    books = [_fit_half(sample[:, :half], centroids, seed), _fit_half(sample[:, half:], centroids, seed + 1)]
    cells = cells_of(sample, books)
    counts = np.bincount(cells, minlength=len(books[0]) * len(books[1]))
    queries = sample[:: max(1, len(sample) // 256)]
    near = np.array([np.argsort(-(sample @ q), kind="stable")[: min(k + 1, len(sample))] for q in queries])
    best = (1.0, False)
    for plain in (False, True):
        first, second = half_distances(queries, books, plain)
        needed = np.empty(near.shape)
        for i in range(len(queries)):  # one at a time: a row has all pairs of centroids
            order = np.argsort((first[i][:, None] + second[i][None, :]).ravel(), kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            needed[i] = np.cumsum(counts[order])[rank[cells[near[i]]]] / len(sample)
        best = min(best, (float(np.quantile(needed, recall)), plain))
    return books, best[1], best[0]


def usable(vector: Column, dim: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _walked_scores(q: np.ndarray, v: np.ndarray, may: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Products of each query with the entries of its cells; -inf elsewhere. Cell c is v[ends[c - 1] : ends[c]]."""
    score = np.full((len(q), len(v)), -np.inf)
    for c, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)):
        i = np.flatnonzero(may[:, c])
        if len(i):
            score[i, a:b] = q[i] @ v[a:b].T
    return score


def _best_of_block(ids: np.ndarray, rows: np.ndarray, v: np.ndarray, q_rows: np.ndarray, q: np.ndarray, score: np.ndarray, k: int):
    """The k best entries of a block for each query; what the products leave near the k-th is scored pair by pair, so that equal
    vectors have equal scores wherever they lie."""
    score[q_rows[:, None] == rows[None, :]] = -np.inf
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    else:
        least = np.full(len(q), -np.inf)
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
    i, j = np.nonzero((score >= (least - slack)[:, None]) & (score > -np.inf))
    exact = (q[i] * v[j]).sum(axis=1)
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    begin = np.searchsorted(i, i, "left")
    top = np.arange(len(i)) - begin < k
    return i[top], j[top], exact[top]


def search(vectors: DataFrame, queries: Column, k: int = 20, recall: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that queries selects (a condition on vec_id), its k nearest other rows."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = vectors.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None or common["dim"] == 0:
        return empty
    dim = common["dim"]
    whole = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    whole = whole.filter(F.col("vec_id").isNotNull() & usable(F.col("v"), dim))
    n = whole.count()
    if not n:
        return empty
    sample = [r["v"] for r in whole.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()]
    books, plain, share = fit(np.array(sample, np.float64), recall, k, centroids_for(n, len(sample)))
    width = len(books[1])

    def index(batches):
        number = TaskContext.get().partitionId() << 40
        for b in sliced(batches, 4096, 16):
            row = pa.array(number + np.arange(b.num_rows))
            number += b.num_rows
            yield pa.RecordBatch.from_arrays([row, b.column("vec_id"), b.column("v"), pa.array(cells_of(_matrix(b.column("v"), dim), books).astype(np.int32))], names=["row", "vec_id", "v", "cell"])

    entries = staged(whole.mapInArrow(index, "row long, vec_id long, v array<double>, cell int"), "multi-index", 4096, 16)
    held = {r["cell"]: r["n"] for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most one for each pair of centroids
    counts = np.zeros(len(books[0]) * width, np.int64)
    counts[list(held)] = list(held.values())
    start = np.cumsum(counts) - counts
    enough = share * counts.sum()
    places = spark.createDataFrame([(int(c), int(start[c]), int(counts[c])) for c in np.flatnonzero(counts)], "at long, start long, n long")
    block = ((F.col("start") + F.pmod(F.xxhash64("row"), F.col("n"))) / BLOCK_ROWS).cast("int")
    none = F.lit(None).cast("array<int>")
    dealt = entries.join(F.broadcast(places), F.col("cell") == F.col("at")).select(block.alias("block"), F.lit(0).alias("asks"), "row", "vec_id", "cell", none.alias("cells"), "v")

    def probe(batches):
        for b in sliced(batches, 256, 4):
            q = _matrix(b.column("v"), dim)
            first, second = half_distances(q, books, plain)
            at, who, lists = [], [], []
            for i in range(len(q)):
                cells = np.array([c for c in walk(first[i], second[i], counts, enough) if counts[c]], np.int64)
                low, high = start[cells] // BLOCK_ROWS, (start[cells] + counts[cells] - 1) // BLOCK_ROWS
                for x in range(int(low.min()), int(high.max()) + 1):
                    inside = cells[(low <= x) & (x <= high)]
                    if len(inside):
                        at.append(x)
                        who.append(i)
                        lists.append(np.sort(inside).astype(np.int32))
            take = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), b.column("row").take(take), b.column("vec_id").take(take), pa.array(lists, pa.list_(pa.int32())), b.column("v").take(take)],
                names=["block", "row", "vec_id", "cells", "v"],
            )

    asked = entries.filter(queries).select("row", "vec_id", "v").mapInArrow(probe, "block int, row long, vec_id long, cells array<int>, v array<double>")
    asked = asked.select("block", F.lit(1).alias("asks"), "row", "vec_id", F.lit(None).cast("int").alias("cell"), "cells", "v")

    def rerank(batches):
        """Sorted by block, then entries by cell before queries."""
        at, held, ready = None, [], None
        for batch in batches:
            blocks, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1]), [True])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if blocks[a] != at:
                    at, held, ready = blocks[a], [], None
                part = batch.slice(a, b - a)
                if not asks[a]:
                    held.append(part)
                    continue
                if ready is None:
                    table = pa.Table.from_batches(held) if held else part.slice(0, 0)
                    cell = table.column("cell").to_numpy()
                    own = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
                    ready = [table.column(c).to_numpy() for c in ("vec_id", "row")] + [_matrix(table.column("v"), dim), cell[own], np.append(own[1:], len(cell))]
                    held = []
                ids, rows, v, cells, ends = ready
                for c in range(0, part.num_rows, QUERY_ROWS):
                    some = part.slice(c, QUERY_ROWS)
                    q, lists = _matrix(some.column("v"), dim), some.column("cells")
                    wanted = np.searchsorted(cells, lists.flatten().to_numpy())
                    query = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
                    there = (wanted < len(cells)) & (cells[np.minimum(wanted, len(cells) - 1)] == lists.flatten().to_numpy()) if len(cells) else np.zeros(len(wanted), bool)
                    may = np.zeros((len(q), len(cells)), bool)
                    may[query[there], wanted[there]] = True
                    i, j, score = _best_of_block(ids, rows, v, some.column("row").to_numpy(), q, _walked_scores(q, v, may, ends), k)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("row").take(pa.array(i)), some.column("vec_id").take(pa.array(i)), pa.array(ids[j]), pa.array(score)], names=["query", "query_id", "vec_id", "score"]
                    )

    parts = max(wide_partitions(spark), -(-n // BLOCK_ROWS))
    met = dealt.unionByName(asked).repartition(parts, "block").sortWithinPartitions("block", "asks", "cell")
    found = met.mapInArrow(rerank, "query long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
