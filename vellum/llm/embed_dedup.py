"""Embedding near-dedup over an inverted multi-index.

Vectors are scaled to length 1 and cut in halves; a codebook for each half, fitted by Lloyd
steps over the whole table, makes a product grid of cells. Every vector is a query: from
its own cell it goes through the others by a multi-sequence traversal, in the order of a
lower bound on how far a vector must be from the query to lie in that cell (its distance
to the border between the two centroids, added over the halves), until the bound passes
what the target recall asks for. That limit is planned for the loosest pairs there are: from
each of a sample of vectors, which grows with the table, partners are drawn at exactly the
threshold, in random directions, and the limit is what the wanted share of them needs, where a
pair is found if either of its vectors goes to the cell of the other. The same sample's true partners, by comparison with the whole table, can only raise it: each
query counts alike, whatever its number of partners, so that a dense group doesn't decide
for the others. Vectors that meet in a cell are verified by their cosine. Equal vectors are
collapsed first.

Groups are transitive; the least vec_id of each is kept. Defined results: null, empty,
zero and non-finite vectors, those of another length than most, and null vec_ids, belong
to no group; a vec_id in several rows counts once, with its first vector; an empty table
gives an empty result. Only vec_id and embedding are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components

COSINE = 0.95
RECALL = 0.98
#: Vectors that a cell of the grid has on average, and the most centroids of a half.
CELL = 32
MOST_CENTROIDS = 8192
STEPS = 6
#: Queries whose partners are searched by brute force to measure the limit; a quarter of the root of the rows is added.
PROBES = 256
#: Partners drawn for each query.
DRAWN = 16
BINS = 256
TILE = 1024
SEED = 11


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column of one length, in rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1), np.float32)


@dataclass
class Grid:
    books: tuple[np.ndarray, np.ndarray]

    def margins(self, vectors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each half, the own centroid of each vector, and its distances to the others' borders (0 for its own)."""
        own, far = [], []
        cut = len(self.books[0][0])
        for book, half in zip(self.books, (vectors[:, :cut], vectors[:, cut:]), strict=True):
            d = squares(half, book)
            best = d.argmin(axis=1)
            used, at = np.unique(best, return_inverse=True)
            between = np.sqrt(np.maximum(squares(book[used], book), 1e-12))
            m = (d - d[np.arange(len(d)), best][:, None]) / (2 * between[at])
            m[np.arange(len(d)), best] = 0
            own.append(best)
            far.append(np.maximum(m, 0))
        return own, far


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def traverse(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in the order of first[i]² + second[j]², up to limit, by the multi-sequence algorithm."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = (first[a] ** 2).tolist(), (second[b] ** 2).tolist()
    heap, met = [(x[0] + y[0], 0, 0)], {(0, 0)}
    while heap:
        s, i, j = heapq.heappop(heap)
        if s > limit:
            return
        yield int(a[i]), int(b[j])
        for k in ((i + 1, j), (i, j + 1)):
            if k[0] < len(x) and k[1] < len(y) and k not in met and x[k[0]] + y[k[1]] <= limit:
                met.add(k)
                heapq.heappush(heap, (x[k[0]] + y[k[1]], *k))


def unit_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v) of distinct usable vectors, scaled, each under its least vec_id; n: how many there are of it."""
    usable = table.select("vec_id", "embedding").where("vec_id is not null and embedding is not null and size(embedding) > 1")
    usable = usable.where("not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)")
    length = usable.groupBy(F.size("embedding").alias("k")).count().orderBy(F.desc("count"), "k").first()
    if length is None:
        return usable.select("vec_id", F.col("embedding").cast("array<float>").alias("v"))
    usable = usable.where(f"size(embedding) = {length['k']}").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return usable.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).select(
        "vec_id", F.expr("transform(e, x -> cast(x / sqrt(aggregate(e, double(0), (s, y) -> s + y * y)) as float))").alias("v")
    )


def lloyd(vectors: DataFrame, n: int, steps: int = STEPS) -> Grid:
    """Codebooks of both halves, from every vector in every step; what reaches the driver is two codebooks."""
    k = int(min(MOST_CENTROIDS, max(2, round(math.sqrt(n / CELL)))))
    first = np.array([r["v"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(k).collect()], np.float32)
    cut = first.shape[1] // 2
    grid = Grid((first[:, :cut].copy(), first[:, cut:].copy()))
    for _ in range(steps):
        rows = vectors.select("v").mapInArrow(partial_sums(grid), "half int, k int, n bigint, total array<double>")
        width = max(cut, first.shape[1] - cut)
        sums = [F.sum(F.try_element_at("total", F.lit(i + 1))).alias(f"s{i}") for i in range(width)]
        for r in rows.groupBy("half", "k").agg(F.sum("n").alias("n"), *sums).collect():
            book = grid.books[r["half"]]
            book[r["k"]] = np.array(r[3 : 3 + book.shape[1]]) / r["n"]
        grid = Grid(grid.books)
    return grid


def partial_sums(grid: Grid):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape) for b in grid.books]
        counts = [np.zeros(len(b), np.int64) for b in grid.books]
        cut = grid.books[0].shape[1]
        for b in batches:
            x = matrix(b.column(0))
            if not len(x):
                continue
            for h, half in enumerate((x[:, :cut], x[:, cut:])):
                own = squares(half, grid.books[h]).argmin(axis=1)
                np.add.at(sums[h], own, half)
                counts[h] += np.bincount(own, minlength=len(counts[h]))
        rows = [(h, k, int(counts[h][k]), sums[h][k].tolist()) for h in (0, 1) for k in np.flatnonzero(counts[h]).tolist()]
        cols = zip(*rows, strict=True) if rows else [()] * 4
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["half", "k", "n", "total"])

    return run


def drawn_bounds(probes: np.ndarray, grid: Grid, cosine: float) -> np.ndarray:
    """The bounds of partners at exactly the threshold, in random directions from each probe: the lesser of both ways."""
    mine, far = grid.margins(probes)
    rng = np.random.default_rng(SEED)
    x = np.repeat(probes, DRAWN, axis=0)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1)[:, None] * x
    away /= np.maximum(np.linalg.norm(away, axis=1), 1e-12)[:, None]
    own, back = grid.margins((cosine * x + math.sqrt(1 - cosine * cosine) * away).astype(np.float32))
    of, at = np.repeat(np.arange(len(probes)), DRAWN), np.arange(len(x))
    return np.minimum(far[0][of, own[0]] ** 2 + far[1][of, own[1]] ** 2, back[0][at, mine[0][of]] ** 2 + back[1][at, mine[1][of]] ** 2)


def measured_limit(vectors: DataFrame, grid: Grid, n: int, cosine: float, recall: float) -> float:
    """The bound within which the wanted share of partners lies: of drawn ones, and of each query's true ones."""
    probes = np.array([r["v"] for r in vectors.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").select("v").limit(PROBES + math.isqrt(n) // 4).collect()], np.float32)
    most = 2 - 2 * cosine
    mine, far = grid.margins(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(probes), BINS), np.int64)
        for b in batches:
            x = matrix(b.column(0))
            if not len(x):
                continue
            own, back = grid.margins(x)
            q, at = np.nonzero((near := probes @ x.T) >= cosine)
            other = near[q, at] < 0.999999
            q, at = q[other], at[other]
            s = np.minimum(far[0][q, own[0][at]] ** 2 + far[1][q, own[1][at]] ** 2, back[0][at, mine[0][q]] ** 2 + back[1][at, mine[1][q]] ** 2)
            np.add.at(found, (q, np.minimum(s / most * BINS, BINS - 1).astype(int)), 1)
        q, k = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(found[q, k])], ["query", "bin", "n"])

    rows = vectors.select("v").mapInArrow(run, "query int, bin int, n bigint").groupBy("query", "bin").agg(F.sum("n").alias("n")).collect()
    found = np.zeros((len(probes), BINS))
    for q, k, c in rows:
        found[q, k] = c
    limit = float(np.quantile(drawn_bounds(probes, grid, cosine), recall))
    if len(found := found[found.any(axis=1)]):
        share = np.cumsum(found, axis=1) / found.sum(axis=1)[:, None]
        enough = int(np.searchsorted(share.mean(axis=0), recall - 1e-12))
        limit = max(limit, most * (enough + 1) / BINS)
    return min(most, limit)


def linked(ids: np.ndarray, x: np.ndarray, cosine: float) -> Iterator[np.ndarray]:
    """Links of the vectors that meet in a cell, tile by tile: (id, least id of its group in the tiles)."""
    for i in range(0, len(ids), TILE):
        for j in range(i, len(ids), TILE):
            at = np.r_[i : min(i + TILE, len(ids))] if i == j else np.r_[i : min(i + TILE, len(ids)), j : min(j + TILE, len(ids))]
            near = x[at] @ x[at].T >= cosine
            np.fill_diagonal(near, True)
            label = np.arange(len(at))
            while True:
                least = np.where(near, label, len(at)).min(axis=1)
                if (least == label).all():
                    break
                label = least
            moved = np.flatnonzero(label != np.arange(len(at)))
            if len(moved):
                yield np.stack([ids[at[moved]], ids[at[label[moved]]]], axis=1)


def links(vectors: DataFrame, grid: Grid, limit: float, cosine: float) -> DataFrame:
    """Verified links (a, b) between vectors that meet in a cell that one of them visits."""
    width = len(grid.books[1])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1))
            if not len(x):
                continue
            _, (first, second) = grid.margins(x)
            rows, cells = [], []
            for r in range(len(x)):
                i, j = np.flatnonzero(first[r] ** 2 <= limit), np.flatnonzero(second[r] ** 2 <= limit)
                for p, q in traverse(first[r][i], second[r][j], limit):
                    rows.append(r)
                    cells.append(int(i[p]) * width + int(j[q]))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), b.column(0).take(at), b.column(1).take(at)], ["cell", "vec_id", "v"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def settle(cells: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = []
            cuts = np.flatnonzero(np.diff(cells)) + 1
            for a, z in zip(np.append(0, cuts), np.append(cuts, len(cells)), strict=True):
                if z - a > 1:
                    found += linked(ids[a:z], x[a:z], cosine)
            if found:
                e = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            cells, ids, x = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2))
            last = int(np.searchsorted(cells, cells[-1]))
            if held and cells[-1] != held[-1][0][-1] or last:
                held.append((cells[:last], ids[:last], x[:last]))
                held = [h for h in held if len(h[0])]
                if held:
                    yield from settle(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held = []
            held.append((cells[last:], ids[last:], x[last:]))
        if held:
            yield from settle(*(np.concatenate(c) for c in zip(*held, strict=True)))

    rows = vectors.mapInArrow(visit, "cell bigint, vec_id bigint, v array<float>").repartition("cell").sortWithinPartitions("cell", "vec_id")
    return rows.mapInArrow(verify, "a bigint, b bigint")


def near_duplicates(table: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, group_id, kept) of every vector that has a near or equal one; group_id is the least vec_id."""
    units = checkpointed(unit_vectors(table))
    firsts = checkpointed(units.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")).select("vec_id", "v", "n"))
    n = firsts.count()
    if not n:
        return units.select("vec_id", F.col("vec_id").alias("group_id"), F.lit(True).alias("kept"))
    vectors = firsts.select("vec_id", "v")
    grid = lloyd(vectors, n)
    roots = components(links(vectors, grid, measured_limit(vectors, grid, n, cosine, recall), cosine))
    known = firsts.join(roots, firsts["vec_id"] == roots["node"], "left").select("v", "n", F.col("vec_id").alias("first"), "root").where("n > 1 or root is not null")
    return units.join(known, "v").select("vec_id", F.coalesce("root", "first").alias("group_id")).withColumn("kept", F.col("vec_id") == F.col("group_id"))
