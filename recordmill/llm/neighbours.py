"""Nearest neighbours by stable projections and a kd-tree.

Vectors are projected to a few dimensions with Gaussian (2-stable) weights: the squared
projected distance of two vectors is their squared distance times a chi-square variable.
A kd-tree over the projections returns leaves in the order of projected distance; members
are verified with their real distance until the chi-square distribution says that an unseen
vector is closer than the current tenth with a probability below ``1 - certainty``.

Rows are indexed where they lie, one tree for each run of rows; queries are replicated in
blocks of bounded size, and only the best of each run are shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm.textarrays import gathered

PROJECTED = 8
CERTAINTY = 0.98
#: Vectors of a leaf.
LEAF = 64
#: Bytes of vectors in one tree, and of queries replicated at once.
TREE_BYTES = 32 << 20
BLOCK_BYTES = 32 << 20


def usable(vector: str) -> Column:
    """True for a vector without null or non-finite components that is not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    certainty: float = CERTAINTY,
    projected: int = PROJECTED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query but itself.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id.
    Vectors that are null, zero, or hold null or non-finite components take no part on either
    side; vectors of another length than the query are no candidates.  Rows that repeat an id
    are candidates of their own, but never of a query with that id.  Fewer candidates give
    fewer rows, an empty table none; other columns are not read.
    """
    shape = lambda df: df.where(usable(embedding) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")
    )
    rows, found = shape(vectors), None
    for block in _blocks(shape(queries).dropDuplicates(["vec_id"])):
        held = vectors.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for table in gathered(batches, "embedding", TREE_BYTES):
                yield from _search(table, held.value, k, certainty, projected).to_batches(max_chunksize=4096)

        part = rows.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _blocks(queries: DataFrame) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Query vectors by length: (ids, vectors), in blocks of bounded size."""
    block: dict[int, list[tuple[int, list[float]]]] = {}
    size = 0

    def packed():
        return {n: (np.array([i for i, _ in part]), np.array([v for _, v in part])) for n, part in block.items()}

    for row in queries.toLocalIterator():
        block.setdefault(len(row[1]), []).append((row[0], row[1]))
        size += 8 * len(row[1])
        if size >= BLOCK_BYTES:
            yield packed()
            block, size = {}, 0
    if block:
        yield packed()


def certain(x: np.ndarray | float, dimensions: int):
    """Chi-square distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, dimensions // 2):
        term = term * (x / 2) / i
        total = total + term
    return 1 - np.exp(-x / 2) * total


def radius(certainty: float, dimensions: int) -> float:
    """The chi-square quantile: squared projected over squared real distance at which a search stops."""
    low, high = 0.0, 1000.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if certain(middle, dimensions) < certainty else (low, middle)
    return high


class Tree:
    """kd-tree over projected points; leaves are runs of ``order``."""

    def __init__(self, points: np.ndarray) -> None:
        self.points, self.order = points, np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int]] = []
        self.runs: list[tuple[int, int]] = []
        self._build(0, len(points))

    def _build(self, a: int, b: int) -> int:
        node, own = len(self.runs), self.points[self.order[a:b]]
        low, high = own.min(axis=0), own.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.runs.append((a, b))
        self.children.append((-1, -1))
        if b - a > LEAF:
            axis, middle = int((high - low).argmax()), (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], middle)]
            self.children[node] = self._build(a, a + middle), self._build(a + middle, b)
        return node

    def leaves(self, point: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(squared projected distance from which on nothing is seen yet, members), nearest first."""
        heap = [(0.0, 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            left, right = self.children[node]
            if left < 0:
                a, b = self.runs[node]
                yield bound, self.order[a:b]
                continue
            for child in (left, right):
                gap = np.maximum(np.maximum(self.low[child] - point, point - self.high[child]), 0.0)
                heapq.heappush(heap, (float(gap @ gap), child))


def _search(table: pa.Table, block: dict, k: int, certainty: float, projected: int) -> pa.Table:
    ids = np.asarray(table.column("vec_id"))
    lists = table.column("embedding").combine_chunks()
    length, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
    begin = np.cumsum(length) - length
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    stop = radius(certainty, projected)
    for n, (query_ids, queries) in block.items():
        own = np.flatnonzero(length == n)
        if not len(own):
            continue
        vectors, own_ids = flat[begin[own][:, None] + np.arange(n)], ids[own]
        weights = np.random.default_rng(n).standard_normal((n, projected))
        tree = Tree(vectors @ weights)
        for query_id, query, point in zip(query_ids.tolist(), queries, queries @ weights, strict=True):
            best_id, best = np.zeros(0, np.int64), np.zeros(0)
            for bound, members in tree.leaves(point):
                if len(best) == k and bound > stop * best[-1] ** 2:
                    break
                members = members[own_ids[members] != query_id]
                gap = vectors[members] - query
                distance = np.sqrt((gap * gap).sum(axis=1))
                if len(best) == k:
                    near = distance <= best[-1]
                    members, distance = members[near], distance[near]
                    if not len(members):
                        continue
                best_id, best = np.append(best_id, own_ids[members]), np.append(best, distance)
                keep = np.lexsort((best_id, best))[:k]
                best_id, best = best_id[keep], best[keep]
            out.append((np.full(len(best), query_id), best_id, best))
    parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, parts), strict=True)))
