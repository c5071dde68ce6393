"""Exact top-k search by inner product, with bounds from segment statistics, coarse to fine.

A vector is cut into segments; by the inequality of Cauchy and Schwarz, two vectors' inner product is at
most the sum over segments of ``m * (mean * mean + deviation * deviation)``, ``m`` the segment's
length: the lower bound of their distance, turned round. Few long segments give a rough bound
that few numbers decide, many short ones a close one. What the bounds leave is computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiersmith.llm.vectors import by_size, usable

LEVELS = (1, 4, 16, 32)
#: Queries held in a task at once, candidates that give the first thresholds, and bounds computed together.
QUERY_BLOCK, SEEDS, TILE = 8192, 4096, 1 << 21
#: Whole numbers up to this size are multiplied in 64 bits.
WIDE = 2.0**24
LIMIT = (1 << 63) - 1


def segment_stats(matrix: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, both times the root of the segment's length."""
    edges = np.unique(np.linspace(0, matrix.shape[1], min(segments, matrix.shape[1]) + 1).astype(int))
    sizes = np.diff(edges)
    means = np.add.reduceat(matrix, edges[:-1], axis=1) / sizes
    off = matrix - np.repeat(means, sizes, axis=1)
    deviations = np.sqrt(np.add.reduceat(off * off, edges[:-1], axis=1))
    return np.concatenate([means * np.sqrt(sizes), deviations], axis=1)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each pair of rows, in whole numbers; those beyond 64 bits become the nearest within."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < WIDE:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    sums = (sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for r, s in zip(a, b, strict=True))
    return np.array([max(-LIMIT, min(LIMIT, s)) for s in sums], np.int64)


class TopK:
    """The ``k`` best candidates of each query so far; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.least = np.full(len(ids), -np.inf) if least is None else least.astype(float)
        self.stats = [segment_stats(queries, s) for s in LEVELS] if queries.shape[1] else []
        self.reach = np.sqrt((queries * queries).sum(axis=1)).max(initial=0)
        self.found = (np.zeros(0, np.int64),) * 3

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        step = max(1, TILE // max(1, len(self.ids)))
        for a in range(0, len(ids), step):
            self._add(ids[a : a + step], rows[a : a + step])

    def _add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        slack = 1e-9 * self.reach * np.sqrt((rows * rows).sum(axis=1)).max(initial=0) + 1e-6
        floor = self.least - slack
        alive = ids[:, None] != self.ids[None, :]
        pairs = None
        for level, own in enumerate(self.stats):
            stats = segment_stats(rows, LEVELS[level])
            if pairs is None:
                alive &= stats @ own.T >= floor
                if alive.mean() < 0.1:
                    pairs = np.nonzero(alive)
            else:
                keep = np.einsum("ij,ij->i", stats[pairs[0]], own[pairs[1]]) >= floor[pairs[1]]
                pairs = pairs[0][keep], pairs[1][keep]
        left, right = np.nonzero(alive) if pairs is None else pairs
        for a in range(0, len(left), 1 << 17):
            at, q = left[a : a + (1 << 17)], right[a : a + (1 << 17)]
            scores = exact_scores(rows[at], self.queries[q])
            good = scores >= self.least[q]
            self._take(q[good], scores[good], ids[at[good]])

    def _take(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        q, scores, ids = (np.concatenate(x) for x in zip(self.found, (q, scores, ids), strict=True))
        order = np.lexsort((ids, -scores, q))
        q, scores, ids = q[order], scores[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.found = q[rank < self.k], scores[rank < self.k], ids[rank < self.k]
        last = (rank == self.k - 1) & (scores > -LIMIT)
        self.least[q[last]] = np.maximum(self.least[q[last]], scores[last])


def _vectors(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of each size, of rows whose number is bounded."""
    table = rows.toArrow().combine_chunks()
    if not table.num_rows:
        return []
    ids = table.column(0).combine_chunks().to_numpy()
    return [(ids[at], matrix) for at, matrix in by_size(table.column(1).combine_chunks())]


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0
) -> DataFrame:
    """Rows ``(query_id, rank, id, score)``: the ``k`` candidates of the highest inner product for each query.

    Components are turned into ``floor(scale * x)`` first, ``x`` as double. A query's own id is not among its
    candidates; vectors of other sizes aren't either. Ties go to the smaller id, and a query with
    fewer candidates gets all. Vectors that are null or hold null or non-finite components, and null
    ids, take no part; repeated rows of a query are one query (the smallest vector), repeated candidates
    are found as often as they come; empty tables give an empty one.

    Queries are taken in blocks of bounded size; each block is sent to one scan of the candidates, whose
    tasks keep ``k`` rows per query. A bounded sample of the candidates is searched first, for
    thresholds that any better row must reach, so tasks prune from the start.
    """
    spark = candidates.sparkSession
    kind = candidates.schema[id_col].dataType.simpleString()
    whole = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    pool = candidates.filter(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), whole.alias("v"))
    asked = queries.filter(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), whole.alias("v"))
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    total, count = pool.count(), asked.count()
    share = min(1_000_000, int(1_000_000 * SEEDS / max(total, 1)) + 1)
    seeds = {m.shape[1]: (i, m) for i, m in _vectors(pool.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share).limit(4 * SEEDS))}
    results = []
    blocks = max(1, -(-count // QUERY_BLOCK))
    for b in range(blocks):
        held = _vectors(asked.filter(F.pmod(F.xxhash64("id", F.lit(b"block")), F.lit(blocks)) == b))
        sets = {}
        for ids, matrix in held:
            first = TopK(ids, matrix, k)
            if matrix.shape[1] in seeds:
                first.add(*seeds[matrix.shape[1]])
            sets[matrix.shape[1]] = ids, matrix, first.least
        sent = spark.sparkContext.broadcast(sets)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tops = {size: TopK(ids, matrix, k, least) for size, (ids, matrix, least) in sent.value.items()}
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for rows, matrix in by_size(batch.column(1)):
                    if matrix.shape[1] in tops:
                        tops[matrix.shape[1]].add(ids[rows], matrix)
            for top in tops.values():
                q, scores, found = top.found
                columns = [pa.array(top.ids[q]), pa.array(found.astype(top.ids.dtype)), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score"])

        results.append(pool.mapInArrow(search, f"query_id {kind}, id {kind}, score bigint"))
    merged = results[0]
    for part in results[1:]:
        merged = merged.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
