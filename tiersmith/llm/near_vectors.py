"""Embedding near-duplicates: an exact metric range join by pivots.

On the unit sphere a least cosine is a largest distance ``reach``. Pivots cut the vectors of a label
into cells, each vector at home with its nearest. If two vectors of cells ``i`` and ``j`` lie within
reach, the first lies within ``2 * reach`` more of pivot ``j`` than of its own, and within the radius of
cell ``j`` plus ``reach``; those that do are copied to cell ``j`` as visitors, one way only. Cells then
join by themselves, in chunks of bounded size, and give back a sum of links and a tree of each
local component instead of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.graph import connected_components
from tiersmith.llm.vectors import by_size, unit_rows, usable
from tiersmith.session import cut_lineage

#: Vectors that a cell and a chunk of a cell should hold, and pivots that are broadcast at most.
#: With more vectors than these pivots can part, cells grow and are joined in more chunks.
CHUNK, PIVOTS = 2048, 4096


def local_links(
    ids: np.ndarray, weights: np.ndarray, a: np.ndarray, b: np.ndarray, matrix: np.ndarray, least: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, weights of linked partners and a root for the rows ``a`` and ``b`` of ``matrix`` that are linked.

    Pairs are those of ``a`` with ``b``; with an empty ``b`` those within ``a``.
    """
    own = len(b) == 0
    near = matrix[a] @ matrix[a if own else b].T >= least
    if own:
        np.fill_diagonal(near, False)
        b = a
    rows, columns = near.any(axis=1), near.any(axis=0)
    near, a, b = near[rows][:, columns], a[rows], b[columns]
    if not len(a):
        return ids[:0], weights[:0], ids[:0]
    sums = near @ weights[b]
    roots = ids.copy()
    far = np.iinfo(np.int64).max
    while True:
        before = roots.copy()
        roots[a] = np.minimum(roots[a], np.where(near, roots[b][None, :], far).min(axis=1))
        roots[b] = np.minimum(roots[b], np.where(near, roots[a][:, None], far).min(axis=0))
        if (roots == before).all():
            break
    if own:
        return ids[a], sums, roots[a]
    both = np.concatenate([a, b])
    return ids[both], np.concatenate([sums, near.T @ weights[a]]), roots[both]


def choose_pivots(points: DataFrame, chunk: int, pivots: int) -> dict[tuple, np.ndarray]:
    """Unit pivots of each group that fills more than a chunk: a hash sample of its points, bounded in all."""
    sizes = points.groupBy("label", "size").agg(F.count("*").alias("n")).filter(F.col("n") > chunk)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if not total:
        return {}
    per_cell = max(chunk, -(-total // pivots))
    drawn = points.join(sizes, ["label", "size"]).filter(F.pmod(F.xxhash64("point"), F.lit(per_cell)) == 0)
    table = drawn.select("label", "size", "vector").orderBy(F.xxhash64("point")).limit(2 * pivots).collect()
    groups: dict[tuple, list] = {}
    for label, size, vector in table:
        groups.setdefault((label, size), []).append(vector)
    return {key: unit_rows(np.array(rows, float)) for key, rows in groups.items()}


def _with_cells(points: DataFrame, pivots: dict[tuple, np.ndarray], kind: str, vector: str) -> DataFrame:
    names = [*points.columns, "cell", "away"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            labels = batch.column(1).to_pylist()
            for rows, matrix in by_size(batch.column(4)):
                for label in {labels[r] for r in rows}:
                    centres = pivots.get((label, matrix.shape[1]))
                    if centres is not None:
                        at = np.array([k for k, r in enumerate(rows) if labels[r] == label])
                        gaps = distances(unit_rows(matrix[at]), centres)
                        cell[rows[at]] = gaps.argmin(axis=1)
                        away[rows[at]] = gaps.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=names)

    return points.mapInArrow(
        work, f"point bigint, label {kind}, size int, copies bigint, vector {vector}, first bigint, cell int, away double"
    )


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def _visits(
    points: DataFrame, pivots: dict[tuple, np.ndarray], radius: dict[tuple, float], chunks: dict[tuple, int], reach: float,
    kind: str, vector: str,
) -> DataFrame:
    """Rows of the points that visit another chunk: its own ``home`` chunk and the ``host`` that it visits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, cells, away = batch.column(1).to_pylist(), batch.column(6).to_numpy(), batch.column(7).to_numpy()
            home = batch.column(8).to_numpy()
            at: list[np.ndarray] = []
            host: list[np.ndarray] = []
            for rows, matrix in by_size(batch.column(4)):
                for label in {labels[r] for r in rows}:
                    here = np.array([labels[r] == label for r in rows])
                    own = rows[here]
                    centres = pivots.get((label, matrix.shape[1]))
                    gaps = np.zeros((len(own), 1)) if centres is None else distances(unit_rows(matrix[here]), centres)
                    for j in range(gaps.shape[1]):
                        key = (label, matrix.shape[1], j)
                        near = gaps[:, j] <= np.minimum(radius.get(key, -9.0) + reach, away[own] + 2 * reach) + 1e-9
                        for c in range(chunks.get(key, 0)):
                            target = (j << 32) + c
                            go = own[(near & (cells[own] > j)) | ((cells[own] == j) & (home[own] > target))]
                            at.append(go)
                            host.append(np.full(len(go), target, np.int64))
            if at:
                rows = pa.array(np.concatenate(at))
                columns = [batch.column(k).take(rows) for k in (0, 1, 2, 3, 4, 8)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.concatenate(host))], names=["point", "label", "size", "copies", "vector", "home", "host"]
                )

    return points.mapInArrow(
        work, f"point bigint, label {kind}, size int, copies bigint, vector {vector}, home bigint, host bigint"
    )


def near_vectors(
    rows: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    chunk: int = CHUNK, pivots: int = PIVOTS,
) -> DataFrame:
    """Rows ``(id, n_links, component_id, kept)``, one per row of ``rows``.

    Rows of equal, not null labels are linked if the cosine of their vectors, in double precision, is
    at least ``least`` (above 0); vectors of different sizes are not. ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest id reachable, ``kept`` says whether it is the row's
    own. Vectors that are null, zero or hold null or non-finite components, and rows without a label,
    link with nothing. Equal vectors of a label are one point with a count, so copies are never paired;
    repeated rows are copies. Empty tables give empty ones; ids must be whole numbers.
    """
    schema = {f.name: f.dataType.simpleString() for f in rows.schema}
    kind, vector = schema[label_col], schema[vec_col]
    given = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vector"))
    good = usable(F.col("vector")) & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull()
    valid = given.filter(good)
    points = valid.groupBy("label", "vector").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    points = cut_lineage(points.select(
        F.monotonically_increasing_id().alias("point"), "label", F.size("vector").alias("size"), "copies", "vector", "first"
    ))
    reach = math.sqrt(2.0 - 2.0 * least)
    centres = choose_pivots(points, chunk, pivots)
    placed = cut_lineage(_with_cells(points, centres, kind, vector))
    # Cells of groups with pivots, which are bounded.
    split = placed.join(placed.groupBy("label", "size").agg(F.count("*").alias("n")).filter(F.col("n") > chunk), ["label", "size"], "left_semi")
    cells = split.groupBy("label", "size", "cell").agg(F.max("away").alias("away"), F.count("*").alias("n")).collect()
    radius = {(r[0], r[1], r[2]): r[3] for r in cells}
    chunks = {(r[0], r[1], r[2]): -(-r[4] // chunk) for r in cells}
    placed = placed.withColumn("home", _home(chunks, centres, kind))
    visitors = _visits(placed, centres, radius, chunks, reach, kind, vector)
    units = visitors.select("label", "size", F.col("host").alias("home"), F.col("home").alias("guest")).distinct()
    columns = ["point", "label", "size", "copies", "vector"]
    hosts = placed.select(*columns, "home")
    alone = hosts.withColumns({"guest": F.lit(-1).cast("long"), "visits": F.lit(False)})
    met = hosts.join(units, ["label", "size", "home"]).withColumn("visits", F.lit(False))
    came = visitors.select(*columns, F.col("host").alias("home"), F.col("home").alias("guest"), F.lit(True).alias("visits"))
    unit = alone.unionByName(met).unionByName(came)

    def join_cell(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        matrix = unit_rows(next(by_size(table.column("vector").combine_chunks()))[1])
        visits = table.column("visits").to_numpy()
        ids, links, roots = local_links(
            table.column("point").to_numpy(), table.column("copies").to_numpy(),
            np.flatnonzero(~visits), np.flatnonzero(visits), matrix, least,
        )
        return pa.table({"point": ids, "links": links, "root": roots})

    joined = unit.groupBy("label", "size", "home", "guest").applyInArrow(join_cell, "point bigint, links bigint, root bigint")
    joined = cut_lineage(joined)
    sums = joined.groupBy("point").agg(F.sum("links").alias("links"))
    groups = connected_components(joined, "point", "root").select(F.col("node").alias("point"), "component")
    named = points.select("point", "label", "vector", "first", "copies").join(sums, "point", "left").join(groups, "point", "left")
    named = named.withColumn("component", F.coalesce("component", "point"))
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(firsts, "component").select(
        "label", "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    linked = valid.join(named, ["label", "vector"]).select("id", "n_links", "component_id")
    rest = given.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(rest).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _home(chunks: dict[tuple, int], centres: dict[tuple, np.ndarray], kind: str):
    """Number of a point's chunk: its cell, and a hash part of the cell if that has several chunks."""

    @F.arrow_udf("bigint")
    def home(label: pa.Array, size: pa.Array, cell: pa.Array, point: pa.Array) -> pa.Array:
        spread = (point.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        cells = cell.to_numpy().astype(np.int64)
        parts = [chunks.get(key, 1) for key in zip(label.to_pylist(), size.to_pylist(), cell.to_pylist(), strict=True)]
        return pa.array((cells << 32) + (spread % np.array(parts, np.uint64)).astype(np.int64), pa.int64())

    return home("label", "size", "cell", "point")
