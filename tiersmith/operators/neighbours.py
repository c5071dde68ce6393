"""Exact nearest-neighbour joins (J-3, J-4).

Every step is bounded per task and no pair leaves a task unless it can be a result:

1. identical vectors collapse to one point carrying its k+1 smallest keys, so a huge
   group of copies is a single point;
2. a bounded set of pivots splits the points into cells; neighbouring cells are packed
   into blocks of limited size and oversized cells are split;
3. each block finds the k best inside itself, which bounds the true k-th distance;
4. a point visits another block only if the triangle or bisector bound of one of its
   cells allows something at least as close. Visits to a busy block are spread over
   several tasks, each holding that block's points once.

The pruning only skips blocks that provably cannot improve a point, so results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiersmith.session import cut_lineage

MAX_PIVOTS = 1024
BLOCK_VALUES = 4_000_000  # doubles held per block
BLOCK_ROOTS = 32  # rows of a block, in roots of its part's points
MAX_BLOCK_ROWS = 65_536
SMALL_CLASS = 4096  # rows compared whole in one task
COMPARE_ROWS = 1024  # rows compared with the pivots at a time
TILE_QUERIES, TILE_ROWS = 512, 2048  # compared by one matrix product
EXACT_PAIRS = 4_096  # distances computed exactly at a time
OUTLINE = 32  # leading directions along which rows are compared first
OUTLINE_WIDTH = 1024  # widest rows whose directions are looked for
OUTLINE_SCALE = 1e30  # squared lengths that single precision holds
OUTLINE_SHARE = 16  # rows kept by the directions, as a part of all, beyond which the whole rows are compared
MOST_PARTS = 256  # classes joined by one layout


def matrix(column, width: int) -> np.ndarray:
    """Arrow list column as a 2-d array."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, dtype=np.float64).reshape(-1, width)


def _lists(rows: list[np.ndarray], dtype) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    offsets[1:] = np.cumsum([len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.array([])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, dtype))


def _sq_dists(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def _pair_distances(q: np.ndarray, base: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    d = np.empty(len(i))
    for s in range(0, len(i), EXACT_PAIRS):
        sl = slice(s, s + EXACT_PAIRS)
        d[sl] = np.sqrt(((base[j[sl]] - q[i[sl]]) ** 2).sum(1))
    return d


def _outline(rows: np.ndarray) -> np.ndarray:
    """The leading principal directions of centred rows; along them no two rows lie farther apart than in full."""
    return np.linalg.eigh(rows.T @ rows)[1][:, -OUTLINE:]


def best_k(q: np.ndarray, q_id: np.ndarray, base: np.ndarray, base_id: np.ndarray, k: int, limit=None):
    """k closest base rows of each query as (ids, distances), ordered by (distance, id), self excluded.

    Tiles of queries and base rows are compared by a matrix product; what may lie within a query's k-th
    distance so far is computed exactly and only the k best are kept. Memory is that of a tile,
    however many rows there are. Wide rows are compared along their leading directions first, in single
    precision: distances there are never larger, and the slack covers the rounding, so nothing is lost.
    """
    if not len(q) or not len(base):
        return [np.array([], np.int64)] * len(q), [np.array([])] * len(q)
    ids, dists = [], []
    centre = base.mean(0)
    b0 = base - centre
    half = (b0 * b0).sum(1) / 2
    scale = 2 * half.max()
    wide = np.concatenate([b0, -half[:, None]], axis=1)
    outline = None
    if len(base) > TILE_ROWS and OUTLINE < base.shape[1] <= OUTLINE_WIDTH and scale < OUTLINE_SCALE:
        outline = _outline(b0)
        short = b0 @ outline
        short_half = (short * short).sum(1) / 2
        short = np.concatenate([short, -short_half[:, None]], axis=1).astype(np.float32)
    # Products go to one array each: new ones of this size cost more than the products.
    products = {f: np.empty(TILE_QUERIES * TILE_ROWS, f) for f in (np.float32, np.float64)}
    hits = np.empty(TILE_QUERIES * TILE_ROWS, bool)

    def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.matmul(x, y.T, out=products[x.dtype.type][: len(x) * len(y)].reshape(len(x), len(y)))

    def reaching(g: np.ndarray, least: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.greater_equal(g, least[:, None], out=hits[: g.size].reshape(g.shape)))

    for s in range(0, len(q), TILE_QUERIES):
        part, part_id = q[s : s + TILE_QUERIES], q_id[s : s + TILE_QUERIES]
        p0 = part - centre
        norm = (p0 * p0).sum(1)
        slack = 1e-9 * (norm + scale) + 1e-300
        bound = np.full(len(part), np.inf) if limit is None else limit[s : s + TILE_QUERIES] ** 2
        left = np.concatenate([p0, np.ones((len(part), 1))], axis=1)
        row, dist, near = np.array([], np.int64), np.array([]), np.array([], base_id.dtype)
        looked = outline is not None and norm.max() < OUTLINE_SCALE
        if looked:
            place = p0 @ outline
            length = (place * place).sum(1)
            place = np.concatenate([place, np.ones((len(part), 1))], axis=1).astype(np.float32)
        for t in range(0, len(base), TILE_ROWS):
            tile_id = base_id[t : t + TILE_ROWS]
            hit = None
            if looked and np.isfinite(bound).all():
                # Far more than single precision loses in a product of so few terms.
                loose = slack + 1e-5 * (length + 2 * short_half[t : t + TILE_ROWS].max())
                least = ((length - bound - loose) / 2).astype(np.float32)
                hit = reaching(product(place, short[t : t + TILE_ROWS]), least)
                if len(hit) > len(part) * len(tile_id) // OUTLINE_SHARE:
                    hit = None  # directions that tell little apart here
            if hit is None:
                g = product(left, wide[t : t + TILE_ROWS])  # (|p|^2 - squared distance) / 2
                if k <= len(tile_id) and not np.isfinite(bound).all():
                    g[part_id[:, None] == tile_id[None, :]] = -np.inf
                    kth = np.partition(g, len(tile_id) - k, axis=1)[:, len(tile_id) - k]
                    bound = np.minimum(bound, norm - 2 * kth + slack)
                hit = reaching(g, (norm - bound - slack) / 2)
            i, j = np.divmod(hit, len(tile_id))
            other = part_id[i] != tile_id[j]
            i, j = i[other], j[other] + t
            d = _pair_distances(part, base, i, j)
            good = np.isfinite(d) & (d * d <= (bound + slack)[i])
            if not good.any():
                continue
            row, dist, near = (np.concatenate(x) for x in ((row, i[good]), (dist, d[good]), (near, base_id[j[good]])))
            order = np.lexsort((near, dist, row))
            row, dist, near = row[order], dist[order], near[order]
            place_of = np.arange(len(row)) - np.searchsorted(row, row)
            bound[row[place_of == k - 1]] = np.minimum(bound[row[place_of == k - 1]], dist[place_of == k - 1] ** 2)
            row, dist, near = (x[place_of < k] for x in (row, dist, near))
        cuts = np.searchsorted(row, np.arange(1, len(part)))
        ids += np.split(near, cuts)
        dists += np.split(dist, cuts)
    return ids, dists


@dataclass
class _Layout:
    """Pivots, and by part and pivot the cells, blocks and radii derived from them; size bounded by MAX_PIVOTS and MOST_PARTS."""

    pivots: np.ndarray
    centre: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    first_block: np.ndarray | None = None
    splits: np.ndarray | None = None

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(_sq_dists(x - self.centre, self.pivots - self.centre))


def distinct_points(df: DataFrame, key: str, vector: str, k: int, part: str | None = None) -> DataFrame:
    """One row per distinct vector of a part: ``pid`` (smallest key), ``vec`` and the k+1 smallest keys.

    The rank filter is applied before the shuffle too, so copies never pile up in one task. Sorting
    compares hashes first: Spark prepares both vectors anew each time that it compares them.
    """
    by_vec = Window.partitionBy("part", "hash", "vec").orderBy("id")
    number = F.lit(0) if part is None else F.col(part)
    return (
        df.select(
            number.cast("int").alias("part"),
            F.col(key).cast("bigint").alias("id"),
            F.col(vector).cast("array<double>").alias("vec"),
        )
        .withColumn("hash", F.xxhash64("vec"))
        .withColumn("r", F.row_number().over(by_vec))
        .filter(F.col("r") <= k + 1)
        .groupBy("part", "hash", "vec")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select("part", F.col("ids")[0].alias("pid"), "vec", "ids")
    )


def _layout(points: DataFrame, n: int, width: int) -> _Layout:
    m = int(min(MAX_PIVOTS, max(2, 2 * math.sqrt(n)), n))
    # Hash order picks pivots independently of storage order; at most MAX_PIVOTS rows are listed.
    rows = points.select("pid", "vec").orderBy(F.xxhash64("pid"), "pid").limit(m).collect()
    pivots = np.array([r["vec"] for r in rows], dtype=np.float64).reshape(len(rows), width)
    return _Layout(pivots, pivots.mean(0))


def _with_cells(points: DataFrame, layout: _Layout, width: int) -> DataFrame:
    def assign(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, COMPARE_ROWS):
                b = whole.slice(s, COMPARE_ROWS)
                d = layout.distances(matrix(b.column("vec"), width))
                cell = d.argmin(1).astype(np.int32)
                own = d[np.arange(len(cell)), cell]
                yield pa.RecordBatch.from_arrays(
                    [b.column("part"), b.column("pid"), b.column("vec"), pa.array(cell), pa.array(own)],
                    names=["part", "pid", "vec", "cell", "own"],
                )

    columns = points.select("part", "pid", "vec")
    return columns.mapInArrow(assign, "part int, pid bigint, vec array<double>, cell int, own double")


def _pack_blocks(layout: _Layout, stats: list, block_rows: Callable[[int], int]) -> None:
    """Fill blocks along a nearest-neighbour walk over the pivots, part by part; split oversized cells.

    ``block_rows`` gives the rows of a block by those of its part.
    """
    m = len(layout.pivots)
    shape = (max(r["part"] for r in stats) + 1, m)
    size, layout.low, layout.high = np.zeros(shape, int), np.full(shape, np.inf), np.full(shape, -np.inf)
    for r in stats:
        at = r["part"], r["cell"]
        size[at], layout.low[at], layout.high[at] = r["n"], r["low"], r["high"]
    gap = layout.distances(layout.pivots)
    walk, seen = [0], {0}
    while len(walk) < m:
        row = gap[walk[-1]].copy()
        row[list(seen)] = np.inf
        walk.append(int(row.argmin()))
        seen.add(walk[-1])
    layout.first_block, layout.splits = np.zeros(shape, np.int64), np.ones(shape, np.int64)
    block = 0
    for part in range(shape[0]):
        filled, most = 0, block_rows(int(size[part].sum()))
        for c in walk:
            n = size[part, c]
            pieces = max(1, -(-n // most))
            if filled and filled + n > most:
                block, filled = block + 1, 0
            layout.first_block[part, c], layout.splits[part, c] = block, pieces
            if pieces > 1:
                block, filled = block + pieces, 0
            else:
                filled += n
        block += 1  # a block holds rows of one part


def _own_block(layout: _Layout, width: int, k: int):
    """Per block: best k inside it and the other blocks of its part that each point still has to visit."""
    gap = layout.distances(layout.pivots)

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("pid").to_numpy()
        vec = matrix(table.column("vec"), width)
        cell = table.column("cell").to_numpy()
        mine, part = (int(table.column(c)[0].as_py()) for c in ("block", "part"))
        low, high = layout.low[part], layout.high[part]
        start = int(layout.first_block[part].min())
        cell_blocks = [np.arange(f, f + s) for f, s in zip(layout.first_block[part] - start, layout.splits[part], strict=True)]
        blocks = int((layout.first_block[part] + layout.splits[part]).max()) - start
        member = None
        if blocks * len(gap) <= BLOCK_VALUES:
            member = np.zeros((len(gap), blocks), dtype=np.float32)
            for c, held in enumerate(cell_blocks):
                member[c, held] = 1.0
        near, dist = best_k(vec, ids, vec, ids, k)
        targets, bounds = [], []
        for s in range(0, len(ids), COMPARE_ROWS):
            sl = slice(s, s + COMPARE_ROWS)
            d = layout.distances(vec[sl])
            norm = np.sqrt(((vec[sl] - layout.centre) ** 2).sum(1))
            slack = 1e-6 * (1.0 + norm + d.max(1))
            limit = np.array([x[k - 1] if len(x) >= k else np.inf for x in dist[sl]])
            if len(layout.low) == 1:  # pivots are points of the same part
                other = np.where(d > slack[:, None], d, np.inf)  # pivots that are not the point itself
                if other.shape[1] >= k:
                    limit = np.minimum(limit, np.partition(other, k - 1, axis=1)[:, k - 1])
            c = cell[sl]
            own = d[np.arange(len(c)), c]
            with np.errstate(divide="ignore", invalid="ignore"):
                bisector = (d**2 - own[:, None] ** 2) / (2.0 * gap[c])
            bisector[~np.isfinite(bisector)] = 0.0
            lower = np.maximum(np.maximum(d - high, low - d), bisector)
            visit = (lower <= (limit + slack)[:, None]) & np.isfinite(high)[None, :]
            bounds.append(limit + slack)
            if member is not None:
                hits = visit.astype(np.float32) @ member > 0
                hits[:, mine - start] = False
                targets += np.split(np.nonzero(hits)[1] + start, np.cumsum(hits.sum(1))[:-1])
                continue
            for row in visit:
                cells = np.flatnonzero(row)
                hit = np.unique(np.concatenate([cell_blocks[j] for j in cells])) if len(cells) else np.array([], np.int64)
                targets.append(hit[hit != mine - start] + start)
        return pa.table(
            {
                "part": table.column("part"),
                "pid": table.column("pid"),
                "vec": table.column("vec"),
                "block": table.column("block"),
                "near": _lists(near, pa.int64()),
                "dist": _lists(dist, pa.float64()),
                "bound": pa.array(np.concatenate(bounds)),
                "targets": _lists(targets, pa.int64()),
            }
        )

    return run


def _visit(width: int, k: int):
    def run(queries: pa.Table, base: pa.Table) -> pa.Table:
        near, dist = best_k(
            matrix(queries.column("vec"), width),
            queries.column("pid").to_numpy(),
            matrix(base.column("base_vec"), width),
            base.column("base_id").to_numpy(),
            k,
            queries.column("bound").to_numpy(),
        )
        found = [i for i, x in enumerate(near) if len(x)]
        return pa.table(
            {
                "part": queries.column("part").take(pa.array(found, pa.int64())),
                "pid": queries.column("pid").take(pa.array(found, pa.int64())),
                "near": _lists([near[i] for i in found], pa.int64()),
                "dist": _lists([dist[i] for i in found], pa.float64()),
            }
        )

    return run


def _whole_class(width: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        ids, vec = table.column("id").to_numpy(), matrix(table.column("vec"), width)
        near, dist = best_k(vec, ids, vec, ids, k)
        sizes = np.array([len(x) for x in near])
        rank = np.concatenate([np.arange(1, n + 1) for n in sizes]) if len(sizes) else sizes
        return pa.table(
            {
                "c": table.column("c").combine_chunks().take(pa.array(np.repeat(np.arange(len(ids)), sizes))),
                "id": np.repeat(ids, sizes),
                "rank": pa.array(rank, pa.int32()),
                "neighbour": pa.array(np.concatenate(near), pa.int64()),
                "distance": pa.array(np.concatenate(dist), pa.float64()),
            }
        )

    return run


def point_neighbours(points: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """k nearest other points of the same part, for every point, as ``part, pid, near, dist, rank`` rows.

    ``points`` must be a written table with parts numbered from 0, at most MOST_PARTS; it is scanned
    several times. Blocks grow with the root of their part's points, up to what a task can hold.
    """
    spark = points.sparkSession
    head = points.select(F.size("vec").alias("w")).first()
    if head is None:
        return spark.createDataFrame([], "part int, pid bigint, near bigint, dist double, rank int")
    width = head["w"]
    most = max(64, min(MAX_BLOCK_ROWS, BLOCK_VALUES // max(width, 1)))

    def rows_of_block(n: int) -> int:
        return block_rows or min(most, max(64, math.ceil(BLOCK_ROOTS * math.sqrt(n))))

    layout = _layout(points, points.count(), width)
    celled = _with_cells(points, layout, width)
    stats = (
        celled.groupBy("part", "cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("low"), F.max("own").alias("high"))
        .collect()
    )
    _pack_blocks(layout, stats, rows_of_block)
    sizes: dict[int, int] = {}
    for r in stats:
        sizes[r["part"]] = sizes.get(r["part"], 0) + r["n"]
    at = [r["part"] for r in stats], [r["cell"] for r in stats]
    places = {
        "part": pa.array(at[0], pa.int32()),
        "cell": pa.array(at[1], pa.int32()),
        "first": pa.array(layout.first_block[at], pa.int64()),
        "splits": pa.array(layout.splits[at], pa.int64()),
        "rows": pa.array([rows_of_block(sizes[p]) for p in at[0]], pa.int32()),
    }
    placed = spark.createDataFrame(pa.table(places))
    block = F.col("first") + F.pmod(F.xxhash64("pid"), F.col("splits"))
    blocked = celled.join(F.broadcast(placed), ["part", "cell"]).select("part", "pid", "vec", "cell", block.alias("block"))
    local = cut_lineage(
        blocked.groupBy("block").applyInArrow(
            _own_block(layout, width, k),
            "part int, pid bigint, vec array<double>, block bigint, near array<bigint>, dist array<double>,"
            " bound double, targets array<bigint>",
        )
    )
    found = local.select("part", "pid", "near", "dist")
    visits = local.select("part", "pid", "vec", "bound", F.explode("targets").alias("block"))
    held_rows = F.broadcast(placed.select("part", "rows").distinct())
    chunks = (
        visits.groupBy("part", "block")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(held_rows, "part")
        .select("block", F.ceil(F.col("n") / (2 * F.col("rows"))).cast("bigint").alias("chunks"))
    )
    if chunks.limit(1).count():
        asked = visits.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("pid"), F.col("chunks")))
        held = (
            local.select(F.col("pid").alias("base_id"), F.col("vec").alias("base_vec"), "block")
            .join(chunks, "block")
            .withColumn("base_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        )
        answers = (
            asked.select("part", "pid", "vec", "bound", "block", "chunk")
            .groupBy("block", "chunk")
            .cogroup(
                held.select("base_id", "base_vec", F.col("block").alias("base_block"), "base_chunk").groupBy(
                    "base_block", "base_chunk"
                )
            )
            .applyInArrow(_visit(width, k), "part int, pid bigint, near array<bigint>, dist array<double>")
        )
        found = found.unionByName(answers)
    pairs = found.select("part", "pid", F.explode(F.arrays_zip("near", "dist")).alias("z")).select(
        "part", "pid", "z.near", "z.dist"
    )
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("part", "pid").orderBy("dist", "near")))
    return ranked.filter(F.col("rank") <= k)


def nearest_neighbours(
    df: DataFrame, key: str, vector: str, k: int, block_rows: int | None = None, part: str | None = None
) -> DataFrame:
    """J-3: ``key, rank, neighbour, distance`` for every row, ordered by (distance, neighbour).

    ``part`` names a column of numbers from 0; only rows of one part are compared, and it is kept.
    """
    points = cut_lineage(distinct_points(df, key, vector, k, part))
    near = point_neighbours(points, k, block_rows)
    keys = points.select("part", F.col("pid").alias("near"), F.col("ids").alias("near_ids"))
    per_point = (
        near.join(keys, ["part", "near"])
        .groupBy("part", "pid")
        .agg(F.collect_list(F.struct("dist", "near_ids")).alias("others"))  # at most k entries
    )
    known = points.select("part", "pid", F.col("vec").alias("pvec"), "ids").join(per_point, ["part", "pid"], "left")
    number = F.lit(0) if part is None else F.col(part)
    rows = df.select(
        number.cast("int").alias("own"), F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec")
    )
    # Copies all meet one point row here; adaptive execution splits such a hot key.
    joined = rows.join(
        known.withColumn("ph", F.xxhash64("pvec")),
        (F.col("own") == F.col("part")) & (F.xxhash64("vec") == F.col("ph")) & (F.col("vec") == F.col("pvec")),
    )

    def listed(dist, ids):
        return F.transform(ids, lambda i: F.struct(dist.alias("distance"), i.alias("neighbour")))

    own = listed(F.lit(0.0), F.filter("ids", lambda i: i != F.col("id")))
    others = F.flatten(
        F.transform(F.coalesce("others", F.array()), lambda o: listed(o["dist"], o["near_ids"]))
    )
    best = F.slice(F.array_sort(F.concat(own, others)), 1, k)
    return joined.select("part", "id", F.posexplode(best).alias("rank", "n")).select(
        *([] if part is None else [F.col("part").alias(part)]),
        F.col("id").alias(key),
        (F.col("rank") + 1).alias("rank"),
        F.col("n.neighbour").alias("neighbour"),
        F.col("n.distance").alias("distance"),
    )


def neighbours_in_class(
    df: DataFrame, key: str, vector: str, label: str, k: int, small: int = SMALL_CLASS
) -> DataFrame:
    """J-3 restricted to rows of the same class.

    Classes of at most ``small`` rows are compared whole, one task each; all larger classes
    go through the blocked join together, as parts of it.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    large = [c for c, n in counts.items() if n > small]
    rows = df.select(
        F.col(label).alias("c"),
        F.col(key).cast("bigint").alias("id"),
        F.col(vector).cast("array<double>").alias("vec"),
    )
    names = (label, key, "rank", "neighbour", "distance")
    head = rows.first()
    kind = rows.schema["c"].dataType.simpleString()
    schema = f"c {kind}, id bigint, rank int, neighbour bigint, distance double"
    width = len(head["vec"]) if head else 1

    def numbered(classes: list) -> DataFrame:
        return F.broadcast(df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], f"_c {kind}, _part int"))

    cold = rows
    if large:
        cold = rows.join(numbered(large), F.col("c").eqNullSafe(F.col("_c")), "left_anti")
    out = cold.groupBy("c").applyInArrow(_whole_class(width, k), schema).toDF(*names)
    for s in range(0, len(large), MOST_PARTS):
        parts = numbered(large[s : s + MOST_PARTS])
        hot = rows.join(parts, F.col("c").eqNullSafe(F.col("_c"))).select("id", "vec", "_part")
        found = nearest_neighbours(hot, "id", "vec", k, part="_part").join(parts, "_part")
        out = out.unionByName(found.select("_c", "id", "rank", "neighbour", "distance").toDF(*names))
    return out


def mutual_pairs(df: DataFrame, key: str, vector: str, block_rows: int | None = None) -> DataFrame:
    """J-4: pairs ``a < b`` that are each other's nearest row.

    Within copies the two smallest keys pair up. A point with copies has its nearest row
    among them, so only single points can pair with another point.
    """
    points = cut_lineage(distinct_points(df, key, vector, 1))
    twins = points.filter(F.size("ids") > 1).select(F.col("ids")[0].alias("a"), F.col("ids")[1].alias("b"))
    near = point_neighbours(points, 1, block_rows).select("pid", "near")
    single = points.filter(F.size("ids") == 1).select("pid")
    near = cut_lineage(near.join(single, "pid", "left_semi"))
    back = near.select(F.col("pid").alias("near"), F.col("near").alias("pid"))
    pairs = near.filter("pid < near").join(back, ["pid", "near"]).select(
        F.col("pid").alias("a"), F.col("near").alias("b")
    )
    return pairs.unionByName(twins)
