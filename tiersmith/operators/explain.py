"""Attribution jobs on the cluster (EX-1..3): sampled Shapley values and local surrogates.

Both turn rows to explain into perturbed rows, score all of them in one ``transform`` and
aggregate. Backgrounds are bounded samples in hash order, so they are the only thing sent
to every task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiersmith.operators.aggregates import first_per_class
from tiersmith.operators.neighbours import _lists, matrix
from tiersmith.operators.ranking import class_counts, order_hash, proportional_allocation, take_per_class


def background_matrix(df: DataFrame, features: str, key: str, size: int = 200, seed: int = 1) -> np.ndarray:
    """At most ``size`` rows in hash order."""
    rows = df.select(vector_to_array(features).alias("v"), order_hash(key, seed).alias("h"), key)
    return np.array([r["v"] for r in rows.orderBy("h", key).limit(size).collect()])


def explain_sample(df: DataFrame, label: str, key: str, size: int = 2000, seed: int = 1) -> DataFrame:
    """EX-1: all rows, or a stratified sample of exactly ``size`` when there are more."""
    counts = class_counts(df, label)
    if sum(counts.values()) <= size:
        return df
    return take_per_class(df, label, key, proportional_allocation(counts, size), seed, counts)


WALK_VALUES = 2_000_000  # doubles of walks that a task builds at once


def _scrambled(*parts: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit numbers from arrays of whole numbers that are broadcast together."""
    h = np.uint64(0)
    for part in parts:
        h = (h ^ np.asarray(part).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
    return h


def _walks(background: np.ndarray, permutations: int, seed: int):
    """Every row becomes d+1 rows per permutation, switching one feature at a time to its own value.

    Orders and background rows follow from hashes of key, walk and slot, for a whole batch at once.
    """
    d = background.shape[1]

    def built(keys: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        n, walk, step = len(keys), np.arange(permutations), np.arange(d + 1)
        mine = _scrambled(np.uint64(seed), keys[:, None], walk[None, :])
        order = np.argsort(_scrambled(mine[:, :, None], np.arange(d)[None, None, :]), axis=2, kind="stable")
        place = np.argsort(order, axis=2, kind="stable")
        start = background[(mine % np.uint64(len(background))).astype(np.int64)]
        own = place[:, :, None, :] < step[None, None, :, None]
        rows = np.where(own, x[:, None, None, :], start[:, :, None, :]).reshape(-1, d)
        slots = np.concatenate([np.full((n, permutations, 1), -1), order], axis=2).ravel()
        offsets = np.arange(0, d * len(rows) + 1, d, dtype=np.int32) if d else np.zeros(len(rows) + 1, np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(keys, permutations * (d + 1)), pa.int64()),
                pa.array(np.tile(np.repeat(walk, d + 1), n), pa.int32()),
                pa.array(np.tile(step, n * permutations), pa.int32()),
                pa.array(slots, pa.int32()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), pa.float64())),
            ],
            names=["key", "walk", "step", "slot", "v"],
        )

    def run(batches):
        size = max(1, WALK_VALUES // max(1, permutations * (d + 1) * d))
        for b in batches:
            keys, x = b.column("key").to_numpy(zero_copy_only=False).astype(np.int64), matrix(b.column("v"), d)
            for a in range(0, len(keys), size):
                yield built(keys[a : a + size], x[a : a + size])

    return run


def shapley(
    df: DataFrame, model, background: np.ndarray, key: str, features: str = "features",
    permutations: int = 10, seed: int = 1,
) -> DataFrame:
    """EX-1: ``key, slot, class, attribution``, averaged over permutations.

    For each key and class the attributions add up to its probability minus the mean
    probability of the background rows its walks started from.
    """
    rows = df.select(F.col(key).cast("bigint").alias("key"), vector_to_array(features).alias("v"))
    walks = rows.mapInArrow(
        _walks(background, permutations, seed), "key bigint, walk int, step int, slot int, v array<double>"
    )
    scored = model.transform(walks.withColumn("features", array_to_vector("v")))
    before = F.lag("p").over(Window.partitionBy("key", "walk").orderBy("step"))  # d + 1 rows
    gains = (
        scored.select("key", "walk", "step", "slot", vector_to_array("probability").alias("p"))
        .withColumn("gain", F.zip_with("p", before, lambda a, b: a - b))
        .filter("step > 0")
    )
    long = gains.select("key", "slot", F.posexplode("gain").alias("class", "gain"))
    return long.groupBy("key", "slot", "class").agg(F.avg("gain").alias("attribution"))


def global_importance(attributions: DataFrame) -> DataFrame:
    """EX-1: mean absolute attribution per class and slot."""
    return attributions.groupBy("class", "slot").agg(F.avg(F.abs("attribution")).alias("mean_abs"))


def real_units(
    df: DataFrame, features: str, names: Sequence[str], stats: Mapping[str, Sequence[float]], out: str = "real"
) -> DataFrame:
    """EX-3: feature array with scaled numeric slots back in their own units."""
    scale = F.array(*[F.lit(float(stats[n][2]) if n in stats else 1.0) for n in names])
    centre = F.array(*[F.lit(float(stats[n][1]) if n in stats else 0.0) for n in names])
    scaled = F.zip_with(vector_to_array(features), scale, lambda v, s: v * s)
    return df.withColumn(out, F.zip_with(scaled, centre, lambda v, c: v + c))


def _neighbourhood(background: np.ndarray, edges: np.ndarray, seed: int):
    """The rows around instances: every feature drawn from the background by hash; draw 0 is the instance itself."""

    def bins(x):
        return (x[..., None] > edges.T).sum(-1)

    def run(batches):
        d = background.shape[1]
        for b in batches:
            x, draw = matrix(b.column("v"), d), b.column("draw").to_numpy()
            keys = b.column("key").to_numpy().astype(np.uint64)
            pick = _scrambled(np.uint64(seed), keys[:, None], draw[:, None], np.arange(d)[None, :]) % np.uint64(len(background))
            rows = np.where(draw[:, None] == 0, x, background[pick.astype(np.int64), np.arange(d)])
            same = (bins(rows) == bins(x)).astype(float)
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("target"), b.column("draw"), _lists(list(rows), pa.float64()), _lists(list(same), pa.float64())],
                names=["key", "target", "draw", "v", "same"],
            )

    return run


def _moments(d: int):
    """Kernel-weighted sums of a batch, one row per instance: w, wy, y of draw 0, wz, wzy and wzz'."""

    def run(batches):
        width = 0.75 * np.sqrt(d)
        for b in batches:
            z, y, draw = matrix(b.column("same"), d), b.column("p").to_numpy(), b.column("draw").to_numpy()
            w = np.sqrt(np.exp(-(d - z.sum(1)) / width**2))
            keys, first, of = np.unique(b.column("key").to_numpy(), return_index=True, return_inverse=True)
            sums = []
            for i in range(len(keys)):
                mine = np.flatnonzero(of == i)
                zi, wi, yi = z[mine], w[mine], y[mine]
                weighted = zi * wi[:, None]
                sums.append(np.concatenate([
                    [wi.sum(), wi @ yi, yi[draw[mine] == 0].sum()], weighted.sum(0), yi @ weighted, (zi.T @ weighted).ravel(),
                ]))
            target = b.column("target").take(pa.array(first))
            yield pa.RecordBatch.from_arrays([pa.array(keys), target, _lists(sums, pa.float64())], names=["key", "target", "sums"])

    return run


def _ridge(d: int, top: int):
    """Coefficients from an instance's sums: centred by the weighted means, with a unit penalty on each."""

    def run(batches):
        for b in batches:
            for key, target, sums in zip(*(b.column(c).to_pylist() for c in ("key", "target", "sums")), strict=True):
                w, wy, p = sums[:3]
                wz, wzy, gram = np.split(np.array(sums[3:]), [d, 2 * d])
                zm, ym = wz / w, wy / w
                coef = np.linalg.solve(gram.reshape(d, d) - w * np.outer(zm, zm) + np.eye(d), wzy - w * ym * zm)
                order = np.lexsort((np.arange(d), -np.abs(coef)))[:top]
                n = len(order)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * n, pa.int64()), pa.array([target] * n, pa.int32()), pa.array(order.astype(np.int32)),
                        pa.array(coef[order]), pa.array(np.full(n, ym - zm @ coef)), pa.array(np.full(n, p)),
                    ],
                    names=["key", "target", "slot", "coefficient", "intercept", "probability"],
                )

    return run


def ridge_surrogates(scored: DataFrame, d: int, top: int) -> DataFrame:
    """A weighted ridge model per ``key`` over rows ``(key, target, draw, same, p)``, its ``top`` coefficients by size.

    Batches become sums, sums of an instance are added by a plain aggregate, and only its ``d`` by ``d``
    system is solved in one place; so an instance may have any number of rows.
    """
    parts = scored.select("key", "target", "draw", "same", "p").mapInArrow(_moments(d), "key bigint, target int, sums array<double>")
    added = parts.groupBy("key", "target").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
    return added.select("key", "target", vector_to_array("sums").alias("sums")).mapInArrow(
        _ridge(d, top), "key bigint, target int, slot int, coefficient double, intercept double, probability double"
    )


def surrogates(
    df: DataFrame, model, background: np.ndarray, key: str, prediction: str, features: str = "features",
    samples: int = 1000, top: int = 10, seed: int = 1,
) -> DataFrame:
    """EX-2: a local linear model for the first row of every predicted class.

    A perturbed feature counts as unchanged while it stays in the instance's background
    quartile. Draws follow from hashes of instance, draw and feature, so any task can make any of them.
    """
    edges = np.quantile(background, [0.25, 0.5, 0.75], axis=0)
    chosen = first_per_class(
        df.select(F.col(key).alias("key"), F.col(prediction).cast("int").alias("target"), vector_to_array(features).alias("v")),
        "target", "key", ["v"],
    ).select(F.col("key").cast("bigint").alias("key"), "target", "v")
    drawn = chosen.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    rows = drawn.mapInArrow(
        _neighbourhood(background, edges, seed), "key bigint, target int, draw int, v array<double>, same array<double>"
    )
    scored = model.transform(rows.withColumn("features", array_to_vector("v")))
    p = F.get(vector_to_array("probability"), F.col("target"))
    return ridge_surrogates(scored.withColumn("p", p), background.shape[1], top)
