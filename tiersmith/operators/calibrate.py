"""Class-weight calibration for quadratic weighted kappa (CS-1..3).

A whole population of weight vectors is scored in one pass: each task turns its rows into
label-pair counts per candidate, so only ``candidates * k * k`` numbers leave a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.functions import vectors
from tiersmith.operators.clean import map_value
from tiersmith.operators.neighbours import matrix


def candidate_pairs(df: DataFrame, probability: str, label: str, candidates) -> DataFrame:
    """CS-1: ``candidate, actual, predicted, n`` for arg-max of probability times weights.

    Rows without a label or with null probabilities are not counted; a label beyond the classes raises.
    """
    weights = np.asarray(candidates, dtype=np.float64)
    m, k = weights.shape

    def count(batches):
        total = np.zeros(m * k * k, dtype=np.int64)
        for b in batches:
            p = matrix(b.column("p"), k)
            y = b.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
            if len(y) and not 0 <= y.min() <= y.max() < k:
                raise ValueError(f"labels {y.min()} to {y.max()} don't fit {k} classes")
            for i in range(m):
                cell = (i * k + y) * k + (p * weights[i]).argmax(1)
                total += np.bincount(cell, minlength=m * k * k)
        at = np.flatnonzero(total)
        cols = [at // (k * k), at // k % k, at % k]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int32()) for c in cols], pa.array(total[at], pa.int64())],
            names=["candidate", "actual", "predicted", "n"],
        )

    rows = df.select(F.col(probability).cast("array<double>").alias("p"), F.col(label).cast("int").alias("y")).dropna()
    counts = rows.mapInArrow(count, "candidate int, actual int, predicted int, n bigint")
    return counts.groupBy("candidate", "actual", "predicted").agg(F.sum("n").alias("n"))


def _kappa(cm: np.ndarray) -> float:
    seen = (cm.sum(0) + cm.sum(1)) > 0
    cm = cm[seen][:, seen].astype(float)
    i = np.arange(len(cm))
    w = (i[:, None] - i[None, :]) ** 2
    expected = np.outer(cm.sum(1), cm.sum(0)) / cm.sum()
    return 1 - (w * cm).sum() / (w * expected).sum() if (w * expected).sum() else 0.0


def score_candidates(df: DataFrame, probability: str, label: str, candidates) -> np.ndarray:
    """Kappa of every candidate; at most candidates * k * k counts reach the driver."""
    m, k = np.shape(candidates)
    cms = np.zeros((m, k, k))
    for r in candidate_pairs(df, probability, label, candidates).collect():
        cms[r["candidate"], r["actual"], r["predicted"]] = r["n"]
    return np.array([_kappa(cm) for cm in cms])


def search_weights(
    df: DataFrame,
    probability: str,
    label: str,
    k: int,
    bounds: tuple[float, float] = (0.1, 2.0),
    per_class: int = 15,
    generations: int = 100,
    tol: float = 1e-3,
    seed: int = 1,
) -> tuple[np.ndarray, float]:
    """CS-2: (weights summing to 1, kappa) by differential evolution (best/1/bin, dithered step).

    One Spark job per generation; ``df`` should be persisted or a written table. Stops when
    the population's scores agree to a relative ``tol``.
    """
    rng = np.random.default_rng(seed)
    size = per_class * k
    strata = np.array([rng.permutation(size) for _ in range(k)]).T  # one member per stratum and class
    pop = bounds[0] + (strata + rng.random((size, k))) / size * (bounds[1] - bounds[0])
    loss = -score_candidates(df, probability, label, pop)
    for _ in range(generations):
        if loss.std() <= tol * abs(loss.mean()):
            break
        step = rng.uniform(0.5, 1.0)
        best = pop[loss.argmin()]
        pairs = np.array([rng.choice(np.delete(np.arange(size), i), 2, replace=False) for i in range(size)])
        mutant = best + step * (pop[pairs[:, 0]] - pop[pairs[:, 1]])
        cross = rng.random((size, k)) < 0.7
        cross[np.arange(size), rng.integers(0, k, size)] = True
        trial = np.where(cross, mutant, pop)
        outside = (trial < bounds[0]) | (trial > bounds[1])
        trial[outside] = rng.uniform(*bounds, outside.sum())
        got = -score_candidates(df, probability, label, trial)
        better = got <= loss
        pop[better], loss[better] = trial[better], got[better]
    best = pop[loss.argmin()]
    return best / best.sum(), float(-loss.min())


def apply_weights(
    df: DataFrame, probability: str, weights: Sequence[float], labels: Mapping[int, str] | None = None
) -> DataFrame:
    """CS-3: adjusted arg-max, normalised confidence and, with ``labels``, the class text (PF-21)."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    scaled: Column = vectors.weighted(F.col(probability), w)
    out = df.withColumn("_scaled", scaled).withColumns(
        {
            "prediction": vectors.argmax(F.col("_scaled")),
            "confidence": vectors.rounded(vectors.normalised(F.col("_scaled")), 4),
        }
    )
    if labels is not None:
        text = F.coalesce(map_value(F.col("prediction"), labels), F.concat(F.lit("Tier "), F.col("prediction")))
        out = out.withColumn("prediction_label", text)
    return out.drop("_scaled")
