"""The scoring job on a stream of record files (CS-4)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tiersmith.plans.scoring import score
from tiersmith.streaming.batches import store_stream


def score_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    model: PipelineModel,
    weights: Sequence[float],
    embed: Callable[[DataFrame], DataFrame],
    scope: str = "post",
) -> StreamingQuery:
    """Score JSON-lines files as they arrive: one running query stores ``scored`` and ``rejected`` rows per batch."""

    def split(batch: DataFrame) -> dict[str, DataFrame]:
        return dict(zip(("scored", "rejected"), score(batch, model, weights, embed, scope), strict=True))

    return store_stream(spark.readStream.text(source), target, checkpoint, split)
