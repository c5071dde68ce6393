"""Scoring job: records to calibrated tiers (CS-4, PF-19..21)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersmith.operators import clean
from tiersmith.operators.calibrate import apply_weights
from tiersmith.plans import catalogue as cat
from tiersmith.plans.cleaning import feature_scope
from tiersmith.sources.records import read_records

RECORD_SCHEMA = "name string, " + ", ".join(f"{c} {kind}" for c, (kind, _) in cat.PAYLOAD.items())


def score(
    lines: DataFrame,
    model: PipelineModel,
    weights: Sequence[float],
    embed: Callable[[DataFrame], DataFrame],
    scope: str = "post",
    schema: str = RECORD_SCHEMA,
    col: str = "value",
) -> tuple[DataFrame, DataFrame]:
    """(scored, rejected) for JSON record text; every step is row-local, so it also runs on streams.

    ``embed`` adds the ``embedding`` column: a join of precomputed vectors, or an encoder.
    Rejected rows carry ``reason``: malformed JSON or forbidden script.
    """
    others = [c for c in lines.columns if c != col]
    records, malformed = read_records(lines.withColumn("_raw", F.col(col)), schema, col)
    accepted, foreign = clean.guard(
        records, ["name", "short_description", "detailed_description"], cat.FORBIDDEN_SCRIPTS
    )
    padded = clean.pad(accepted, cat.PAYLOAD)
    ready = embed(feature_scope(padded, scope))
    scored = model.transform(ready).withColumn("probability", vector_to_array("probability"))
    out = apply_weights(scored, "probability", weights, cat.TIER_LABELS)
    rejected = malformed.select(*others, F.col("_raw").alias(col), F.lit("malformed").alias("reason")).unionByName(
        foreign.select(*others, F.col("_raw").alias(col), F.lit("script").alias("reason"))
    )
    kept = ["name", "imputed_keys", "probability", "prediction", "confidence", "prediction_label"]
    return out.select(*others, *kept), rejected
