"""Catalogue training job: pipeline, calibration, evaluation, production refit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from tiersmith.operators import sampling
from tiersmith.operators.calibrate import apply_weights, search_weights
from tiersmith.operators.encoders import BlockAssembler, ListTextEncoder, NumericEncoder
from tiersmith.operators.metrics import class_report, confusion, macro_metrics
from tiersmith.operators.models import BoostedTrees, ImportanceSelector
from tiersmith.operators.pipeline import ImbalancePipeline, out_of_fold
from tiersmith.operators.pls import CorrelationPruner, PlsDa
from tiersmith.operators.ranking import mark_split, require_unique
from tiersmith.plans import catalogue as cat
from tiersmith.session import cut_lineage


def feature_stages(
    terms: int = 15,
    components: int = 20,
    key: str = "steam_appid",
    label: str = cat.TARGET,
    selector: Estimator | None = None,
    threshold: str = "median",
    stop_words: Sequence[str] | None = None,
    creators: int = 50,
    neighbours: int = 3,
    seed: int = 1,
) -> list:
    """The ordered feature stages and resamplers; ``selector`` adds importance-based selection.

    Slot order is scaled numbers, one-hot month, plain flags, list/text block, PLS scores:
    correlation pruning keeps the earlier of two similar slots, so the order matters.
    """
    names = {"keyCol": key, "labelCol": label}
    stages = [
        ListTextEncoder(
            listCols=cat.MULTI_HOT,
            creatorCols=cat.CREATORS,
            textCol="short_description",
            topN=creators,
            maxTerms=terms,
            fillCol="min_ram_gb",
            backfillCol="rec_ram_gb",
            outputCol="encoded",
            **({"stopWords": list(stop_words)} if stop_words is not None else {}),
        ),
        NumericEncoder(
            numericCols=cat.NUMERIC_FEATURES, categoricalCols=cat.CATEGORICAL_FEATURES, outputCol="scaled"
        ),
        sampling.Undersample(seed=seed, **names),
        PlsDa(embeddingCol="embedding", labelCol=label, components=components, outputCol="pls"),
        BlockAssembler(inputCols=["scaled", *cat.BINARY_FLAGS, "encoded", "pls"]),
        CorrelationPruner(threshold=0.95),
        sampling.Smotenc(neighbours=neighbours, seed=seed, **names),
        sampling.RemoveTomek(**names),
    ]
    if selector is not None:
        stages.append(ImportanceSelector(selector, threshold=threshold, labelCol=label))
    return stages


def boosted(scope: str, **over) -> BoostedTrees:
    """ML-3 with the settings of a feature scope."""
    return BoostedTrees(**{**cat.BOOSTING[scope], "size": len(cat.TIER_LABELS), **over})


@dataclass
class Trained:
    evaluated: PipelineModel
    production: PipelineModel
    weights: np.ndarray
    scored_test: DataFrame
    metrics: DataFrame
    report: DataFrame
    confusion: DataFrame


def train(
    df: DataFrame,
    make,
    key: str = "steam_appid",
    label: str = cat.TARGET,
    classes: int = 5,
    folds: int = 5,
    generations: int = 100,
    per_class: int = 15,
    seed: int = 1,
) -> Trained:
    """Split, fit, calibrate out of fold, evaluate on the held-out part, refit on everything (ML-6).

    ``df`` should be a written table, since every fit scans it, and ``key`` be unique (see
    ``cleaning.with_row_key``); ``make`` returns an unfitted
    pipeline. Weights found on the 80 % model are kept for the
    production refit.
    """
    require_unique(df, key)
    split = mark_split(df, label, key, 0.2, seed)
    fit_rows, held_out = split.filter("NOT is_test").drop("is_test"), split.filter("is_test").drop("is_test")
    evaluated = make().fit(fit_rows)
    oof = out_of_fold(fit_rows, make, label, key, folds, seed)
    weights, _ = search_weights(
        oof, "probability", label, classes, per_class=per_class, generations=generations, seed=seed
    )
    raw = evaluated.transform(held_out).select(
        key, label, "features", vector_to_array("probability").alias("probability")
    )
    scored = cut_lineage(apply_weights(raw, "probability", weights, cat.TIER_LABELS))
    return Trained(
        evaluated,
        make().fit(split.drop("is_test")),
        weights,
        scored,
        macro_metrics(scored, label, "prediction"),
        class_report(scored, label, "prediction"),
        confusion(scored, label, "prediction", list(range(classes))),
    )


def catalogue_pipeline(scope: str, key: str = "steam_appid", label: str = cat.TARGET, **over) -> ImbalancePipeline:
    """The production pipeline of a scope, with boosted selection and classifier."""
    selector = BoostedTrees(trees=100, size=len(cat.TIER_LABELS))
    return ImbalancePipeline(feature_stages(key=key, label=label, selector=selector, **over), boosted(scope), label)
