"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.llm import ftrl

FEATURES = ftrl.Features(fold_case=False, marks=True, gaps=(1,), repeats=True)
SETTINGS = ftrl.Settings()
THRESHOLD = 0.3


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
    features: ftrl.Features = FEATURES, settings: ftrl.Settings = SETTINGS,
) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights from the labelled texts; at most ``settings.sample`` rows are learnt from."""
    return ftrl.train(docs, labels, label, features, settings, id_col, text_col)


def quality(
    model: tuple[np.ndarray, np.ndarray], text_col: str = "text", features: ftrl.Features = FEATURES
) -> Column:
    """Score from 0 to 1 of each whole text. Empty and null texts get the prior; no row is dropped."""
    return ftrl.score_column(F.col(text_col), model, features)
