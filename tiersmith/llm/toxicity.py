"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has its own rate; the L1 term leaves few weights, which travel as a sparse
broadcast bounded by the number of slots.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.llm import ftrl

FEATURES = ftrl.Features(fold_case=True, marks=False, gaps=(1, 2))
SETTINGS = ftrl.Settings(rate=4.0, l1=4.0, epochs=8)
THRESHOLD = 0.7


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
    features: ftrl.Features = FEATURES, settings: ftrl.Settings = SETTINGS,
) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights from the labelled texts; at most ``settings.sample`` rows are learnt from."""
    return ftrl.train(docs, labels, label, features, settings, id_col, text_col)


def toxicity(
    model: tuple[np.ndarray, np.ndarray], text_col: str = "text", features: ftrl.Features = FEATURES
) -> Column:
    """Score from 0 to 1 of each whole text. Empty and null texts get the prior; no row is dropped."""
    return ftrl.score_column(F.col(text_col), model, features)
