import numpy as np
import pytest
from edge_tables import ROWS, docs
from pyspark.sql import functions as F

from tiersmith.llm import mixing, queries


def test_rake_meets_the_margins():
    rng = np.random.default_rng(1)
    table = rng.integers(1, 50, (4, 3, 2)).astype(float)
    shares = [np.array(s) / sum(s) for s in ([1, 2, 3, 4], [5, 1, 1], [1, 1])]
    fitted = mixing.rake(table, shares, 60)
    for axis, share in enumerate(shares):
        assert np.allclose(fitted.sum(axis=tuple(i for i in range(3) if i != axis)), share, atol=1e-9)
    # Odds within the table are kept.
    odds = lambda t: t[0, 0, 0] * t[1, 1, 0] / (t[0, 1, 0] * t[1, 0, 0])
    assert odds(fitted) == pytest.approx(odds(table))


def test_scale_keeps_the_share():
    rng = np.random.default_rng(2)
    for keep in (0.1, 0.5, 0.9, 1.0):
        tokens, ratios = rng.integers(1, 90, 30).astype(float), rng.uniform(0.1, 20, 30)
        scale = mixing.keep_scale(tokens, ratios, keep)
        assert (tokens * np.minimum(1, scale * ratios)).sum() == pytest.approx(keep * tokens.sum())
    assert mixing.keep_scale(np.zeros(0), np.zeros(0), 0.5) == float("inf")


def test_absent_and_unlisted_categories():
    shares = mixing.target_shares(np.array([30.0, 0.0, 10.0, 10.0]), [1, 5, 3])
    assert np.allclose(shares, [0.2, 0.0, 0.6, 0.2])
    assert np.allclose(mixing.target_shares(np.array([0.0, 7.0]), [1]), [0, 1])


def test_edges(spark):
    rows = docs(spark, probability=3, ratio="x")
    found = mixing.with_probabilities(rows, queries.mixture(), mixing.word_count(F.col("text"))).collect()
    assert len(found) == len(ROWS) and all(0 <= r["_mix_probability"] <= 1 for r in found)
    kept = mixing.sample_mixture(rows, queries.mixture(), mixing.word_count(F.col("text")), keep=1.0)
    assert kept.columns == rows.columns and kept.count() == len(ROWS)
    assert mixing.sample_mixture(docs(spark, []), queries.mixture(), mixing.word_count(F.col("text"))).count() == 0


def test_sampled_tokens_have_the_target_shares(spark):
    rows = [(i, "a b c d " * (1 + i % 7), ["en", "de"][i % 3 == 0], f"src{i % 2 if i % 10 else 2}", 1) for i in range(30_000)]
    kinds = {"source": (F.col("source"), {"src0": 1, "src1": 1, "src2": 1}), "lang": (F.col("lang"), {"en": 1, "de": 1})}
    count = mixing.word_count(F.col("text"))
    kept = mixing.sample_mixture(docs(spark, rows), kinds, count, keep=0.2).withColumn("n", count)
    total = kept.agg(F.sum("n")).first()[0]
    for c, share in (("source", 1 / 3), ("lang", 1 / 2)):
        assert all(abs(r.n / total - share) < 0.03 for r in kept.groupBy(c).agg(F.sum("n").alias("n")).collect())
