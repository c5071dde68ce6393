import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tiersmith.operators import pls, ranking, sampling


def frame(spark, x, y, ids=None):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), int(c), [float(v) for v in r]) for i, c, r in zip(ids, y, x, strict=True)]
    return spark.createDataFrame(rows, "key bigint, label int, v array<double>")


def test_targets():
    assert sampling.undersample_target({0: 100, 1: 10}) == {0: 25}
    assert sampling.undersample_target({0: 100, 1: 40}) == {0: 40}
    assert sampling.undersample_target({0: 10, 1: 40}) == {0: 10}
    assert sampling.undersample_target({1: 40}) == {}
    assert sampling.oversample_target({3: 100, 4: 10}) == {4: 50}
    assert sampling.oversample_target({3: 10, 4: 10}) == {}
    assert sampling.oversample_target({4: 10}) == {}
    assert sampling.oversample_target({3: 10}) == {}


def test_exact_counts_and_cut_paths(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").alias("key"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    whole = {r["key"] for r in ranking.take_per_class(df, "label", "key", {0: 777}, 3).collect()}
    assert len(whole) == 777 + 1667
    monkeypatch.setattr(ranking, "PREFIX_DIGITS", 1)  # more passes
    assert {r["key"] for r in ranking.take_per_class(df, "label", "key", {0: 777}, 3).collect()} == whole
    ranked = ranking.class_rank(df, "label", "key", 3).filter("label = 0 and class_rank <= 777")
    assert {r["key"] for r in ranked.collect()} == {k for k in whole if k % 3}
    test = ranking.mark_split(df, "label", "key", 0.2, 1).filter("is_test").groupBy("label").count().collect()
    assert sorted((r["label"], r["count"]) for r in test) == [(0, 667), (1, 333)]
    folds = ranking.assign_folds(df, "label", "key", 5).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in folds if r["label"] == 1} == {333, 334} and len(folds) == 10


def test_repeated_keys_are_refused(spark):
    from tiersmith.plans.cleaning import with_row_key

    rows = spark.createDataFrame([(1, 0, [0.0]), (1, 0, [1.0]), (2, 4, [1.0]), (3, 4, [2.0])], "id bigint, label int, v array<double>")
    rows = rows.withColumn("features", array_to_vector("v"))
    with pytest.raises(ValueError, match="id = 1 stands on 2 rows"):
        sampling.smotenc(rows, "id", "label", "features", {4: 5}, 1)
    keyed = with_row_key(rows)
    assert sampling.smotenc(keyed, "key", "label", "features", {4: 5}, 1).count() == 7


def test_smotenc_geometry(spark):
    rng = np.random.default_rng(0)
    y = np.array([0] * 60 + [3] * 40 + [4] * 8)
    x = np.column_stack([rng.normal(size=108), rng.normal(size=108) * 5, rng.integers(0, 2, 108)])
    df = frame(spark, x, y).withColumn("features", array_to_vector("v"))
    out = sampling.Smotenc(neighbours=3).resample(df).withColumn("v", vector_to_array("features"))
    rows = {r["key"]: (r["label"], np.array(r["v"])) for r in out.collect()}
    assert len(rows) == 108 + 12
    made = [v for k, (c, v) in rows.items() if k >= 108]
    assert all(rows[k][0] == 4 for k in rows if k >= 108)
    own = x[y == 4]
    std = np.median(own[:, :2].std(axis=0))
    mixed = np.column_stack([own[:, :2], own[:, 2] * std])
    d = np.sqrt(((mixed[:, None] - mixed[None]) ** 2).sum(-1))
    near = np.argsort(d + np.eye(8) * 1e9, axis=1)[:, :3]
    for v in made:
        fits = []
        for i in range(8):
            vote = float(own[near[i], 2].sum() * 2 > 3)
            for j in near[i]:
                span = own[j, :2] - own[i, :2]
                t = (v[:2] - own[i, :2]) / span
                fits.append(abs(t[0] - t[1]) < 1e-9 and -1e-9 <= t[0] <= 1 and v[2] == vote)
        assert any(fits)
    again = {r["key"]: r["v"] for r in out.collect()}
    assert all(list(v) == again[k] for k, (_, v) in rows.items())


def test_tomek_removes_all_but_smallest(spark):
    x = [[0.0], [0.1], [5.0], [5.1], [9.0], [9.3], [20.0]]
    y = [0, 1, 0, 0, 1, 2, 2]
    left = sampling.remove_tomek(frame(spark, x, y), "key", "label", "v", {0: 3, 1: 2, 2: 1}).collect()
    assert sorted(r["key"] for r in left) == [2, 3, 5, 6]


def test_pls_matches_nipals(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 4, 200)
    x = rng.normal(size=(200, 12)) + np.eye(4, 12)[y] * 2
    x[:, 11] = 3.0
    df = frame(spark, x, y)
    mean, scale, rot = pls.fit_pls(df, "v", "label", 5)
    xs = (x - x.mean(0)) / np.where(x.std(0, ddof=1) == 0, 1, x.std(0, ddof=1))
    ys = np.eye(4)[y]
    ys = (ys - ys.mean(0)) / ys.std(0, ddof=1)
    want = []
    e, f = xs.copy(), ys.copy()
    for _ in range(5):
        u = f[:, 0]
        for _ in range(5000):
            w = e.T @ u
            w /= np.linalg.norm(w)
            t = e @ w
            q = f.T @ t / (t @ t)
            u = f @ q / (q @ q)
        p = e.T @ t / (t @ t)
        e, f = e - np.outer(t, p), f - np.outer(t, q)
        want.append(t)
    got = np.array([r["s"] for r in df.orderBy("key").select(pls.project(F.col("v"), mean, scale, rot).alias("s")).collect()])
    want = np.array(want).T
    want *= np.sign((want * got).sum(0))
    assert np.allclose(got, want, atol=1e-6)


def test_correlation_pruning(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=50)
    x = np.column_stack([a, a + rng.normal(size=50) * 0.01, rng.normal(size=50), np.ones(50), -a])
    df = frame(spark, x, [0] * 50).withColumn("features", array_to_vector("v"))
    model = pls.CorrelationPruner(threshold=0.95).fit(df)
    assert model.get("indices") == [0, 2, 3]
    assert len(model.transform(df).first()["features"]) == 3


def test_unlabelled_rows_stay_out_of_samples(spark):
    df = spark.range(40).select(F.col("id").alias("key"), F.when(F.col("id") > 9, F.col("id") % 2).alias("label"))
    assert ranking.class_counts(df, "label") == {0: 15, 1: 15}
    marked = ranking.mark_split(df, "label", "key", 0.2, 1)
    assert marked.count() == 40 and marked.filter("is_test").count() == 6
    assert marked.filter("is_test and label is null").count() == 0
    assert ranking.class_rank(df, "label", "key").filter("label is null").agg(F.max("class_rank")).first()[0] == 10
