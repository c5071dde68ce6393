import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tiersmith.operators import encoders, explain, models, pipeline
from tiersmith.plans import catalogue as cat
from tiersmith.plans import scoring, training
from tiersmith.streaming.batches import read_commits
from tiersmith.streaming.scoring import score_stream

WORDS = ["space", "farm", "race", "puzzle", "zombie", "castle"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i, tier in enumerate(np.repeat([0, 1, 2, 3, 4], [90, 40, 30, 26, 8])):
        row = {c: v for c, (_, v) in cat.PAYLOAD.items()}
        row |= {
            "steam_appid": i, "name": f"g{i}", "target_owners": int(tier), "price": float(tier * 5 + rng.normal()),
            "release_month": int(rng.integers(1, 5)), "genres": [WORDS[tier], WORDS[int(rng.integers(6))]],
            "publishers": [f"p {int(rng.integers(3))}"], "num_dlc": int(rng.integers(0, 4)),
            "short_description": f"the {WORDS[tier]} {WORDS[int(rng.integers(6))]} game",
            "min_ram_gb": float(tier + 1) if i % 4 else None, "rec_ram_gb": None, "req_mid_cpu": int(rng.integers(2)),
            "review_ratio": float(rng.random()),
            "embedding": [float(x) for x in rng.normal(size=6) + np.eye(6)[tier] * 4],
        }
        rows.append(row)
    schema = ", ".join(f"{c} {t}" for c, (t, _) in cat.PAYLOAD.items())
    schema += ", steam_appid bigint, name string, target_owners int, embedding array<double>"
    names = [f.split(" ")[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema).repartition(2).cache()


def make():
    stages = training.feature_stages(terms=5, components=3, selector=models.random_forest(trees=5, depth=3))
    return pipeline.ImbalancePipeline(stages, models.random_forest(trees=8, depth=4), cat.TARGET)


@pytest.fixture(scope="module")
def trained(table):
    return training.train(table, make, folds=2, generations=2, per_class=2)


def test_training_job(table, trained):
    assert trained.scored_test.count() == math.ceil(0.2 * table.count())
    m = trained.metrics.first()
    assert m["quadratic_weighted_kappa"] > 0.6
    names = pipeline.slot_names(trained.production.stages)
    width = len(trained.scored_test.first()["features"])
    assert len(pipeline.slot_names(trained.evaluated.stages)) == width
    assert any(n.startswith("pls_da_") for n in names)


def test_scoring_batch_and_stream(spark, table, trained, tmp_path):
    good = [json.dumps({"name": f"n{i}", "price": 3.0, "genres": ["farm"], "steam_appid": i}) for i in range(5)]
    lines = [*good, "{oops", json.dumps({"name": "Игра"}), "{}"]
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(lines), encoding="utf8")

    def embed(df):
        return df.withColumn("embedding", F.array(*[F.lit(0.5)] * 6)).drop("detailed_description")

    scored, rejected = scoring.score(spark.read.text(str(src)), trained.production, trained.weights, embed)
    batch = {r["name"]: r["prediction"] for r in scored.collect()}
    assert len(batch) == 6 and {r["reason"] for r in rejected.collect()} == {"malformed", "script"}
    assert all(r["prediction_label"].startswith("Class") for r in scored.collect())
    out = str(tmp_path / "out")
    query = score_stream(spark, str(src), out, str(tmp_path / "cp"), trained.production, trained.weights, embed)
    query.awaitTermination(120)
    streamed = {r["name"]: r["prediction"] for r in spark.read.parquet(f"{out}/scored").collect()}
    assert streamed == batch
    assert spark.read.parquet(f"{out}/rejected").count() == 2
    assert {r["part"]: r["rows"] for r in read_commits(spark, out).collect()} == {"": 8, "scored": 6, "rejected": 2}


def test_shapley_adds_up_and_surrogates(spark, trained):
    model, rows = trained.evaluated.stages[-1], trained.scored_test.select("steam_appid", cat.TARGET, "features")
    background = explain.background_matrix(rows, "features", "steam_appid", 1)
    sample = explain.explain_sample(rows, cat.TARGET, "steam_appid", 10)
    assert sample.count() == 10
    values = explain.shapley(sample, model, background, "steam_appid", permutations=3).collect()
    start = spark.createDataFrame([([float(v) for v in background[0]],)], "v array<double>")
    base = model.transform(start.select(array_to_vector("v").alias("features"))).first()["probability"].toArray()
    for r in model.transform(sample).collect():
        for c in range(5):
            total = sum(v["attribution"] for v in values if v["key"] == r["steam_appid"] and v["class"] == c)
            assert total == pytest.approx(r["probability"][c] - base[c], abs=1e-9)
    background = explain.background_matrix(rows, "features", "steam_appid", 30)
    local = explain.surrogates(
        trained.scored_test.select("steam_appid", "features", "prediction"), model, background,
        "steam_appid", "prediction", samples=200, top=3,
    ).collect()
    classes = {r["prediction"] for r in trained.scored_test.collect()}
    assert {r["target"] for r in local} == classes and len(local) == 3 * len(classes)


def test_surrogates_equal_a_plain_weighted_solve(spark):
    rng, want, rows = np.random.default_rng(0), {}, []
    for key in (1, 2, 3):
        z = rng.integers(0, 2, size=(400, 4)).astype(float)
        y = 0.2 + 0.5 * z[:, 1] - 0.3 * z[:, 3] + 0.1 * key * rng.random(400)
        w = np.sqrt(np.exp(-(1 - z).sum(1) / (0.75 * 2) ** 2))
        zc, yc = z - np.average(z, axis=0, weights=w), y - np.average(y, weights=w)
        coef = np.linalg.solve(zc.T @ (zc * w[:, None]) + np.eye(4), zc.T @ (w * yc))
        want[key] = (coef, np.average(y, weights=w) - np.average(z, axis=0, weights=w) @ coef, y[0])
        rows += [(key, 0, i, z[i].tolist(), float(y[i])) for i in range(400)]
    frame = spark.createDataFrame(rows, "key long, target int, draw int, same array<double>, p double").repartition(5)
    got = explain.ridge_surrogates(frame, 4, 2).collect()
    assert len(got) == 6 and {r.slot for r in got} == {1, 3}
    for r in got:
        coef, intercept, p = want[r.key]
        assert (r.coefficient, r.intercept, r.probability) == pytest.approx((coef[r.slot], intercept, p), abs=1e-10)


def test_neighbourhood_starts_at_the_instance_and_stays_in_the_background():
    background = np.arange(40.0).reshape(10, 4)
    edges = np.quantile(background, [0.25, 0.5, 0.75], axis=0)
    x = [[100.0, 1.0, 2.0, 3.0]] * 50
    columns = [pa.array([7] * 50, pa.int64()), pa.array([0] * 50, pa.int32()), pa.array(range(50), pa.int32()), pa.array(x)]
    batch = pa.RecordBatch.from_arrays(columns, names=["key", "target", "draw", "v"])
    out = next(explain._neighbourhood(background, edges, 1)([batch]))
    rows = np.array(out.column("v").to_pylist())
    assert rows[0].tolist() == x[0] and out.column("same")[0].as_py() == [1.0] * 4
    assert all(set(rows[1:, c]) <= set(background[:, c]) and len(set(rows[1:, c])) > 5 for c in range(4))
    halves = [next(explain._neighbourhood(background, edges, 1)([batch.slice(a, 25)])).column("v").to_pylist() for a in (0, 25)]
    assert halves[0] + halves[1] == out.column("v").to_pylist()


def test_real_units(spark):
    df = spark.createDataFrame([(1.0, 3), (None, 4), (5.0, 3), (9.0, 3)], "a double, m int")
    model = encoders.NumericEncoder(numericCols=["a", "absent"], categoricalCols=["m"], outputCol="f").fit(df)
    names = model.feature_names()
    assert names == ["a", "m_3", "m_4"]
    out = explain.real_units(model.transform(df), "f", names, model.get("stats")).collect()
    assert [r["real"][0] for r in out] == [1.0, 5.0, 5.0, 9.0]
    unseen = model.transform(spark.createDataFrame([(1.0, 7)], "a double, m int")).select(vector_to_array("f")).first()[0]
    assert unseen[1:] == [0.0, 0.0]
    flat = encoders.robust_stats(spark.createDataFrame([(0.0,), (0.0,), (0.0,), (8.0,)], "z double"), ["z"])
    assert flat["z"][2] != 0 and encoders.sanitise_name("a[b]<c") == "a_b__c"


def test_text_terms(spark):
    df = spark.createDataFrame([("The red fox, a red fox",), ("the fox",), (None,)], "t string")
    got = encoders.terms(df, "t", "o", ["the"])
    assert got.first()["o"] == ["red", "fox", "red", "fox", "red fox", "fox red", "red fox"]
    vocab, idf = encoders.fit_tfidf(got, "o", 2)
    assert vocab == ["fox", "red"] and idf == pytest.approx([math.log(4 / 3) + 1, math.log(2) + 1])
    v = encoders.tfidf(got, "o", vocab, idf, "v").first()["v"].toArray()
    want = np.array([2 * idf[0], 2 * idf[1]])
    assert np.allclose(v, want / np.linalg.norm(want))


def test_feature_scope(table):
    from tiersmith.plans.cleaning import feature_scope

    assert "review_ratio" not in feature_scope(table, "pre").columns
    assert "review_ratio" in feature_scope(table, "post").columns
    with pytest.raises(ValueError):
        feature_scope(table, "both")
    numeric = encoders.numeric_columns(table)
    assert "price" in numeric and "name" not in numeric
