"""The registered queries do the operators' whole work."""

import inspect
import pathlib

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tiersmith.operators import calibrate, explain, search
from tiersmith.operators.pipeline import prepare
from tiersmith.plans import driver_queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="driver tables absent")


class Called(Exception):
    pass


def settings(monkeypatch, module, name, spark, query):
    """What the query passes to an operator, defaults filled in."""
    signature = inspect.signature(getattr(module, name))

    def stop(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Called(bound.arguments)

    monkeypatch.setattr(module, name, stop)
    with pytest.raises(Called) as caught:
        query(spark, SF)
    return caught.value.args[0]


def test_smotenc_returns_every_slot(spark):
    assert q.smotenc(spark, SF).columns == ["key", "label", *(f"x{i}" for i in range(64)), "flag0", "flag1"]


def test_full_settings(spark, monkeypatch):
    got = settings(monkeypatch, calibrate, "search_weights", spark, q.weight_search)
    assert (got["per_class"], got["generations"]) == (15, 100)
    got = settings(monkeypatch, explain, "surrogates", spark, q.surrogates)
    assert got["samples"] == 1000 and len(got["background"]) == 200
    got = settings(monkeypatch, explain, "shapley", spark, q.shapley)
    assert got["permutations"] == 10 and len(got["background"]) == 200


def test_published_searches(spark, monkeypatch):
    got = settings(monkeypatch, search, "feature_size_grid", spark, q.feature_grid)
    assert (tuple(got["terms"]), tuple(got["components"]), got["k"]) == ((15, 30, 50), (20, 50, 80), 3)
    assert list(got["classifiers"]) == ["DecisionTree", "RandomForest", "XGBoost"]
    widths = []
    for terms in (15, 30):  # the text axis changes the features
        model = prepare(got["stages"](terms=terms, components=4)[:4], got["df"])
        widths.append(model.rows.select(F.size(vector_to_array("features"))).first()[0])
    assert widths == [19, 34]
    got = settings(monkeypatch, search, "nested_search", spark, q.nested_search)
    assert (got["outer"], got["inner"]) == (5, 3)
    assert {n: m[2] for n, m in got["models"].items()} == {"DecisionTree": 5, "RandomForest": 40, "XGBoost": 50}
    for make, space, _ in got["models"].values():
        front, params = search._split_setting(search.draw(space, 1, 1)[0])
        assert make(**params) is not None and len(got["stages"](**front)) == 8


def test_too_many_levels_are_not_dropped(spark, tmp_path):
    rows = [(i, "O", f"level {i:03}") for i in range(101)]
    for n in (100, 101):
        frame = spark.createDataFrame(rows[:n], "o_orderkey long, o_orderstatus string, o_orderpriority string")
        frame.write.parquet(f"{tmp_path}/{n}/orders.parquet")
    assert len(q.mode_impute_onehot(spark, f"{tmp_path}/100").columns) == 101
    with pytest.raises(ValueError, match="levels"):
        q.mode_impute_onehot(spark, f"{tmp_path}/101")
