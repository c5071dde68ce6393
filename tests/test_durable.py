"""Replayed batches, half-written bundles, and sessions that were made elsewhere."""

import os
import pathlib
import shutil
import subprocess
import sys

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tiersmith.operators import models
from tiersmith.plans import driver_queries as q
from tiersmith.sources.records import load_bundle, save_bundle
from tiersmith.streaming.batches import read_commits, read_part, store_batch, store_stream

SF = "/root/testdata/sf0.001"
REPO = pathlib.Path(__file__).resolve().parents[1]


def split(batch):
    return {"even": batch.filter("id % 2 = 0"), "odd": batch.filter("id % 2 = 1")}


def ids(spark, target, name):
    return sorted(r["id"] for r in read_part(spark, target, name, "id bigint").collect())


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    target = str(tmp_path)
    store_batch(spark.range(10), 0, target, split)
    store_batch(spark.range(10, 13), 1, target, split)
    for _ in range(2):
        assert ids(spark, target, "even") == [0, 2, 4, 6, 8, 10, 12] and ids(spark, target, "odd") == [1, 3, 5, 7, 9, 11]
        sizes = {(r["batch"], r["part"]): r["rows"] for r in read_commits(spark, target).collect()}
        assert sizes == {(0, ""): 10, (0, "even"): 5, (0, "odd"): 5, (1, ""): 3, (1, "even"): 2, (1, "odd"): 1}
        store_batch(spark.range(10, 13), 1, target, split)


def test_a_batch_without_commit_is_not_read(spark, tmp_path):
    target = str(tmp_path)
    store_batch(spark.range(4), 0, target, split)

    def lost(batch):
        yield from split(batch).items()
        raise RuntimeError("driver lost")

    with pytest.raises(RuntimeError):
        store_batch(spark.range(4, 8), 1, target, lambda b: type("Parts", (), {"items": lambda self: lost(b)})())
    assert ids(spark, target, "even") == [0, 2]
    store_batch(spark.range(4, 8), 1, target, split)
    assert ids(spark, target, "even") == [0, 2, 4, 6]


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (range(6), range(6, 9)):
        spark.createDataFrame([(i,) for i in part], "id bigint").write.mode("append").parquet(source)
        stream = spark.readStream.schema("id bigint").parquet(source)
        store_stream(stream, target, str(tmp_path / "progress"), split).awaitTermination(60)
        assert ids(spark, target, "even") + ids(spark, target, "odd") == [i for r in (0, 1) for i in range(part.stop) if i % 2 == r]


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.range(40).select(F.col("id").cast("double").alias("x"), (F.col("id") > 20).cast("int").alias("label"))
    rows = rows.select(q.array_to_vector(F.array("x")).alias("features"), "label")
    return PipelineModel([models.fit_balanced(models.decision_tree(depth=2), rows)])


def test_bundle_round_trip_and_damage(spark, model, tmp_path):
    root = save_bundle(model, [0.5, 1.5], str(tmp_path), "v1")
    assert load_bundle(spark, root)[1] == [0.5, 1.5]
    with pytest.raises(ValueError, match="exists"):
        save_bundle(model, [1.0, 1.0], str(tmp_path), "v1")
    data = sorted(p for p in (tmp_path / "v1" / "pipeline").rglob("part-*") if p.stat().st_size)
    changed = tmp_path / "changed"
    shutil.copytree(root, changed)
    (changed / data[0].relative_to(root)).write_bytes(b"other")
    extra = tmp_path / "extra"
    shutil.copytree(root, extra)
    shutil.copy(data[0], extra / data[0].relative_to(root).parent / "part-99999")
    half = tmp_path / "half"
    shutil.copytree(root, half, ignore=shutil.ignore_patterns("manifest"))
    for damaged in (changed, extra, half, tmp_path / "absent"):
        with pytest.raises(ValueError):
            load_bundle(spark, str(damaged))


def test_what_a_lost_writer_left_is_replaced(spark, model, tmp_path):
    (tmp_path / "v2" / "pipeline").mkdir(parents=True)
    (tmp_path / "v2" / "pipeline" / "part-0").write_text("half")
    with pytest.raises(ValueError):
        load_bundle(spark, str(tmp_path / "v2"))
    root = save_bundle(model, [1.0], str(tmp_path), "v2")
    assert load_bundle(spark, root)[1] == [1.0]


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables absent")
def test_a_session_made_elsewhere(tmp_path):
    script = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, {str(REPO)!r})
import __spark_entry__ as entry
print("rows", entry.queries()["corr_prune"](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "rows 7" in run.stdout, run.stderr[-2000:]
