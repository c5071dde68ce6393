import pathlib

import pytest
from edge_tables import ROWS, docs
from pyspark.sql import functions as F

from tiersmith.llm import ftrl, quality, queries, toxicity

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="driver tables absent")
@pytest.mark.parametrize(("query", "label", "recall", "false"), [
    ("op3_quality_classifier", "quality", 0.98, 0.15), ("op8_toxicity", "toxic", 0.55, 0.005),
])
def test_held_out(spark, query, label, recall, false):
    found = queries.QUERIES[query](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    both = found.filter("held_out").join(labels, "doc_id").groupBy("y").agg(F.avg("predicted").alias("share")).collect()
    share = {r.y: r.share for r in both}
    assert share[1] >= recall and share[0] <= false
    assert found.count() == found.filter("score between 0 and 1 and predicted is not null").count() == 10_000


@pytest.mark.parametrize("part", [(quality.fit_quality, quality.quality, "quality"), (toxicity.fit_toxicity, toxicity.toxicity, "toxic")])
def test_edges(spark, part):
    fit, score, _ = part
    rows = docs(spark, score="x", _label=5, _id=1)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 1), (4, None, None), (6, 0, 1), (None, 1, 1), (99, 1, 1), (7, 5, 7)], LABELS)
    scored = rows.select("doc_id", score(fit(rows, labels)).alias("s")).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.s <= 1 for r in scored)
    bare = fit(rows, labels.limit(0))
    assert {r.s for r in rows.select(score(bare).alias("s")).collect()} == {0.5}
    assert docs(spark, []).select(score(bare)).count() == 0


def test_features_know_words_pairs_and_repeats():
    f = ftrl.Features(bits=16, gaps=(1, 2), marks=True, repeats=True)
    slots, owner = ftrl.chunk_features([b"Ab cd", b"", b"ab  CD!", b"x x"], f)
    texts = [set(slots[owner == k]) for k in range(4)]
    assert texts[0] < texts[2] and not texts[1] and len(texts[0]) == 3
    plain = ftrl.chunk_features([b"x x"], ftrl.Features(bits=16, gaps=(1, 2), marks=True))[0]
    assert len(texts[3]) == len(set(plain)) + 1
    assert 0 not in slots


def test_sample_is_bounded(spark):
    rows = docs(spark, [(i, f"good word{i}" if i % 2 else f"bad thing{i}", "en", "s", 1) for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], LABELS)
    settings = ftrl.Settings(sample=100, shard_rows=40, epochs=3)
    model = quality.fit_quality(rows, labels, settings=settings)
    share = rows.withColumn("s", quality.quality(model)).filter((F.col("s") > 0.5) == (F.col("doc_id") % 2 == 1)).count()
    assert share == 400


def test_held_out_ids(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long").withColumn("h", ftrl.held_out("doc_id", 5, 0))
    for r in rows.collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
