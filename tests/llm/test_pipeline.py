import pathlib
from collections import Counter

import pytest
from edge_tables import docs
from pyspark.sql import functions as F
from test_simhash import components, plain_fingerprint

import corpus_pipeline
from tiersmith.llm import mixing, quality, queries, secrets
from tiersmith.session import cut_lineage

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="driver tables absent")


@pytest.fixture(scope="module")
def stages(spark):
    found = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        found.append(cut_lineage(stage(spark, found[-1], SF)))
    return found


def test_stages_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "secret_scans", "mix_sources", "best_fit_packing",
    ]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_keeps_what_the_model_accepts(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("crc32(cast(doc_id as string)) % 5 != 0")
    model = quality.fit_quality(stages[0], labels)
    want = stages[0].select("doc_id", quality.quality(model).alias("s")).filter("s >= 0.3")
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in want.collect()}
    good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").join(stages[0], "doc_id", "left_semi")
    assert stages[1].join(good, "doc_id", "left_semi").count() >= 0.97 * good.count()


def test_dedup_keeps_the_first_of_each_component(stages):
    rows = stages[1].collect()
    ids = [r.doc_id for r in rows]
    least = components([plain_fingerprint(r.text, 3) for r in rows], ids, 2)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(i for i, c in zip(ids, least, strict=True) if i == c)


def test_secrets_are_masked(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for k, r in after.items():
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text)
        if not secrets.base_spans(before[k].text) and "[SECRET]" not in r.text:
            assert r == before[k]


def test_mixture_is_a_sample(stages):
    count = mixing.word_count(F.col("text"))
    chances = mixing.with_probabilities(stages[3], queries.mixture(), count).collect()
    draws = {r.doc_id: r.u for r in stages[3].select("doc_id", mixing.uniform_draw(F.col("doc_id")).alias("u")).collect()}
    want = {r.doc_id for r in chances if draws[r.doc_id] < r["_mix_probability"]}
    assert {r.doc_id for r in stages[4].collect()} == want


def test_packed_whole(stages):
    packed = stages[5].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in stages[4].collect()}
    filled = Counter()
    for r in packed:
        assert len(r.token_ids) == 4 * r.length
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024


def test_run_and_edges(spark, stages):
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.drop("sequence_id", "offset").collect())) == sorted(
        map(tuple, stages[5].drop("sequence_id", "offset").collect())
    )
    for rows in (docs(spark, score=1, _row=2, component_id=3), docs(spark, [])):
        for _, stage in corpus_pipeline.STAGES:
            rows = cut_lineage(stage(spark, rows, SF))
        assert rows.columns[0] == "doc_id"
