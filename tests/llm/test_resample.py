import hashlib
import math
import re
import zlib

import pytest
from edge_tables import ROWS, docs
from pyspark.sql import functions as F

from tiersmith.llm import resample

TARGET = [(1, "the quick fox and word1 and word2 and"), (2, None), (3, "")]


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def runs_of(text, longest=3):
    words = words_of(text)
    return [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, percent, least, buckets):
    """The whole result, one document at a time."""
    place = [[zlib.crc32(r.encode()) % buckets for r in runs_of(text)] for _, text, *_ in rows]
    s, t = [0] * buckets, [0] * buckets
    for found in place:
        for b in found:
            s[b] += 1
    for _, text in target:
        for r in runs_of(text):
            t[zlib.crc32(r.encode()) % buckets] += 1
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)
    ]
    out = []
    for (id_, text, *_), found in zip(rows, place, strict=True):
        h = int(hashlib.sha256(f"42:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([id_, len(words_of(text)), len(found), weight, score, None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, row in enumerate(able[: percent * len(able) // 100]):
        row[5] = i + 1
    return sorted(map(tuple, out), key=repr)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(TARGET, "item_id long, text string")


@pytest.mark.parametrize("percent,least", [(5, 20), (50, 1), (100, 0), (0, 0), (70, 3)])
def test_edges_equal_plain(spark, target, percent, least):
    table = docs(spark, score=1.5, rank="x", bucket=3, turn=0, id="clash", weight=None)
    got = resample.importance_resample(table, target, percent=percent, least_words=least, buckets=97)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(ROWS, TARGET, percent, least, 97)


def test_many_ties_and_long_texts(spark, target, monkeypatch):
    """Repeated rows share their key, and a text is read in several parts."""
    monkeypatch.setattr(resample, "RUN", 7)
    rows = [(i % 40, f"alpha word1 and {'b' * (i % 3)} " * (1 + i % 9)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = resample.importance_resample(table, target, percent=30, least_words=4, buckets=50).collect()
    want = plain(rows, TARGET, 30, 4, 50)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1 + sum(r[5] is not None for r in want)))
    assert sorted(((r["doc_id"], r["weight"], r["score"]) for r in got)) == sorted((r[0], r[3], r[4]) for r in want)
    ranked = sorted((r["rank"], r["score"], r["doc_id"]) for r in got if r["rank"])
    assert ranked == sorted((r[5], r[4], r[0]) for r in want if r[5])


@pytest.mark.parametrize("k", [1, 2, 17, 500, 999, 1000])
def test_quickselect(spark, k):
    rows = spark.range(1000).select(
        (F.col("id") * 7919 % 13).alias("score"), F.when(F.col("id") % 11 > 0, F.col("id") % 50).alias("id"), F.col("id").alias("turn")
    )
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    order = sorted(rows.collect(), key=resample._place)
    assert resample.kth_key(rows, k, 3) == tuple(order[k - 1])


def test_empty_tables(spark, target):
    none = docs(spark).limit(0)
    assert resample.importance_resample(none, target).count() == 0
    got = resample.importance_resample(docs(spark), target.limit(0), percent=100, least_words=1).collect()
    assert len(got) == len(ROWS) and {r["rank"] for r in got} == {None, 1, 2, 3, 4, 5, 6}
