import random

import pytest
from pyspark.sql import functions as F

from tiersmith.operators import dictionaries

ROWS = "id bigint, a array<string>"


def test_slots_of_many_ranges(spark):
    rng = random.Random(3)
    data = [(i, [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(9))]) for i in range(3000)]
    df = spark.createDataFrame(data, ROWS).repartition(7)
    slots = dictionaries.token_slots(df, "a")
    want = {t: i for i, t in enumerate(sorted({t for _, a in data for t in a}))}
    assert {r["token"]: r["slot"] for r in slots.collect()} == want
    got = {r["id"]: r["slots"] for r in dictionaries.slot_lists(df, "id", "a", slots).collect()}
    assert got == {i: sorted({want[t] for t in a}) for i, a in data}


def test_edges(spark):
    df = spark.createDataFrame([(1, ["b", None, "b", ""]), (2, None), (3, []), (1, ["a"]), (None, ["é"]), (4, ["z"])], ROWS)
    known = df.filter("id IS NULL OR id <> 4")
    slots = dictionaries.token_slots(known, "a")
    assert sorted(map(tuple, slots.collect())) == [("", 0), ("a", 1), ("b", 2), ("é", 3)]
    got = {r["id"]: r["slots"] for r in dictionaries.slot_lists(df, "id", "a", slots).collect()}
    assert got == {1: [0, 1, 2], 2: [], 3: [], 4: [], None: [3]}
    empty = df.limit(0)
    none = dictionaries.token_slots(empty, "a")
    assert none.collect() == [] and dictionaries.slot_lists(df, "id", "a", none).filter(F.size("slots") > 0).isEmpty()


@pytest.mark.parametrize("values", [["x", None, "y", "x"], [None, "b", "a"], [None], []])
def test_levels(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, v string")
    got = sorted(map(tuple, dictionaries.level_slots(df, "id", "v").collect()))
    known = sorted({v for v in values if v})
    fill = min(known, key=lambda v: (-values.count(v), v), default=None)
    assert got == [(i, v or fill, known.index(v or fill)) for i, v in enumerate(values) if known]
