import math

import numpy as np
import pytest

from tiersmith.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score int"


def brute(rows, asked, k):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and usable(v)]
    found = []
    seen = {}
    for i, v in rows:
        if i is not None and usable(v) and i in asked:
            w = [math.floor(256 * float(x)) for x in v]
            seen[i] = min(seen.get(i, w), w)
    for q, v in seen.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
        found += [(q, r + 1, i, max(-topk.LIMIT, min(topk.LIMIT, -s))) for r, (s, i) in enumerate(scored[:k])]
    return sorted(found)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize(("size", "n"), [(64, 700), (5, 300), (1, 60)])
def test_same_as_brute_force(spark, monkeypatch, size, n):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "SEEDS", 20)
    rng = np.random.default_rng(size)
    matrix = rng.normal(size=(n, size)).astype(np.float32)
    matrix[n // 2 :] = matrix[: n - n // 2] + rng.choice([0, 0.003], (n - n // 2, 1)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA).repartition(3)
    asked = set(range(0, n, 20))
    got = topk.top_k(frame, frame.filter("vec_id % 20 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == brute(rows, asked, 5)


def test_edges(spark):
    rows = [
        (0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (40, None), (2, [1.0, None]), (3, [float("nan"), 1.0]),
        (4, [float("inf"), 1.0]), (60, []), (61, []), (80, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (100, [-0.001, 0.0]),
        (120, [3e38, -3e38]), (20, [0.5, 0.5]),
    ]
    frame = spark.createDataFrame([(i, v, None, 1) for i, v in rows], SCHEMA)
    got = topk.top_k(frame, frame.filter("vec_id % 20 = 0"), 5).collect()
    want = brute(rows, {0, 20, 40, 60, 80, 100, 120}, 5)
    small = [r for r in want if r[0] != 120 and r[2] != 120]
    assert [r for r in sorted(map(tuple, got)) if r[0] != 120 and r[2] != 120] == small
    assert len(got) == len(want)
    assert topk.top_k(frame.limit(0), frame.limit(0), 5).count() == 0


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(50, 64)), rng.normal(size=(40, 64))
    last = np.full((50, 40), np.inf)
    for s in (1, 4, 16, 32, 64):
        bound = topk.segment_stats(a, s) @ topk.segment_stats(b, s).T
        assert (bound >= a @ b.T - 1e-9).all() and (bound <= last + 1e-9).all()
        last = bound
    assert np.allclose(last, a @ b.T)
