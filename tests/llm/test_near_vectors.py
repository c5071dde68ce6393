import math

import numpy as np
import pytest

from tiersmith.llm import near_vectors as nv

SCHEMA = "vec_id long, embedding array<float>, label int, links int"


def brute(rows, least):
    ok = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) and k is not None for _, v, k in rows]
    unit = [np.array(v, float) / np.sqrt((np.array(v, float) ** 2).sum()) if good else None for (_, v, _), good in zip(rows, ok, strict=True)]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    first = {}
    for i in range(n):
        first[find(i)] = min(rows[i][0], first.get(find(i), rows[i][0]))
    return sorted((rows[i][0], links[i], first[find(i)], rows[i][0] == first[find(i)]) for i in range(n))


@pytest.mark.parametrize(("chunk", "pivots", "size"), [(16, 64, 8), (16, 2, 8), (2048, 4096, 64), (5, 500, 3)])
def test_same_as_brute_force(spark, chunk, pivots, size):
    rng = np.random.default_rng(chunk + size)
    rows = []
    for g in range(25):
        centre = rng.normal(size=size)
        for _ in range(int(rng.choice([1, 3, 20, 40]))):
            v = (centre + rng.normal(size=size) * rng.choice([0.0, 0.1, 0.3])).astype(np.float32)
            rows.append((len(rows) * 3 % 1009, [float(x) for x in v], int(rng.choice([1, 1, 1, 2, 3]))))
    frame = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(3)
    got = nv.near_vectors(frame, 0.93, chunk=chunk, pivots=pivots).collect()
    assert sorted(map(tuple, got)) == brute(rows, 0.93)


def test_edges(spark):
    rows = [
        (5, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (1, [1.0, 0.0], None),
        (2, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (10, [float("inf"), 1.0], 1),
        (11, [1.0, 0.0, 0.0], 1), (12, [], 1), (13, [1.0, 0.4], 1), (14, [3e38, 1e-45], 1),
    ]
    frame = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    assert sorted(map(tuple, nv.near_vectors(frame).collect())) == brute(rows, 0.93)
    assert nv.near_vectors(frame.limit(0)).count() == 0
