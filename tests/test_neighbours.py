import numpy as np
import pytest

from tiersmith.operators.neighbours import mutual_pairs, nearest_neighbours, neighbours_in_class


def brute(ids, x, k):
    out = {}
    for i, a in zip(ids, x, strict=True):
        d = np.sqrt(((x - a) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[int(i)] = [int(ids[j]) for j in order]
    return out


def data(kind, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "flat":
        return rng.normal(size=(300, 2))
    if kind == "clusters":
        return np.concatenate([rng.normal(size=(120, 5)) + 30 * c for c in range(3)])
    if kind == "wide":
        return rng.normal(size=(150, 40))
    x = rng.normal(size=(120, 3)).round(1)
    x[:40] = x[0]  # a third of the rows are copies
    return x


def frame(spark, ids, x, labels=None):
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)]
    if labels is not None:
        rows = [(*r, int(c)) for r, c in zip(rows, labels, strict=True)]
        return spark.createDataFrame(rows, "id bigint, v array<double>, y int")
    return spark.createDataFrame(rows, "id bigint, v array<double>")


@pytest.mark.parametrize("kind,block", [("flat", 16), ("clusters", 32), ("wide", 25), ("copies", 10), ("copies", None)])
def test_matches_brute_force(spark, kind, block):
    x = data(kind)
    ids = np.random.default_rng(1).permutation(len(x)) * 7
    got = {}
    for r in nearest_neighbours(frame(spark, ids, x), "id", "v", 3, block).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == brute(ids, x, 3)


def test_mutual_pairs(spark):
    x = data("copies")
    ids = np.arange(len(x))
    nn = {i: v[0] for i, v in brute(ids, x, 1).items()}
    want = {(i, j) for i, j in nn.items() if i < j and nn[j] == i}
    got = {(r["a"], r["b"]) for r in mutual_pairs(frame(spark, ids, x), "id", "v", 10).collect()}
    assert got == want


def test_in_class_and_tiny_class(spark):
    x = data("flat")[:40]
    y = np.array([0] * 38 + [1] * 2)
    df = frame(spark, np.arange(40), x, y)
    rows = neighbours_in_class(df, "id", "v", "y", 3).collect()
    assert {tuple(r) for r in neighbours_in_class(df, "id", "v", "y", 3, small=10).collect()} == {tuple(r) for r in rows}
    assert sum(r["y"] == 1 for r in rows) == 2  # one other member each
    want = brute(np.arange(38), x[:38], 3)
    assert {(r["id"], r["rank"]): r["neighbour"] for r in rows if r["y"] == 0} == {
        (i, k + 1): v for i, vs in want.items() for k, v in enumerate(vs)
    }


def test_large_classes_are_joined_together(spark, monkeypatch):
    from tiersmith.operators import neighbours

    layouts = []
    original = neighbours._layout
    monkeypatch.setattr(neighbours, "_layout", lambda *args: layouts.append(1) or original(*args))
    x, y = data("flat"), np.arange(300) % 4
    x[200:240] = x[200]  # copies in every class
    ids = np.random.default_rng(2).permutation(300)
    rows = neighbours_in_class(frame(spark, ids, x, y), "id", "v", "y", 3, small=10).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault((r["y"], r["id"]), []).append(r["neighbour"])
    assert got == {(c, i): v for c in range(4) for i, v in brute(ids[y == c], x[y == c], 3).items()}
    assert len(layouts) == 1  # not a join per class


def test_comparison_holds_a_tile_at_a_time():
    import tracemalloc

    from tiersmith.operators.neighbours import best_k

    x = np.random.default_rng(3).normal(size=(24_000, 8))
    ids = np.arange(len(x))
    tracemalloc.start()
    near, _ = best_k(x[:1024], ids[:1024], x, ids, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # the whole 1,024 x 24,000 matrix alone has 197 MB
    for i in (0, 700, 1023):
        d = ((x - x[i]) ** 2).sum(1)
        assert near[i].tolist() == np.argsort(d)[1:4].tolist()


def test_comparison_of_many_equal_distances():
    from tiersmith.operators.neighbours import best_k

    x = np.repeat(np.eye(6), 700, axis=0)  # every distance is 0 or the root of 2
    ids = np.random.default_rng(4).permutation(len(x))
    near, dist = best_k(x[:600], ids[:600], x[700:], ids[700:], 4, np.full(600, 2.0))
    want = np.sort(ids[700:])[:4].tolist()
    assert all(n.tolist() == want for n in near) and np.allclose(np.concatenate(dist), 2**0.5)


def test_wide_rows_are_compared_along_few_directions_first(monkeypatch):
    from tiersmith.operators import neighbours

    seen = []
    original = neighbours._outline
    monkeypatch.setattr(neighbours, "_outline", lambda rows: seen.append(original(rows)) or seen[-1])
    rng = np.random.default_rng(5)
    x = rng.normal(size=(5000, 60)) * 0.8 ** np.arange(60) * 5
    x[:40] = x[40]  # copies
    x[50] *= 1e4  # far from all others
    ids = rng.permutation(len(x))
    asked = np.r_[0:60, 3000:3100]
    want = brute(ids, x, 3)
    near, dist = neighbours.best_k(x[asked], ids[asked], x, ids, 3)
    assert [n.tolist() for n in near] == [want[i] for i in ids[asked]]
    kth = np.array([d[2] for d in dist])
    near, _ = neighbours.best_k(x[asked], ids[asked], x, ids, 3, kth)
    assert [n.tolist() for n in near] == [want[i] for i in ids[asked]]
    assert [s.shape for s in seen] == [(60, neighbours.OUTLINE)] * 2
    neighbours.best_k(x[asked, :20], ids[asked], x[:, :20], ids, 3)
    assert len(seen) == 2  # narrow rows are compared whole


def test_points_are_sorted_by_hash_before_their_vectors(spark):
    from tiersmith.operators.neighbours import distinct_points

    nan = float("nan")
    rows = [(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [nan, 1.0]), (4, [nan, 1.0]), (5, None), (6, None), (7, [2.0, None]), (8, [0.0, 1.0])]
    points = distinct_points(spark.createDataFrame(rows, "id bigint, v array<double>"), "id", "v", 1)
    assert sorted(r["ids"] for r in points.collect()) == [[1, 2], [3, 4], [5, 6], [7]]
    sorts = [line for line in points._jdf.queryExecution().sparkPlan().toString().splitlines() if "Window" in line]
    assert sorts and all("hash" in line and line.index("hash") < line.index("vec") for line in sorts)
