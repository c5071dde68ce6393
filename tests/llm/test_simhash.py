import random
import re

import numpy as np
import pytest
import xxhash
from edge_tables import ROWS, docs

from tiersmith.llm import simhash


def plain_fingerprint(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, ids, most):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprint():
    for row in ROWS:
        assert simhash.fingerprint((row[1] or "").encode()) % 2**64 == plain_fingerprint(row[1], 3)
    for n in range(6):
        text = "Ä B\x0bc D e f"[: 2 * n]
        assert simhash.fingerprint(text.encode()) % 2**64 == plain_fingerprint(text, 3)


def test_components(spark):
    found = simhash.simhash_components(docs(spark, fingerprint="x", component_id=3)).collect()
    fps = [plain_fingerprint(r[1], 3) for r in ROWS]
    want = list(zip([r[0] for r in ROWS], [f"{f:016x}" for f in fps], components(fps, [r[0] for r in ROWS], 2), strict=True))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert simhash.simhash_components(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("most", "crowd"), [(2, 2), (2, 32), (1, 2), (3, 3)])
def test_links_close_to_the_same_components(spark, most, crowd):
    rng = random.Random(most * 10 + crowd)
    fps = {0, 2**64 - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            base ^= sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 1, 2, 3])))
            fps.add(base % 2**64)
    fps = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.fingerprint_links(frame, most, crowd).collect()]
    assert all((a ^ b).bit_count() <= most for a, b in links)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert [find(f) for f in fps] == components(fps, fps, most)


def test_allocation_covers_the_distance():
    cost, chosen = simhash.allocate([[5.0, 90.0, 500.0], [4.0, 9.0, 500.0], [100.0, 200.0, 900.0]], 2)
    assert sum(t + 1 for t in chosen) == 3 and chosen == [0, 1, -1] and cost == 14.0


def test_one_document_of_each_group_stays(spark):
    kept = simhash.keep_one_per_group(docs(spark, component_id=1)).collect()
    assert sorted((r.doc_id for r in kept if r.doc_id), key=int) == [1, 3, 6, 7]
    assert sum(r.doc_id is None for r in kept) == 2


def test_texts_that_share_an_id_are_judged_apart(spark):
    """Three texts, two under one id: all stay; a copy of one under that id takes none of the others along."""
    a, b, c = ("alpha beta gamma delta epsilon", "one two three four five six", "rot grün blau gelb weiss schwarz")
    kept = simhash.keep_one_per_group(docs(spark, rows=[(1, a, *ROWS[0][2:]), (1, b, *ROWS[0][2:]), (2, c, *ROWS[0][2:])]))
    assert sorted(r.text for r in kept.collect()) == sorted([a, b, c])
    rows = [(0, a), (5, a), (5, b), (5, b), (7, c)]
    kept = simhash.keep_one_per_group(docs(spark, rows=[(*r, *ROWS[0][2:]) for r in rows]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(0, a), (5, b), (7, c)])
