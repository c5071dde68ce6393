import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from edge_tables import ROWS, docs

from tiersmith.llm import queries, spelling


def near_words(words):
    """Every pair one edit apart, by comparing all pairs."""
    near = defaultdict(set)
    for a in words:
        for b in words:
            if len(a) == len(b):
                close = sum(x != y for x, y in zip(a, b, strict=True)) == 1
            else:
                short, long_ = sorted((a, b), key=len)
                close = len(long_) - len(short) == 1 and any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))
            if close:
                near[a].add(b)
    return near


def plain(counts, factor):
    near = near_words(counts)
    form = {}
    for w in counts:
        if near[w]:
            best = min(near[w], key=lambda v: (-counts[v], v))
            if counts[best] >= factor * counts[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def variants(spark, counts, factor=2):
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    return {tuple(r) for r in spelling.spelling_variants(table, factor).collect()}


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abc"), (3, "aé漢😀")])
def test_equals_all_pairs(spark, seed, letters):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.randrange(7))) for _ in range(150)}
    words |= {"a" * 300, "a" * 299 + "b", "a" * 301, "a" * 150 + "b" + "a" * 149}
    counts = {w: r.choice([1, 2, 3, 7, 20, 20, 90]) for w in sorted(words)}
    assert variants(spark, counts) == plain(counts, 2)


def test_chain_and_ties(spark):
    counts = {"abcdef": 1000, "abcdeg": 100, "abcdhg": 10, "abidhg": 1, "xbcdef": 1000, "zzzzzz": 4}
    assert variants(spark, counts, 5) == plain(counts, 5)
    roots = {w: root for w, _, root, *_ in variants(spark, counts, 5)}
    assert roots["abidhg"] == "abcdef" and roots["zzzzzz"] == "zzzzzz"


def test_edges(spark):
    rows = [("word", 3, "x"), ("word", 2, "y"), (None, 9, "z"), ("", 4, ""), ("w", 1, ""), ("gone", 0, "")]
    table = spark.createDataFrame(rows, "word string, n long, path string")
    assert {tuple(r) for r in spelling.spelling_variants(table).collect()} == plain({"word": 5, "": 4, "w": 1}, 5)
    assert spelling.spelling_variants(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(table, factor=1)


def test_numbers_are_nodes(spark):
    """One number per prefix over all parts, and word numbers in code-point order."""
    r = random.Random(5)
    words = sorted({"".join(r.choice("abAé") for _ in range(r.randrange(1, 9))) for _ in range(600)})
    table = spark.createDataFrame([(w,) for w in words], "word string").repartition(3)
    rows = spelling.number_nodes(table).collect()
    seen = {}
    for row in rows:
        for i, node in enumerate(row["path"]):
            assert seen.setdefault(row["word"][: i + 1], node) == node
    assert len(set(seen.values())) == len(seen) == len({w[:i] for w in words for i in range(1, len(w) + 1)})
    assert [x["word"] for x in sorted(rows, key=lambda x: x["number"])] == words


def test_words_of_documents(spark):
    table = docs(spark, rows=ROWS * 3, word="clash", run="clash", id=1)
    got = {r["word"]: r["n"] for r in spelling.count_words(queries.misprinted_words(table)).collect()}
    want = Counter()
    for id_, text, *_ in ROWS * 3:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                want[run] += 1
    assert got == {w: n for w, n in want.items() if n >= 5}
