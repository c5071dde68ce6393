import math
import re
from collections import Counter, defaultdict

import pytest
from edge_tables import ROWS, docs
from pyspark.sql import functions as F

from tiersmith.llm import lm


def code(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class PlainTree:
    """Context-tree weighting by recursion over a dictionary of nodes."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for text in texts:
            for context, node, bit in self.bits(text):
                for d in range(depth + 1):
                    self.counts[context[depth - d :], node][bit] += 1
                    if d:
                        self.children[context[depth - d + 1 :], node].add(context[depth - d :])
        self.cache = {}

    def bits(self, text):
        data = b"\xff" * self.depth + text + b"\xff"
        for i in range(self.depth, len(data)):
            node = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                yield data[i - self.depth : i], node, bit
                node = 2 * node + bit

    def weighted(self, context, node):
        if (context, node) not in self.cache:
            own = code(*self.counts[context, node])
            if len(context) < self.depth:
                below = sum(self.weighted(c, node) for c in sorted(self.children[context, node]))
                own = math.log(0.5) + max(own, below) + math.log1p(math.exp(-abs(own - below)))
            self.cache[context, node] = own
        return self.cache[context, node]

    def one(self, context, node, d=0):
        here = context[self.depth - d :]
        if (here, node) not in self.counts:
            return 0.5
        a, b = self.counts[here, node]
        own = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return own
        below = sum(self.weighted(c, node) for c in sorted(self.children[here, node]))
        share = 1 / (1 + math.exp(min(700.0, below - code(a, b))))
        return share * own + (1 - share) * self.one(context, node, d + 1)

    def score(self, text):
        total = 0.0
        for context, node, bit in self.bits(text):
            p = self.one(context, node)
            total += math.log10(p if bit else 1 - p)
        return total


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def check(spark, rows, train, depth, monkeypatch=None):
    frame = docs(spark, rows, score=1, block="x", train=2).repartition(2)
    got = lm.score_texts(frame, train, depth=depth).collect()
    ids = {r[0] for r in frame.filter(train).select("doc_id").collect()}
    training = [r for r in rows if r[0] in ids]
    tree = PlainTree([(r[1] or "").lower().encode() if (r[1] or "").isascii() else (r[1] or "").encode().lower() for r in training], depth)
    counts = Counter(w for r in training for w in [*words(r[1]), None])
    n, v = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for r in rows:
        tokens = [*words(r[1]), None]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        want[r[0]].append((len(tokens), sum(counts[t] > 0 for t in tokens), n, base, tree.score((r[1] or "").encode().lower())))
    assert len(got) == len(rows)
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    for k in want:
        for a, b in zip(sorted(found[k]), sorted(want[k]), strict=True):
            assert a == pytest.approx(b, rel=1e-9, abs=1e-9)


TEXTS = ["abracadabra, Abracadabra", "the cat sat on the mat", "the rat sat on the cat", "zzz ŷ", "THE CAT", "", None, "aaaa aaaa aaaa", "a"]


@pytest.mark.parametrize("depth", [0, 2, 4])
def test_same_as_recursion(spark, depth, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 20)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)]
    check(spark, rows, F.col("doc_id") % 3 != 2, depth)


def test_many_blocks_and_parts(spark, monkeypatch):
    """Strings shared by blocks, contexts on both sides of a part's border, words known to other blocks only."""
    monkeypatch.setattr(lm, "BLOCK", 60)
    monkeypatch.setattr(lm, "PART", 20)
    rows = [(i, f"{t or ''} {TEXTS[i % 5]} {i}", "en", "s", 1) for i, t in enumerate(TEXTS * 3)]
    check(spark, rows, F.col("doc_id") % 7 != 2, 6)


def test_edges(spark):
    rows = [r for r in ROWS if r[0] != 6] + [(6, ROWS[5][1][:3000], "fr", "src0", 1)]
    check(spark, rows, F.coalesce(F.col("doc_id") != 7, F.lit(True)), 2)
    nothing = lm.score_texts(docs(spark), F.lit(False), depth=2).filter("doc_id = 1").first()
    assert nothing.base_score == 0 and nothing.score == pytest.approx(45 * 8 * math.log10(0.5)) and nothing.train_tokens == 0
    assert lm.score_texts(docs(spark, []), F.lit(True), depth=2).count() == 0


def test_probabilities_of_the_next_byte_sum_to_one():
    tree = PlainTree([b"abcabcabd", b"ab"], 2)
    total = 0.0
    for byte in range(256):
        p, node = 1.0, 1
        for k in range(7, -1, -1):
            one = tree.one(b"ab", node)
            bit = byte >> k & 1
            p *= one if bit else 1 - one
            node = 2 * node + bit
        total += p
    assert total == pytest.approx(1.0)


def test_the_registered_depth_sees_six_bytes_back(spark):
    """What follows the five equal bytes hangs on the sixth."""
    rows = [(i, "xabcdeP yabcdeQ " * 20 if i else "yabcdeQ xabcdeP ", "en", "s", 1) for i in range(6)]
    frame = docs(spark, rows, score=1, block="x", train=2)
    train = F.col("doc_id") != 0
    scores = {d: lm.score_texts(frame, train, depth=d).filter("doc_id = 0").first().score for d in (4, 6)}
    registered = lm.score_texts(frame, train).filter("doc_id = 0").first().score
    assert registered == pytest.approx(scores[6]) and scores[6] > scores[4] + 0.5
