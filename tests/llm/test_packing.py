import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from edge_tables import ROWS, docs
from tokenizers import Tokenizer

from tiersmith.llm import packing

PIECES = ["a", "'", "s", " ", "\n", "1", "!", "re", "é", "ll", "\t", "'s", "d", "ß", "\r", "the"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def words():
    return packing.WordTokens(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_same_ids_as_the_tokenizer(tokenizer, words):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(3000)]
    texts += ["", "a<|endoftext|>b", "x\x1cy\x85z\xa0w ²½ × ÷", "漢字 1２ 一", "😀👩‍👧 ok", "ſ K İ ǅ", "\x00b", "  'sİs"]
    found = list(words.texts(texts))
    for text, ids in zip(texts, found, strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_chunk_that_ends_with_the_batch(words, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 3)
    assert [x.tolist() for x in words.texts(["abc", "", "abc"])] == [[39305], [], [39305]]


def laid(rules, capacity):
    places = {}
    for length, first, end, sequence, each, offset in rules:
        for rank in range(first, end):
            at = rank - first
            places[length, rank] = (sequence + at // each, offset + at % each * length)
    sequences = {}
    for (length, _), (sequence, offset) in places.items():
        sequences.setdefault(sequence, []).append((offset, length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return places, sequences


@pytest.mark.parametrize("seed", range(12))
def test_plan_lays_every_piece_without_gaps(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 1024])
    counts = Counter(min(capacity, int(rng.lognormvariate(rng.uniform(0, 6), 1)) + 1) for _ in range(rng.randint(0, 3000)))
    places, sequences = laid(packing.plan_packing(counts, capacity), capacity)
    assert set(places) == {(n, r) for n, c in counts.items() for r in range(c)}
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    large = sum(c for n, c in counts.items() if 2 * n > capacity)
    assert len(sequences) <= 1.25 * max(least, large) + 1


def test_large_pieces_are_matched_with_the_longest_that_fits():
    _, sequences = laid(packing.plan_packing({700: 1, 600: 1, 350: 1, 300: 1, 400: 1}, 1024), 1024)
    assert sorted(sorted(n for _, n in s) for s in sequences.values()) == [[300, 700], [400, 600], [350]] or len(sequences) == 3


def test_pieces(spark, tokenizer):
    found = packing.pack_documents(docs(spark, rank=1, length=2), capacity=64).toPandas()
    assert list(found.columns) == ["doc_id", "piece", "start", "length", "token_ids", "sequence_id", "offset"]
    want = Counter()
    for row in ROWS:
        ids = [*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(min(first, len(ids)), len(ids), 64), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[row[0], piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = Counter(
        (None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, zlib.crc32(r.token_ids))
        for r in found.itertuples()
    )
    assert got == want
    for _, rows in found.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == (rows.length.cumsum() - rows.length).tolist() and rows.length.sum() <= 64
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_long_patterned_words_are_told_apart():
    """Words whose running sums agree by construction: the Thue-Morse sequence and its complement."""
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    bits = [i.bit_count() & 1 for i in range(2048)]
    words = ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    memory = packing.WordTokens(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=memory.encoding._mergeable_ranks, special_tokens={})
    assert [ids.tolist() for ids in memory.texts(words)] == [own.encode_ordinary(w) for w in words]
