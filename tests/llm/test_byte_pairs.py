import hashlib
import random

import numpy as np
import pytest
from edge_tables import LONG, ROWS, docs

from tiersmith.llm import byte_pairs, queries

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def own():
    return byte_pairs.BytePairs(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def plain(own):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={}).encode_ordinary


def texts():
    r = random.Random(7)
    alphabets = ["thean ", "abcdefghijklmnopqrstuvwxyz", "aäéß ñ", "0123456789 .,", "漢字かな 😀", " \n\t  ", "'sdtrevml "]
    made = ["".join(r.choice(a) for _ in range(r.randrange(120))) for a in alphabets for _ in range(20)]
    long_words = ["a" * 3000, "ab" * 100, "=-" * 90, "é" * 130, " " * 500, "".join(r.choice("thean") for _ in range(900))]
    return [*made, *long_words, "<|endoftext|>", "", LONG, "don't we'll I'VE", "\x1c\x85 x"]


def test_ids_equal_the_library(own, plain):
    assert [ids.tolist() for ids in own.encode(texts())] == [plain(t) for t in texts()]


@pytest.mark.parametrize("name,value", [("MEMORY", 2000), ("ROWS", 50), ("CHUNK", 10), ("LONG", 3)])
def test_bounds_change_nothing(own, plain, monkeypatch, name, value):
    monkeypatch.setattr(byte_pairs, name, value)
    own._forget()
    some = texts()[::7]
    ids = list(own.encode(some))
    assert [i.tolist() for i in ids] == [plain(t) for t in some]
    assert list(own.decode_texts(ids)) == [t.encode() for t in some]


def test_recursion_equals_the_heap(own):
    words = [t.encode() for t in texts() if 2 <= len(t.encode()) <= byte_pairs.LONG]
    lengths, ids = own.contract(words)
    for word, ids in zip(words, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
        assert byte_pairs.contract_long(own.single[np.frombuffer(word, np.uint8)].tolist(), own.merges) == ids.tolist()


def test_both_ways_to_split_agree(own):
    some = [f"a{chr(c)}a1{chr(c)}{chr(c)} !{chr(c)}  {chr(c)}" for c in range(byte_pairs.PLAIN)]
    some += [t for t in texts() if not byte_pairs.BEYOND.search(t)]
    assert [own.find_plain(t) for t in some] == [own.find_any(t) for t in some]


def test_decode_of_any_ids(own):
    r = np.random.default_rng(1)
    pieces = {rank: piece for piece, rank in own.ranks.items()}
    ids = [r.integers(0, len(pieces), n) for n in (0, 1, 50, 3)]
    assert list(own.decode_texts(ids)) == [b"".join(pieces[i] for i in part.tolist()) for part in ids]


def test_edge_table(spark, plain):
    table = docs(spark, token_ids=b"x", decoded="clash", id=7)
    coded = byte_pairs.decode_texts(byte_pairs.encode_texts(table))
    assert coded.columns == ["doc_id", "token_ids", "decoded"]
    got = sorted(((r["doc_id"], bytes(r["token_ids"]), bytes(r["decoded"])) for r in coded.collect()), key=repr)
    want = [(id_, np.array(plain(t or ""), "<u4").tobytes(), (t or "").encode()) for id_, t, *_ in ROWS]
    assert got == sorted(want, key=repr)
    assert byte_pairs.encode_texts(table.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, 1)], "token_ids binary, other int")
    assert bytes(byte_pairs.decode_texts(nulls).first()["decoded"]) == b""


def test_query(spark, plain, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op13_byte_pairs(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for id_, text, *_ in ROWS:
        ids = plain(text or "")
        digests = [hashlib.sha256(d).hexdigest() for d in (np.array(ids, "<u4").tobytes(), (text or "").encode())]
        want.append((id_, len(ids), *digests))
    assert got == sorted(want, key=repr)
