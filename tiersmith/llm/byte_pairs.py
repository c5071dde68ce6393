"""Byte-level BPE by relational steps: a recursive query contracts words, an ordered aggregation decodes.

Each task keeps a DuckDB connection with the vocabulary as two relations: pieces by id, and merges
``(left, right, merged)``, one row for every way to cut a piece in two others. New words of a batch
become token-position rows; a recursive query joins neighbours with the merges and contracts
each word's leftmost pair of the smallest rank until no word has one. Words already contracted are
remembered, up to a bound in bytes.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.batches import text_batches
from tiersmith.llm.lookup import ranges

#: Bytes of words, ids and their bookkeeping that a worker remembers before it starts afresh.
MEMORY = 48 << 20
WORD_COST = 160
#: Token rows that one query contracts or decodes, and characters of text that are split at once.
ROWS, CHUNK = 1 << 18, 1 << 21
#: The recursion keeps every step of a word, so longer words are contracted by ``contract_long``.
LONG = 128
#: Texts without characters from here on are split by lists of characters, which takes about half the time.
PLAIN = 0x250
BEYOND = re.compile(f"[{chr(PLAIN)}-{chr(0x10FFFF)}]")
#: Pieces are stored as text of one character per byte: the byte's value above this.
SHIFT = 256

#: ``code`` holds rank, place and next place of a row's pair with its neighbour, null without a merge.
CONTRACT = """
WITH RECURSIVE steps(word, pos, id, next_pos, next_id, code, step) AS (
  SELECT word, pos::UTINYINT, id, next_pos::UTINYINT, next_id, (merged::BIGINT << 16) | (pos << 8) | next_pos, 0::UTINYINT
  FROM start_rows LEFT JOIN merges ON lft = id AND rgt = next_id
  UNION ALL
  SELECT word, pos, id, next_pos, next_id,
    CASE WHEN fresh THEN (merged::BIGINT << 16) | (pos::BIGINT << 8) | next_pos ELSE code END, (step + 1)::UTINYINT
  FROM (
    SELECT s.word, s.pos, s.code, s.step, s.pos = b.pos OR s.next_pos = b.pos AS fresh,
      CASE WHEN s.pos = b.pos THEN b.id ELSE s.id END AS id,
      CASE WHEN s.pos = b.pos THEN b.next_pos ELSE s.next_pos END AS next_pos,
      CASE WHEN s.pos = b.pos THEN b.next_id WHEN s.next_pos = b.pos THEN b.id ELSE s.next_id END AS next_id
    FROM steps s JOIN (
      SELECT w.word, ((best >> 8) & 255)::UTINYINT AS pos, (best >> 16)::INTEGER AS id, (best & 255)::UTINYINT AS gone, r.next_pos, r.next_id
      FROM (SELECT word, min(code) AS best FROM steps WHERE code IS NOT NULL GROUP BY word) w
      JOIN steps r ON r.word = w.word AND r.pos = (w.best & 255)::UTINYINT
    ) b ON b.word = s.word WHERE s.pos <> b.gone
  ) LEFT JOIN merges ON fresh AND lft = id AND rgt = next_id
)
SELECT word, id FROM steps JOIN (SELECT word, max(step) AS step FROM steps GROUP BY word) USING (word, step)
ORDER BY word, pos
"""
DECODE = """
SELECT part, string_agg(piece, '' ORDER BY pos) AS text
FROM token_rows JOIN pieces USING (id) GROUP BY part ORDER BY part
"""


class BytePairs:
    """The vocabulary of one rank file as relations, and the words contracted so far."""

    def __init__(self, ranks: str, pattern: str) -> None:
        import duckdb
        import regex

        with open(ranks, "rb") as lines:
            self.ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.find_any = regex.compile(pattern).findall
        self.find_plain = re.compile(spelled_out(pattern)).findall
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        cuts = [
            (self.ranks[piece[:i]], self.ranks[piece[i:]], rank)
            for piece, rank in self.ranks.items()
            for i in range(1, len(piece))
            if piece[:i] in self.ranks and piece[i:] in self.ranks
        ]
        self.merges = {(a, b): c for a, b, c in cuts}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self._table("merges", dict(zip(("lft", "rgt", "merged"), np.array(cuts, np.int32).T, strict=True)))
        shown = ["".join(chr(SHIFT + b) for b in piece) for piece in self.ranks]
        self._table("pieces", {"id": np.array(list(self.ranks.values()), np.int32), "piece": shown})
        self._forget()

    def find(self, text: str) -> list[str]:
        """The words of a text."""
        return (self.find_any if BEYOND.search(text) else self.find_plain)(text)

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _rows(self, name: str, sql: str, columns: dict) -> pa.Table:
        self.con.register(name, pa.table(columns))
        out = self.con.sql(sql).to_arrow_table()
        self.con.unregister(name)
        return out

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.size = 0

    def _add(self, words: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.size += len(words) * WORD_COST + 4 * (sum(map(len, words)) + len(ids))

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of distinct new words."""
        whole: list[str] = []
        open_: list[str] = []
        size = 0
        for word in words:
            raw = word.encode()
            if raw in self.ranks:  # a word that is a piece is not cut at all
                whole.append(word)
            elif len(raw) > LONG:
                ids = np.array(contract_long(self.single[np.frombuffer(raw, np.uint8)].tolist(), self.merges))
                self._add([word], np.array([len(ids)]), ids)
            else:
                open_.append(word)
                size += len(raw)
                if size > ROWS:
                    self._add(open_, *self.contract([w.encode() for w in open_]))
                    open_, size = [], 0
        if open_:
            self._add(open_, *self.contract([w.encode() for w in open_]))
        if whole:
            ids = np.fromiter((self.ranks[w.encode()] for w in whole), np.int64, len(whole))
            self._add(whole, np.ones(len(whole), np.int64), ids)

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids in order."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        pos, ids = ranges(np.zeros(len(words), np.int64), lengths), self.single[np.frombuffer(b"".join(words), np.uint8)]
        last = pos == np.repeat(lengths - 1, lengths)
        columns = {
            "word": np.repeat(np.arange(len(words), dtype=np.int32), lengths),
            "pos": pos.astype(np.int32),
            "id": ids,
            "next_pos": pa.array((pos + 1).astype(np.int32), mask=last),
            "next_id": pa.array(np.append(ids[1:], np.int32(0)), mask=last),
        }
        out = self._rows("start_rows", CONTRACT, columns)
        return np.bincount(out["word"].to_numpy(), minlength=len(words)), out["id"].to_numpy()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        for group in _text_groups(texts):
            split = [self.find(t) for t in group]
            if self.size > MEMORY:
                self._forget()
            # In order of first sight, so that the numbering does not hang on the hash seed.
            new = [w for w in dict.fromkeys(itertools.chain.from_iterable(split)) if w not in self.known]
            if new:
                self._learn(new)
            for words in split:
                at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                yield self.ids[ranges(self.starts[at], self.lengths[at])]

    def decode(self, texts: list[np.ndarray]) -> Iterator[bytes]:
        """Bytes of each text's ids; long texts pass in several parts."""
        for group in _groups(texts):
            ids = np.concatenate([part for _, part in group])
            lengths = np.array([len(part) for _, part in group])
            columns = {
                "part": np.repeat(np.arange(len(group), dtype=np.int32), lengths),
                "pos": ranges(np.zeros(len(group), np.int64), lengths).astype(np.int32),
                "id": ids.astype(np.int32),
            }
            out = self._rows("token_rows", DECODE, columns)
            parts = dict(zip(out["part"].to_pylist(), out["text"].to_pylist(), strict=True))
            for i, (last, _) in enumerate(group):
                yield last, parts.get(i, "").encode("utf-16-le")[::2]

    def decode_texts(self, texts: list[np.ndarray]) -> Iterator[bytes]:
        held = []
        for last, part in self.decode(texts):
            held.append(part)
            if last:
                yield b"".join(held)
                held = []


def _text_groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, in groups of about ``CHUNK`` characters: a query for many words costs less per word."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


def _groups(texts: list[np.ndarray]) -> Iterator[list[tuple[bool, np.ndarray]]]:
    """Parts of texts, each with whether it ends its text, in groups of about ``ROWS`` ids."""
    group, size = [], 0
    for ids in texts:
        for at in range(0, max(len(ids), 1), ROWS):
            part = ids[at : at + ROWS]
            group.append((at + ROWS >= len(ids), part))
            size += len(part)
            if size >= ROWS:
                yield group
                group, size = [], 0
    if group:
        yield group


def spelled_out(pattern: str) -> str:
    """The pattern with its classes of letters, numbers and white space as lists of the characters below ``PLAIN``."""
    import regex

    for name in ("\\p{L}", "\\p{N}", "\\s"):
        listed = "".join(re.escape(chr(c)) for c in range(PLAIN) if regex.match(name, chr(c)))
        # First inside lists of characters, then where a class stands alone.
        pattern = re.sub(r"\[[^\]]*\]", lambda m, n=name, x=listed: m[0].replace(n, x), pattern)
        pattern = re.sub(rf"(?<!\[)(?<!\[\^){re.escape(name)}(?![^\[]*\])", lambda m, x=listed: f"[{x}]", pattern)
    outside = "".join(re.escape(chr(c)) for c in range(PLAIN) if regex.match(r"\s", chr(c)))
    return pattern.replace("\\S", f"[^{outside}]")


def contract_long(ids: list[int], merges: dict[tuple[int, int], int]) -> list[int]:
    """The same contraction of one long word: a heap of open pairs over linked tokens."""
    after = [*range(1, len(ids)), -1]
    before = list(range(-1, len(ids) - 1))
    heap = [(merges[pair], i, *pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in merges]  # noqa: B905
    heapq.heapify(heap)
    while heap:
        merged, i, left, right = heapq.heappop(heap)
        j = after[i]
        if j < 0 or ids[i] != left or ids[j] != right:
            continue  # one of the two has become part of another token
        k = after[j]
        ids[i], ids[j], after[i], after[j] = merged, -1, k, -1
        if k >= 0:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b >= 0 and (ids[a], ids[b]) in merges:
                heapq.heappush(heap, (merges[ids[a], ids[b]], a, ids[a], ids[b]))
    return [t for t in ids if t >= 0]


@functools.lru_cache(maxsize=1)
def byte_pairs(ranks: str, pattern: str) -> BytePairs:
    """One vocabulary and memory of words for all tasks that a Python worker runs."""
    return BytePairs(ranks, pattern)


def _vocabulary(ranks: str | None, pattern: str | None) -> tuple[str, str]:
    if ranks is None or pattern is None:
        import public_tokenizers

        ranks = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    return ranks, pattern


def encode_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Rows ``(id, token_ids)``: each whole text's ids as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded by itself with the ranks in file ``ranks``, which every
    executor can open. A null or empty text has no ids, text that looks like a special token is
    ordinary text, a null id and repeated rows are carried along, an empty table gives an empty one,
    and other columns are not read. Nothing is shuffled; a word costs one contraction per worker.
    """
    ranks, pattern = _vocabulary(ranks, pattern)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = byte_pairs(ranks, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = pa.array([found.astype("<u4").tobytes() for found in words.encode(texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "token_ids"])

    rows = text_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, f"id {kind}, token_ids binary").withColumnRenamed("id", id_col)


def decode_texts(encoded: DataFrame, ids_col: str = "token_ids", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``encoded`` with a column ``decoded``: the bytes that each row's ids stand for.

    No ids, or null ones, are no bytes. The bytes need not be valid UTF-8, as ids may end inside a
    character. Nothing is shuffled.
    """
    ranks, pattern = _vocabulary(ranks, pattern)
    at = encoded.columns.index(ids_col)
    names = [*encoded.columns, "decoded"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = byte_pairs(ranks, pattern)
        for batch in batches:
            ids = [np.frombuffer(found or b"", "<u4") for found in batch.column(at).to_pylist()]
            decoded = pa.array(words.decode_texts(ids), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return text_batches(encoded).mapInArrow(work, f"{fields}, decoded binary")
