"""Best-fit packing of token sequences: large-item matching, then best fit of the small ones.

Lengths are whole numbers up to the capacity, so the packing is decided on the count of
pieces per length, which is as small at any size of the corpus: pieces above a third of the
capacity are matched in pairs, each with the longest that fits beside it, and the others fill
the gaps, longest first, each in the tightest gap. What comes out is a short list of rules
("pieces 100 to 899 of length 40 lie two each in sequences 7 to 406, from place 980"), and
each piece finds its place by its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiersmith.llm.batches import text_batches
from tiersmith.llm.lookup import KeyIndex, ranges, span_hashes
from tiersmith.session import cut_lineage

#: Texts without other characters are split here; the tokenizer itself takes the rest.
ODD = re.compile("[^\t-\r\x20-~À-ÖØ-öø-ɏ]")
END_OF_TEXT = "<|endoftext|>"
#: Bytes that a worker gives to the tokens of distinct words before it starts afresh, and bytes of text that it splits at once.
MEMORY, CHUNK = 12 << 20, 1 << 17
#: Bytes of a word's offset, length and slots in the index.
WORD_COST = 64
BORDER, LETTER, DIGIT, SPACE, OTHER = range(5)


def _kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    kinds[0] = BORDER
    kinds[list(b" \t\n\v\f\r")] = SPACE
    kinds[48:58] = DIGIT
    kinds[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
    return kinds


KINDS = _kinds()


def split_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words that the byte-level vocabulary's pattern finds, in order.

    ``data`` holds plain texts, each followed by a zero byte. A word is a run of letters, digits
    or other marks with one blank before it, a contraction after an apostrophe, or white space: all
    of a run before the end of a text, else all but its last character, which stands alone unless
    it is a blank.
    """
    kind = KINDS[data]
    starts = np.flatnonzero((np.diff(kind, prepend=np.uint8(255)) != 0) | (kind == BORDER))
    ends = np.append(starts[1:], len(data))
    kinds = kind[starts]
    first, last = data[starts], data[ends - 1]
    next_kind = np.append(kinds[1:], BORDER)
    before = np.concatenate([[BORDER], kinds[:-1]])
    blank = (before == SPACE) & (np.concatenate([[0], last[:-1]]) == 32)
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    one, two = padded[ends], padded[ends + 1]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    pair = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
    mark = (kinds == OTHER) & (ends - starts == 1) & (first == ord("'")) & ~blank & (next_kind == LETTER)
    taken = np.where(mark, np.where(short, 1, np.where(pair, 2, 0)), 0)
    word = (kinds != SPACE) & (kinds != BORDER)
    gone = np.concatenate([[0], taken[:-1]])
    starts_ = [(starts - (blank & word) + gone)[word]]
    ends_ = [(ends + taken)[word]]
    space = kinds == SPACE
    closing = space & (next_kind == BORDER)
    inner = space & ~closing
    many = inner & (ends - starts > 1)
    alone = inner & (last != 32)
    starts_ += [starts[closing], starts[many], ends[alone] - 1]
    ends_ += [ends[closing], ends[many] - 1, ends[alone]]
    start, end = np.concatenate(starts_), np.concatenate(ends_)
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    full = end > start
    return start[full], end[full]


class WordTokens:
    """Token ids of texts; each distinct word is tokenised once and remembered."""

    def __init__(self, ranks: str, pattern: str) -> None:
        import base64

        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "byte-level", pat_str=pattern, mergeable_ranks=table, special_tokens={END_OF_TEXT: len(table)}
        )
        self._forget()

    def _forget(self) -> None:
        self.index = KeyIndex()
        self.offsets, self.lengths, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _learn(self, words: list[str]) -> None:
        ids = [self.encoding.encode_ordinary(w) for w in words]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.offsets = np.concatenate([self.offsets, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.pool = np.concatenate([self.pool, np.array([i for w in ids for i in w], "<u4")])

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        part: list[str] = []
        size = 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= CHUNK:
                yield from self._chunk(part)
                part, size = [], 0
        if part:
            yield from self._chunk(part)

    def _chunk(self, texts: list[str]) -> Iterator[np.ndarray]:
        odd = [bool(ODD.search(t)) or END_OF_TEXT in t for t in texts]
        plain = [b"" if o else t.encode() for t, o in zip(texts, odd, strict=True)]
        data = np.frombuffer(b"\0".join([*plain, b""]), np.uint8)
        starts, ends = split_words(data)
        hashes = span_hashes(data, starts, ends)
        rows = self.index.find(hashes)
        if (rows < 0).any():
            if self.index.size * WORD_COST + 4 * len(self.pool) > MEMORY:
                self._forget()
                rows[:] = -1
            new, at = np.unique(hashes[rows < 0], return_index=True)
            at = np.flatnonzero(rows < 0)[at]
            self._learn([data[a:b].tobytes().decode() for a, b in zip(starts[at], ends[at], strict=True)])
            self.index.add(new)
            rows = self.index.find(hashes)
        lengths = self.lengths[rows]
        ids = self.pool[ranges(self.offsets[rows], lengths)]
        borders = np.cumsum([0, *(len(p) + 1 for p in plain)])
        upto = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, borders)]
        for i, text in enumerate(texts):
            if odd[i]:
                yield self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4")
            else:
                yield ids[upto[i] : upto[i + 1]]


@functools.lru_cache(maxsize=1)
def word_tokens(ranks: str, pattern: str) -> WordTokens:
    """One memory of words for all tasks that a Python worker runs."""
    return WordTokens(ranks, pattern)


def cut_points(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """Start and end of each piece: all of ``capacity`` tokens but for the first."""
    first = tokens % capacity or min(tokens, capacity)
    return [(0, first), *((a, a + capacity) for a in range(first, tokens, capacity))] if tokens else []


def token_pieces(
    docs: DataFrame, ranks: str, pattern: str, id_col: str, text_col: str, capacity: int, end_id: int
) -> DataFrame:
    """Rows ``(id, piece, start, length, token_ids, part, turn)``; ``token_ids`` is little-endian unsigned 32-bit.

    ``part`` numbers the task that made the row and ``turn`` counts its rows of that length; both
    are fixed once the rows are written.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "piece", "start", "length", "token_ids", "part", "turn"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(ranks, pattern)
        turns: Counter[int] = Counter()
        part = TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            at, rows, size = [], [], 0
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, found in enumerate(words.texts(texts)):
                ids = found.tobytes() + end
                for piece, (a, b) in enumerate(cut_points(len(ids) // 4, capacity)):
                    at.append(i)
                    rows.append((piece, a, b - a, ids[4 * a : 4 * b], part, turns[b - a]))
                    turns[b - a] += 1
                size += len(ids)
                if size > 1 << 22:
                    yield record(batch, at, rows)
                    at, rows, size = [], [], 0
            if rows:
                yield record(batch, at, rows)

    def record(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], names=names)

    rows = text_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, piece int, start bigint, length bigint, token_ids binary, part int, turn bigint"
    return rows.mapInArrow(work, schema)


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rules ``(length, first_rank, end_rank, first_sequence, per_sequence, offset)`` for pieces counted by length.

    Sequences of one content form a run; a rule lays ``per_sequence`` pieces side by side in each
    sequence of a run. There are at most a few runs per length, so the plan is bounded by the
    capacity, whatever the counts.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    rules: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free places -> runs (first sequence, sequences)
    free: list[int] = []
    sequences = 0

    def lay(length: int, count: int, first: int, each: int, offset: int) -> None:
        rules.append((length, used[length], used[length] + count, first, each, offset))
        used[length] += count
        left[length] -= count

    def put(gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(free, gap)
            gaps[gap].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    for length in reversed(large):
        while left[length]:
            room = capacity - length
            fits = [n for n in large[: bisect.bisect_right(large, min(room, length))] if left[n] > (n == length)]
            mate = fits[-1] if fits else None
            if mate is None:
                count = left[length]
                lay(length, count, sequences, 1, 0)
                put(room, sequences, count)
            elif mate == length:
                count = left[length] // 2
                lay(length, 2 * count, sequences, 2, 0)
                put(room - length, sequences, count)
            else:
                count = min(left[length], left[mate])
                lay(length, count, sequences, 1, 0)
                lay(mate, count, sequences, 1, length)
                put(room - mate, sequences, count)
            sequences += count
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(free, length)
            if at == len(free):
                each = capacity // length
                put(capacity, sequences, count := -(-left[length] // each))
                sequences += count
                continue
            gap = free[at]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], free[at]
            each, offset = gap // length, capacity - gap
            full = min(count, left[length] // each)
            if full:
                lay(length, full * each, first, each, offset)
                put(gap - each * length, first, full)
            rest = min(left[length], each - 1) if full < count else 0
            if rest:
                lay(length, rest, first + full, rest, offset)
                put(gap - rest * length, first + full, 1)
            put(gap, first + full + (rest > 0), count - full - (rest > 0))
    return rules


RULE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("length", "first_rank", "end_rank", "first_sequence", "each", "place")]
)


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """``sequence_id`` and ``offset`` for written rows with ``length``, ``part`` and ``turn``; both of these go."""
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # The plan has a few rules per length and is bounded by the capacity.
    rules = F.broadcast(pieces.sparkSession.createDataFrame(plan_packing(counts, capacity), RULE))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("n").over(earlier) - F.col("n")
    offsets = sizes.select("length", "part", before.alias("before"))
    # A few lengths of a few parts per task: a hash table of them spares the pieces, ids and all, a sort.
    ranked = pieces.join(offsets.hint("shuffle_hash"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("turn"))
    inside = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    placed = ranked.join(rules, "length").filter(inside)
    step = F.col("rank") - F.col("first_rank")
    return placed.select(
        *(c for c in pieces.columns if c not in ("part", "turn")),
        (F.col("first_sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("place") + (step % F.col("each")) * F.col("length")).alias("offset"),
    )


def pack_documents(
    docs: DataFrame,
    ranks: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    derive: dict | None = None,
    keep_ids: bool = True,
) -> DataFrame:
    """Every document as pieces placed in sequences of at most ``capacity`` tokens.

    Rows ``(id, piece, start, length, token_ids, sequence_id, offset)``: ``token_ids`` are the
    little-endian unsigned 32-bit ids of the piece, ``start`` counts its document's ids before it,
    ``offset`` its place in the sequence, gapless from 0. A text is tokenised by the vocabulary in
    file ``ranks`` and ends with ``end_id``; only texts above ``capacity`` are cut, and only their
    first piece may be shorter. ``derive`` adds columns computed from a piece's, and
    ``keep_ids=False`` leaves the ids out, so that they are not shuffled.

    A null or empty text is the end id alone; repeated rows are packed as often as they come, a
    null id is carried along; an empty table gives an empty one; other columns are not read.
    Texts are tokenised once, and the pieces written, before they are counted and placed.
    """
    if ranks is None:
        import public_tokenizers

        ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    pieces = token_pieces(docs, ranks, pattern, id_col, text_col, capacity, end_id).withColumns(derive or {})
    placed = place_pieces(cut_lineage(pieces if keep_ids else pieces.drop("token_ids")), capacity)
    return placed.withColumnRenamed("id", id_col)
