"""Context-tree weighting: a byte model that mixes estimates over all context depths.

A byte is eight binary decisions, each made at a node of a binary tree of its leading bits. For
every context of 0 to ``depth`` bytes a node counts zeros and ones and estimates the next bit as
Krichevsky and Trofimov do; the weighted probability of a node is half its own estimate of all its
bits and half the product of its children's, the nodes of contexts longer by one byte. So the
tree weighs every way to cut contexts off, and the next bit is predicted by a mixture over all
depths, whose weights the training texts decide.

Nothing of the model is broadcast or gathered. Texts stand in blocks of bounded size, bucketed so
that they are never shuffled. A block sends its distinct byte strings of ``depth + 1``, sorted and
packed, to parts, ranges of the ``CUT`` bytes before the predicted one. A part holds all deeper
contexts of its own ones, so it sums counts and builds and mixes their levels on arrays; only the
levels above are grouped sums over all parts, and they are small, as there are few short contexts.
A part answers a block with one number per string in the block's own order, so no string travels
back. A string that no training text has is a node without counts, which changes no mixture and
predicts one half. Words of the unigram base go the same way, to parts by their hash.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.batches import text_batches
from tiersmith.llm.lookup import span_hashes
from tiersmith.session import cut_lineage, intermediates

#: One string of ``depth + 1`` bytes is one number beside the bit of words, so six is the most.
DEPTH = 6
#: Bytes of context that parts are told apart by: levels from here down are built inside a part.
CUT = 3
#: Bytes of text in a block, bytes looked at together within one, and bytes of text for each part.
BLOCK, CHUNK, PART = 16 << 20, 1 << 19, 8 << 20
#: Strings in a list before it is made distinct, and bytes of texts whose strings place the borders of parts.
PENDING, SAMPLE = 1 << 21, 16 << 20
#: Stands before and after each text; never part of UTF-8.
EDGE = 255
#: Words have this bit in their key, a 64-bit hash; byte strings don't. Alone it is the token that ends a text.
WORD = np.uint64(1 << 63)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def text_chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part: list[bytes] = []
    size = 0
    for text in texts:
        part.append(text)
        size += len(text) + 1
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def byte_strings(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``depth + 1`` bytes up to every byte and the end of each text, as one number, and starts of texts.

    The lowest byte is the predicted one, the highest the one before it, the next the one before that.
    """
    edge = bytes([EDGE])
    data = np.frombuffer(b"".join([edge * depth + t + edge for t in texts]), np.uint8)
    starts = np.cumsum([0, *(len(t) + depth + 1 for t in texts)])
    keys = np.zeros(len(data), np.uint64)
    for k in range(depth + 1):
        place = depth + 1 - k if k else 0
        keys[depth:] |= data[depth - k : len(data) - k].astype(np.uint64) << np.uint64(8 * place)
    keep = np.ones(len(data), bool)
    for k in range(depth):
        keep[starts[:-1] + k] = False
    return keys[keep], starts[:-1] - depth * np.arange(len(texts))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word, a run of other than ASCII white space."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = SPACES[data]
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    hashes = np.maximum(span_hashes(data, starts, ends) & ~WORD, np.uint64(1))
    return hashes | WORD, np.searchsorted(bounds, starts, side="right")


class Counted:
    """Distinct sorted keys with the sums of their counts, from lists of keys."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.pending += len(keys)
        if self.pending > PENDING:
            self.total()
            self.pending = 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, inverse = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([n for _, n in self.parts]), len(keys)).astype(np.int64)
        self.parts = [(keys, n)]
        return keys, n


def pack(values: np.ndarray) -> bytes:
    """Numbers of eight bytes, byte by byte and compressed; small numbers take little room."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(packed: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    if not size:
        return np.zeros(0, kind)
    planes = pa.decompress(packed[8:], 8 * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(kind).ravel()


def unpack_keys(packed: bytes) -> np.ndarray:
    """Sorted keys, packed as steps from each to the next."""
    return np.cumsum(unpack(packed, np.uint64), dtype=np.uint64)


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def in_blocks(docs: DataFrame, id_col: str, text_col: str, training: Column) -> DataFrame:
    """Rows ``(id, text, train, block)``, A-Z lower-cased; a block is a run of one task's rows, bounded in bytes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            texts = [(t or b"").lower() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            at = []
            for text in texts:
                if size and size + len(text) > BLOCK:
                    block, size = block + 1, 0
                size += len(text) + 1
                at.append(block)
            columns = [batch.column(0), pa.array(texts, pa.binary()), batch.column(2), pa.array(at, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "train", "block"])

    rows = text_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    return rows.mapInArrow(work, f"id {kind}, text binary, train boolean, block bigint")


def _distinct(texts: pa.ChunkedArray, train: np.ndarray, depth: int) -> tuple[Counted, Counted]:
    """Byte strings and words of texts with their training counts, zero for those of other texts only."""
    strings, tokens = Counted(), Counted()
    at = 0
    for chunk in texts.chunks:
        flags, at = train[at : at + len(chunk)], at + len(chunk)
        for flag in (False, True):
            for part in text_chunks([chunk[int(i)].as_py() for i in np.flatnonzero(flags == flag)]):
                for counted, keys in ((strings, byte_strings(part, depth)[0]), (tokens, words(part)[0])):
                    key, n = np.unique(keys, return_counts=True)
                    counted.add(key, n * flag)
                tokens.add(np.array([WORD]), np.array([len(part) * flag]))
    return strings, tokens


def _in_parts(keys: np.ndarray, tokens: np.ndarray, depth: int, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each part's byte strings start among sorted ``keys``, an order of words by part, and where each part's start in it."""
    parts = len(borders) + 1
    at = np.searchsorted(keys, borders << np.uint64(8 * (depth + 1 - min(CUT, depth))))
    part = (tokens % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return np.concatenate([[0], at, [len(keys)]]), order, np.searchsorted(part[order], np.arange(parts + 1))


def to_parts(blocks: DataFrame, depth: int, borders: np.ndarray) -> DataFrame:
    """Rows ``(block, part, keys, n, words, word_n)``: a block's distinct strings and words of one part, packed."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        strings, tokens = _distinct(rows["text"], rows["train"].to_numpy(), depth)
        block = rows["block"][0].as_py()
        (keys, n), (token, token_n) = strings.total(), tokens.total()
        at, order, word_at = _in_parts(keys, token, depth, borders)
        token, token_n = token[order], token_n[order]
        found, size = [], 0
        for part in np.flatnonzero((np.diff(at) > 0) | (np.diff(word_at) > 0)):
            a, b, c, d = at[part], at[part + 1], word_at[part], word_at[part + 1]
            row = (block, int(part), pack_keys(keys[a:b]), pack(n[a:b]), pack_keys(token[c:d]), pack(token_n[c:d]))
            found.append(row)
            size += sum(map(len, row[2:]))
            if size > 4 << 20:
                yield packed_rows(found)
                found, size = [], 0
        if found:
            yield packed_rows(found)

    def packed_rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
        columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["block", "part", "keys", "n", "words", "word_n"])

    def whole(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(work(rows)))

    schema = "block bigint, part int, keys binary, n binary, words binary, word_n binary"
    return blocks.select("block", "text", "train").groupBy("block").applyInArrow(whole, schema)


def part_borders(blocks: DataFrame, depth: int, parts: int, size: int) -> np.ndarray:
    """Contexts at which parts begin, from a sample of texts; they decide how even parts are, not what is found."""
    cut = min(CUT, depth)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = Counted()
        for batch in batches:
            for part in text_chunks(batch.column(0).to_pylist()):
                keys = np.unique(byte_strings(part, depth)[0])
                strings.add(keys, np.zeros(len(keys), np.int64))
        keys = strings.total()[0] >> np.uint64(8 * (depth + 1 - cut))
        found = np.unique(keys[np.arange(1, parts) * len(keys) // parts]) if len(keys) else keys
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], names=["border"])

    rows = blocks if size <= SAMPLE else blocks.sample(SAMPLE / size, seed=7)
    rows = rows.select("text").coalesce(1).mapInArrow(work, "border bigint").collect()
    return np.array(sorted({r.border for r in rows}), np.uint64)


def _log_gamma(x: Column) -> Column:
    """Stirling's series seven steps up, for positive arguments."""
    y = x + 7
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    steps = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def _estimate(zeros: Column, ones: Column) -> Column:
    """Log of the Krichevsky-Trofimov probability of any one order of so many zeros and ones."""
    half = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0)
    return half - math.log(math.pi)


def _half_gammas() -> np.ndarray:
    """Log gamma of 1/2, 3/2, 5/2 and so on."""
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1 << 12) + 0.5))]) + 0.5 * math.log(math.pi)


def _gammas() -> np.ndarray:
    """Log gamma of 1, 2, 3 and so on."""
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1 << 12)))])


HALVES, WHOLES = _half_gammas(), _gammas()


def _lookup(table: np.ndarray, n: np.ndarray, shift: float) -> np.ndarray:
    found = table[np.minimum(n, len(table) - 1)]
    large = np.flatnonzero(n >= len(table))
    x = n[large] + shift
    found[large] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return found


def own_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """As ``_estimate``, for arrays of whole numbers."""
    return _lookup(HALVES, zeros, 0.5) + _lookup(HALVES, ones, 0.5) - _lookup(WHOLES, zeros + ones, 1.0) - math.log(math.pi)


def _shorter(keys):
    """Keys ``(context, node or byte)`` with the farthest byte of the context taken off."""
    return (keys >> np.uint64(16) << np.uint64(8)) | (keys & np.uint64(255))


class Nodes:
    """The nodes of one level for one bit of the byte: their keys, counts and estimates, and the node of each string."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, k: int) -> None:
        byte = keys & np.uint64(255)
        node = keys - byte + (np.uint64(1 << k) | (byte >> np.uint64(8 - k)))
        new = np.concatenate([[True], node[1:] != node[:-1]])
        self.starts = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1
        self.keys = node[self.starts]
        self.bit = (byte >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
        self.ones = np.add.reduceat(n * self.bit, self.starts)
        self.zeros = np.add.reduceat(n, self.starts) - self.ones
        self.own = own_estimate(self.zeros, self.ones)
        self.weighted = self.own
        self.below = np.zeros(0)
        self.parent = np.zeros(0, np.int64)


class PartTree:
    """All levels from ``cut`` to ``depth`` over a part's sorted byte strings."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int, cut: int) -> None:
        self.levels = [(keys, n)]
        self.places: list[np.ndarray] = []
        for _ in range(depth - cut):
            keys, place = np.unique(_shorter(keys), return_inverse=True)
            n = np.bincount(place, n, len(keys)).astype(np.int64)
            self.levels.insert(0, (keys, n))
            self.places.insert(0, place)

    def nodes(self, k: int) -> list[Nodes]:
        """Each level's nodes of bit ``k``, the shortest contexts first, weighted from the deepest up."""
        found = [Nodes(keys, n, k) for keys, n in self.levels]
        for level, deeper, place in zip(found[-2::-1], found[:0:-1], self.places[::-1], strict=True):
            deeper.parent = level.of[place[deeper.starts]]
            level.below = np.bincount(deeper.parent, deeper.weighted, len(level.keys))
            level.weighted = np.logaddexp(level.own, level.below) - math.log(2.0)
        return found

    def upwards(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the nodes one level above, and their zeros, ones and weights as far as this part knows them."""
        top = self.nodes(k)[0]
        keys, place = np.unique(_shorter(top.keys), return_inverse=True)
        return keys, *(np.bincount(place, x, len(keys)) for x in (top.zeros, top.ones, top.weighted))

    def log_chances(self, above: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> np.ndarray:
        """Log probability of each string's last byte; ``above`` holds key, settled and open shares of the nodes above."""
        logs = np.zeros(len(self.levels[-1][0]))
        for k in range(8):
            found = self.nodes(k)
            top = found[0]
            if above is None:
                sure, open_ = np.zeros(len(top.keys)), np.ones(len(top.keys))
            else:
                at = np.searchsorted(above[0], _shorter(top.keys))
                sure, open_ = above[1][at], above[2][at]
            for level, deeper in zip(found, [*found[1:], None], strict=True):
                one = (level.ones + 0.5) / (level.zeros + level.ones + 1.0)
                if deeper is None:
                    p = (sure + open_ * one)[level.of]
                    logs += np.log(np.where(level.bit, p, 1.0 - p))
                    break
                share = 1.0 / (1.0 + np.exp(np.minimum(level.below - level.own, 700.0)))
                sure, open_ = sure + open_ * share * one, open_ * (1.0 - share)
                sure, open_ = sure[deeper.parent], open_[deeper.parent]
        return logs


def _part_counts(rows: pa.Table) -> tuple[Counted, Counted]:
    strings, tokens = Counted(), Counted()
    for keys, n, word, word_n in zip(*(rows[c] for c in ("keys", "n", "words", "word_n")), strict=True):
        strings.add(unpack_keys(keys.as_py()), unpack(n.as_py(), np.int64))
        tokens.add(unpack_keys(word.as_py()), unpack(word_n.as_py(), np.int64))
    return strings, tokens


def part_nodes(sent: DataFrame, depth: int) -> DataFrame:
    """Rows ``(part, key, zeros, ones, below)`` of the nodes right above each part.

    A row without a key holds the part's training tokens in ``zeros`` and distinct ones in ``ones``.
    """
    cut = min(CUT, depth)

    def work(rows: pa.Table) -> pa.Table:
        strings, tokens = _part_counts(rows)
        n = tokens.total()[1]
        found = [(np.array([-1]), np.array([n.sum()]), np.array([(n > 0).sum()]), np.zeros(1))]
        keys, n = strings.total()
        if cut and len(keys):
            tree = PartTree(keys, n, depth, cut)
            found += [tree.upwards(k) for k in range(8)]
        key, zeros, ones, below = (np.concatenate(c) for c in zip(*found, strict=True))
        columns = [np.full(len(key), rows["part"][0].as_py(), np.int32), *(c.astype(np.int64) for c in (key, zeros, ones)), below]
        return pa.table(dict(zip(["part", "key", "zeros", "ones", "below"], columns, strict=True)))

    return sent.groupBy("part").applyInArrow(work, "part int, key bigint, zeros bigint, ones bigint, below double")


def shares_above(nodes: DataFrame, cut: int) -> DataFrame:
    """Rows ``(part, key, sure, open)``: of the nodes right above parts, what levels up to theirs settle and leave open."""
    own = _estimate(F.col("zeros").cast("double"), F.col("ones").cast("double"))
    gap = F.abs(F.col("own") - F.col("below"))
    weighted = F.greatest("own", "below") + F.log1p(F.exp(-gap)) - math.log(2.0)
    parent = F.expr("shiftleft(shiftright(key, 16), 8) | (key & 255)")
    sums = [F.sum(c).alias(c) for c in ("zeros", "ones", "below")]
    levels = [cut_lineage(nodes.groupBy("key").agg(*sums).withColumn("own", own))]
    for _ in range(cut - 1):
        shorter = levels[0].select(parent.alias("key"), "zeros", "ones", weighted.alias("below"))
        levels.insert(0, cut_lineage(shorter.groupBy("key").agg(*sums).withColumn("own", own)))
    one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    share = 1.0 / (1.0 + F.exp(F.col("below") - F.col("own")))
    entering = levels[0].withColumns({"sure": F.lit(0.0), "open": F.lit(1.0)})
    for level in [*levels[1:], None]:
        leaving = entering.select(
            "key", (F.col("sure") + F.col("open") * share * one).alias("sure"), (F.col("open") * (1.0 - share)).alias("open")
        )
        leaving = cut_lineage(leaving)
        if level is not None:
            entering = level.withColumn("parent", parent).join(leaving.withColumnRenamed("key", "parent"), "parent")
    return nodes.select("part", "key").join(leaving, "key")


def answers(sent: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """Rows ``(block, part, logs, word_n)``: for each string and word a block has sent, its log probability or count."""
    cut = min(CUT, depth)

    def work(rows: pa.Table, above: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table(dict(zip(names, [pa.array([], k) for k in kinds], strict=True)))
        strings, tokens = _part_counts(rows)
        (keys, n), (token, token_n) = strings.total(), tokens.total()
        logs = np.zeros(0)
        if len(keys):
            known = np.argsort(above["key"].to_numpy())
            shares = tuple(above[c].to_numpy()[known] for c in ("key", "sure", "open"))
            shares = (shares[0].astype(np.uint64), *shares[1:]) if cut else None
            logs = PartTree(keys, n, depth, cut).log_chances(shares)
        logs_of, words_of = [], []
        for key, word in zip(rows["keys"], rows["words"], strict=True):
            logs_of.append(pack(logs[np.searchsorted(keys, unpack_keys(key.as_py()))]))
            words_of.append(pack(token_n[np.searchsorted(token, unpack_keys(word.as_py()))]))
        columns = [rows["block"], rows["part"], pa.array(logs_of, pa.binary()), pa.array(words_of, pa.binary())]
        return pa.table(dict(zip(names, columns, strict=True)))

    names, kinds = ["block", "part", "logs", "word_n"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return sent.groupBy("part").cogroup(above.groupBy("part")).applyInArrow(work, "block bigint, part int, logs binary, word_n binary")


def _scored(kind: str, depth: int, borders: np.ndarray, tokens: int, types: int):
    schema = f"id {kind}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double, n_bytes bigint"

    def work(rows: pa.Table, answers: pa.Table) -> pa.Table:
        train = rows["train"].to_numpy()
        strings, found = _distinct(rows["text"], train, depth)
        keys, known = strings.total()[0], found.total()[0]
        order = _in_parts(keys, known, depth, borders)[1]
        turn = np.argsort(answers["part"].to_numpy())
        logs = np.concatenate([unpack(answers["logs"][int(i)].as_py(), np.float64) for i in turn])
        counts = np.empty(len(known), np.int64)
        counts[order] = np.concatenate([unpack(answers["word_n"][int(i)].as_py(), np.int64) for i in turn])
        base = np.log10((counts + 1.0) / float(tokens + types + 1))
        end = int(np.searchsorted(known, WORD))
        columns = [[], [], [], [], []]
        for chunk in rows["text"].chunks:
            for part in text_chunks(chunk.to_pylist()):
                grams, starts = byte_strings(part, depth)
                gram, place = np.unique(grams, return_inverse=True)
                score = np.add.reduceat(logs[np.searchsorted(keys, gram)][place], starts) / math.log(10.0)
                hashes, owner = words(part)
                token = np.concatenate([np.searchsorted(known, hashes), np.full(len(part), end)])
                owner = np.concatenate([owner, np.arange(len(part))])
                sums = [np.bincount(owner, w, len(part)) for w in (None, counts[token] > 0, base[token])]
                done = [sums[0], sums[1].astype(np.int64), sums[2], score, np.fromiter(map(len, part), np.int64, len(part))]
                for column, values in zip(columns, done, strict=True):
                    column.append(values)
        names = ["id", "train", "n_tokens", "n_known", "base_score", "score", "n_bytes"]
        return pa.table([rows["id"], rows["train"], *(pa.array(np.concatenate(c)) for c in columns)], names=names)

    return work, schema


def _bucketed(rows: DataFrame, buckets: int, column: str) -> DataFrame:
    """``rows`` written to the shared folder in buckets by ``column``, so that later groups need no shuffle.

    Only a table can say that it has buckets; its name is dropped at once, its files stay.
    """
    spark = rows.sparkSession
    name = f"buckets_{uuid.uuid4().hex}"
    writer = rows.write.format("parquet").bucketBy(buckets, column).option("compression", "zstd")
    writer.option("path", f"{intermediates(spark)}/{name}").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def score_texts(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH
) -> DataFrame:
    """Rows ``(id, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)``, one per row of ``docs``.

    ``training`` says which rows are learnt from; all are scored. ``score`` is the log10 probability of
    the whole text, A-Z lower-cased, and its end; ``bits_per_byte`` is its code length over the bytes with
    the end. ``base_score`` is the add-one unigram log10 probability of its words and its end; words are
    told apart by 63-bit hashes. A null text counts as empty, that is the end alone; without training
    rows every bit has probability one half and every token that of an empty vocabulary; repeated
    rows count as often as they come; an empty table gives an empty one. Blocks and packed strings stay
    in the shared folder, as the result is read from them.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(100_000, max(least, -(-size // BLOCK)))
    blocks = _bucketed(in_blocks(docs, id_col, text_col, training), buckets, "block")
    borders = part_borders(blocks, depth, min(1 << 16, max(least, -(-size // PART))), size)
    parts = len(borders) + 1
    sent = _bucketed(to_parts(blocks, depth, borders).repartition(parts, "part"), parts, "part")
    nodes = cut_lineage(part_nodes(sent, depth))
    tokens, types = nodes.filter("key < 0").agg(F.coalesce(F.sum("zeros"), F.lit(0)), F.coalesce(F.sum("ones"), F.lit(0))).first()
    nodes = nodes.filter("key >= 0")
    above = shares_above(nodes, depth if depth < CUT else CUT) if depth else nodes.select("part", "key", F.lit(0.0).alias("sure"), F.lit(1.0).alias("open"))
    work, schema = _scored(kind, depth, borders, tokens, types)
    scored = blocks.groupBy("block").cogroup(answers(sent, above, depth).groupBy("block")).applyInArrow(work, schema)
    return scored.select(
        F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score", "score", (-F.col("score") * math.log2(10.0) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
