"""Logistic regression over hashed word n-grams, by follow-the-regularised-leader updates.

The shared core of the quality and toxicity operators: features, training, scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.batches import text_batches
from tiersmith.llm.lookup import SPREAD, mix, span_hashes

#: Bytes of text that are turned into features at once.
CHUNK = 1 << 19


@dataclass(frozen=True)
class Features:
    """What is counted as a feature: always presence in a text, never the number of times.

    ``fold_case`` lower-cases A-Z; ``marks`` keeps runs of punctuation as words; ``gaps`` lists
    the distances of word pairs (1: bigram, more: skip-gram); ``repeats`` adds one feature for
    a pair of equal neighbours, whatever the word. ``bits``: the table has ``2 ** bits`` slots.
    """

    bits: int = 20
    fold_case: bool = True
    marks: bool = False
    gaps: tuple[int, ...] = (1,)
    repeats: bool = False


@dataclass(frozen=True)
class Settings:
    """``rate`` and ``smooth`` set each coordinate's step ``rate / (smooth + sqrt(sum of squares))``."""

    rate: float = 1.0
    smooth: float = 1.0
    l1: float = 2.0
    l2: float = 0.0
    epochs: int = 6
    #: Rows that one task fits; more rows are fitted in shards, whose weights are averaged.
    shard_rows: int = 8_000
    #: At most so many labelled rows are learnt from, the first by a hash of their id.
    sample: int = 24_000


def _kinds(marks: bool) -> np.ndarray:
    """0: white space or left out, 1: part of a word, 2: punctuation."""
    kinds = np.full(256, 2 if marks else 0, np.uint8)
    kinds[list(b" \t\n\v\f\r") + list(range(9)) + list(range(14, 32)) + [127]] = 0
    kinds[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    return kinds


def chunk_features(texts: list[bytes], features: Features) -> tuple[np.ndarray, np.ndarray]:
    """Slot and text number of every feature occurrence in ``texts``; slot 0 is kept for the bias."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if features.fold_case:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    kind = _kinds(features.marks)[data]
    change = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
    ends = np.append(change[1:], len(data))
    inside = kind[change] > 0
    starts, ends = change[inside], ends[inside]
    words = span_hashes(data, starts, ends)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(bounds, starts, side="right")
    hashes, owners = [words], [owner]
    for gap in features.gaps:
        same = owner[gap:] == owner[:-gap]
        a, b = words[:-gap][same], words[gap:][same]
        hashes.append(mix(a * np.uint64(2 * gap + 1) + (b ^ np.uint64(gap)) * np.uint64(0x94D049BB133111EB)))
        owners.append(owner[gap:][same])
        if gap == 1 and features.repeats:
            twice = owners[-1][a == b]
            hashes.append(np.full(len(twice), SPREAD))
            owners.append(twice)
    top = np.uint64((1 << features.bits) - 1)
    slots = (np.concatenate(hashes) >> np.uint64(64 - features.bits)) % top + np.uint64(1)
    return slots.astype(np.int64), np.concatenate(owners)


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
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


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, slots: int, settings: Settings) -> np.ndarray:
    """Weights after passes over ``rows``, distinct slots with that of the bias, in the order given."""
    z, n = np.zeros(slots), np.zeros(slots)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        pull = np.sign(z) * settings.l1 - z
        return np.where(np.abs(z) > settings.l1, pull / ((settings.smooth + np.sqrt(n)) / settings.rate + settings.l2), 0.0)

    for _ in range(settings.epochs):
        for row, label in zip(rows, labels, strict=True):
            zi, ni = z[row], n[row]
            w = weights(zi, ni)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30.0, 30.0))) - label
            z[row] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / settings.rate * w
            n[row] = ni + g * g
    return weights(z, n)


def train(
    docs: DataFrame, labels: DataFrame, label: str, features: Features, settings: Settings, id_col: str, text_col: str
) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights that are not zero, learnt from the rows of ``labels`` (``id_col``, ``label``).

    A bounded sample of labelled ids is broadcast to the scan of the texts. Each shard of it is
    fitted in a task of its own, and the weights are averaged; what comes back is bounded by the
    number of slots. Labels other than 0 and 1 are left out; without any, all weights are zero.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label")).distinct()
    spread = F.xxhash64("_id", F.lit(label))
    total = known.count()
    if total > settings.sample:
        share = int(min(1.0, 1.05 * settings.sample / total + 0.001) * 1_000_000)
        known = known.filter(F.pmod(spread, F.lit(1_000_000)) < share).orderBy(spread, "_id").limit(settings.sample)
    shards = -(-min(max(total, 1), settings.sample) // settings.shard_rows)
    texts = text_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = texts.join(F.broadcast(known), "_id").select(
        F.pmod(F.hash("_id"), F.lit(shards)).alias("shard"), spread.alias("turn"), "_label", "_text"
    )

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in _chunks(_texts(batch.column(3))):
                slot, owner = chunk_features(part, features)
                pairs = np.unique(owner << features.bits | slot)
                cuts = np.searchsorted(pairs >> features.bits, np.arange(len(part) + 1))
                slot = (pairs & ((1 << features.bits) - 1)).astype(np.int32)
                found += [np.append(slot[a:b], np.int32(0)) for a, b in zip(cuts, cuts[1:], strict=False)]
            slots = pa.array(found, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], slots], names=["shard", "turn", "y", "slots"])

    def fit(group: pa.Table) -> pa.Table:
        turn, y = group.column("turn").to_numpy(), group.column("y").to_numpy()
        order = np.lexsort((y, turn))
        slots = group.column("slots").combine_chunks()
        flat, cuts = slots.flatten().to_numpy(), np.append(0, np.cumsum(slots.value_lengths().to_numpy()))
        w = fit_rows([flat[cuts[k] : cuts[k + 1]] for k in order], y[order], 1 << features.bits, settings)
        at = np.flatnonzero(w)
        return pa.table({"slot": at, "w": w[at]})

    ready = rows.mapInArrow(sparse, "shard int, turn bigint, y int, slots array<int>")
    fitted = ready.groupBy("shard").applyInArrow(fit, "slot bigint, w double")
    mean = fitted.groupBy("slot").agg((F.sum("w") / shards).alias("w")).orderBy("slot").toArrow()
    return mean.column("slot").to_numpy(), mean.column("w").to_numpy()


def score_column(text: Column, model: tuple[np.ndarray, np.ndarray], features: Features) -> Column:
    """Probability of label 1 for whole texts: a sparse dot product with the broadcast weights.

    A null text counts as empty; an empty text is scored by the bias alone.
    """
    slots, weights = model

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.zeros(1 << features.bits)
        table[slots] = weights
        for batch in batches:
            sums = []
            for part in _chunks(_texts(batch)):
                slot, owner = chunk_features(part, features)
                hit = np.flatnonzero(table[slot])
                pairs = np.unique(owner[hit] << features.bits | slot[hit])
                value = table[pairs & ((1 << features.bits) - 1)]
                sums.append(np.bincount(pairs >> features.bits, value, len(part)) + table[0])
            logits = np.concatenate(sums) if sums else np.zeros(0)
            yield pa.array(1.0 / (1.0 + np.exp(-np.clip(logits, -700, 700))), pa.float64())

    return score(text.cast("string"))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether the id's CRC-32, as text, leaves remainder ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
