"""Target-distribution importance resampling: weigh texts against a target corpus, draw the best keys.

Every run of one to three words falls into a bucket. How much likelier a bucket is in the target
corpus than among the documents is its gain; a text's weight is the sum of its runs' gains. A
Gumbel draw per document, added to the weight, turns "the k highest scores" into a sample without
replacement whose chances follow the weights.

The k-th key is found by a distributed quickselect: a round takes a few random keys of the range
that is still open as pivots, counts the rows before, at and after each exactly, and keeps the part
that holds the k-th. Nothing is sorted but the winners.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiersmith.llm.batches import text_batches
from tiersmith.session import cut_lineage

#: Runs of ASCII letters and digits and of all that lies beyond ASCII, in UTF-8 with A-Z in lower case.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Words of a text that are turned into buckets at once; memory stays bounded for the longest texts.
RUN = 1 << 16
#: Random keys that a round of the quickselect compares all open rows with.
PIVOTS = 15
ORDER = ("score", "id", "turn")


def text_buckets(text: str | None, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, int]]:
    """Buckets of all runs of 1 to ``longest`` words, in parts, each with the words that it starts runs at.

    A run's hash is continued from that of the run one word shorter, so each word's bytes are
    read ``longest`` times however long the runs are.
    """
    words = WORD.findall((text or "").encode().translate(LOWER))
    for at in range(0, len(words), RUN):
        here = min(RUN, len(words) - at)
        part = words[at : at + here + longest - 1]
        sums = list(map(crc32, part[:here]))
        found = sums.copy()
        joined = [b" " + w for w in part]
        for k in range(1, longest):
            sums = list(map(crc32, joined[k : k + here], sums))
            found += sums
        yield np.array(found, np.uint32) % np.uint32(buckets), here


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """Rows ``(bucket, n)`` over all texts; a task adds up its own before anything is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for found, _ in text_buckets(text.as_py(), longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    rows = text_batches(texts).select(F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """Gain of every bucket in thousandths, rounded down: one number per bucket, whatever the corpora hold."""
    sides = [bucket_counts(side, text_col, longest, buckets).withColumn("side", F.lit(i)) for i, side in enumerate((docs, target))]
    held = np.zeros((2, buckets), np.int64)
    for row in sides[0].unionByName(sides[1]).collect():  # at most two rows per bucket
        held[row["side"], row["bucket"]] = row["n"]
    own, wanted = ((h + 1).astype(float) for h in held)
    all_own, all_wanted = (float(h.sum() + buckets) for h in held)
    return np.floor(1000 * np.log(wanted * all_own / (own * all_wanted))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, longest: int) -> DataFrame:
    """Rows ``(id, n_words, n_features, weight)`` of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column(1)):
                for found, words in text_buckets(text.as_py(), longest, len(gains)):
                    sums[:, i] += (words, len(found), gains[found].sum())
            columns = [batch.column(0), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_features", "weight"])

    rows = text_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(id_col: Column, seed: int) -> Column:
    """A Gumbel draw in thousandths, rounded down, fixed by the id; a null id counts as an empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def before(key: tuple, strictly: bool = True) -> Column:
    """Whether a row comes before ``key``: higher scores first, then smaller ids, null ids last, then turns."""
    score, id_, turn = key
    turn_first = F.col("turn") < F.lit(turn) if strictly else F.col("turn") <= F.lit(turn)
    if id_ is None:
        same_id, id_first = F.col("id").isNull(), F.col("id").isNotNull()
    else:
        same_id, id_first = F.col("id").eqNullSafe(F.lit(id_)), F.coalesce(F.col("id") < F.lit(id_), F.lit(False))
    same = F.col("score") == F.lit(score)
    return (F.col("score") > F.lit(score)) | (same & (id_first | (same_id & turn_first)))


def _place(row) -> tuple:
    return -row["score"], row["id"] is None, row["id"] if row["id"] is not None else 0, row["turn"]


def kth_key(rows: DataFrame, k: int, seed: int) -> tuple | None:
    """The k-th key ``(score, id, turn)`` of written rows, whose keys are distinct; None for k = 0.

    A round reads the key columns twice: once for the open rows with the smallest random numbers,
    which become pivots, and once to count before and at each pivot. With 15 pivots the open part
    shrinks about tenfold a round. The counts and pivots of a round are all that reaches the driver.
    """
    if k <= 0:
        return None
    low = high = None  # the k-th key comes after low (wholly counted in `gone`) and before high
    gone, turn = 0, 0
    while True:
        part = rows.select(*ORDER)
        part = part if low is None else part.filter(~before(low, strictly=False))
        part = part if high is None else part.filter(before(high))
        chance = F.xxhash64(*ORDER, F.lit(seed + turn))
        pivots = sorted(part.orderBy(chance, *ORDER).limit(PIVOTS).collect(), key=_place)
        keys = [tuple(r[c] for c in ORDER) for r in pivots]
        counts = part.agg(*(F.count_if(before(key)).alias(f"b{i}") for i, key in enumerate(keys))).first()
        for i, key in enumerate(keys):
            earlier = gone + counts[f"b{i}"]
            if earlier + 1 == k:
                return key
            if earlier >= k:
                high = key
                gone = gone if i == 0 else gone + counts[f"b{i - 1}"] + 1
                low = low if i == 0 else keys[i - 1]
                break
        else:
            low, gone = keys[-1], gone + counts[f"b{len(keys) - 1}"] + 1
        turn += 1


def number_in_order(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, ... in that order, sorted in ranges of similar size.

    The ranges' parts are written with their numbers, so a lost executor can't deal the rows anew;
    one count per part reaches the other rows.
    """
    parts = cut_lineage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n"))
    # One row per part of the shuffle, whose number the session sets.
    ahead = {r["_part"]: r["n"] for r in sizes.collect()}
    done, starts = 0, []
    for part in sorted(ahead):
        starts.append((part, done))
        done += ahead[part]
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part int, _start bigint"))
    turn = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(starts, "_part").withColumn("rank", (F.col("_start") + turn).cast("long")).drop("_part", "_start")


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 5,
    least_words: int = 20,
    longest: int = 3,
    buckets: int = 10_000,
    seed: int = 42,
) -> DataFrame:
    """Every document as ``(id, n_words, n_features, weight, score, rank)``; ``rank`` numbers the drawn ones.

    ``percent`` of the documents with ``least_words`` words or more are drawn, rounded down: those
    of the highest score, ties to the smaller id. Words are runs of letters, digits and anything
    beyond ASCII, A-Z in lower case; a feature is a run of 1 to ``longest`` words in its bucket.

    A null or empty text has no features and weight 0 and is never drawn (unless ``least_words`` is
    0); a null id draws like an empty one and comes after all ids of its score; rows that repeat
    are documents of their own, and ties among them go by their place in the written table; without
    documents the result is empty, without target texts every bucket has the target's even share.
    Other columns are not read. Texts are read twice, once for counts and once for weights.
    """
    gains = bucket_gains(docs, target, text_col, longest, buckets)
    weighed = weigh(docs, gains, id_col, text_col, longest).withColumn("turn", F.monotonically_increasing_id())
    scored = cut_lineage(weighed.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)))
    open_ = scored.filter(F.col("n_words") >= least_words)
    last = kth_key(open_, percent * open_.count() // 100, seed)
    if last is None:
        ranked = scored.withColumn("rank", F.lit(None).cast("long"))
    else:
        drawn = (F.col("n_words") >= least_words) & before(last, strictly=False)
        winners = number_in_order(scored.filter(drawn), [F.desc("score"), F.asc_nulls_last("id"), F.asc("turn")])
        ranked = winners.unionByName(scored.filter(~drawn), allowMissingColumns=True)
    return ranked.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
