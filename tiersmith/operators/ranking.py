"""Exact per-class ordering, sampling, splits and folds (W-3, RS-1, RS-5, RS-6).

Rows are ordered inside a class by ``md5(key|seed)``, so a sample depends only on the
key and the seed, never on partitioning. A class may hold most of the table, so no
step sorts a class in one task:

* a cut (rank n of a class) is located from counts per hash prefix; only counts reach the
  driver, and samples, splits and folds are then row-local;
* a full rank sorts inside (class, hash prefix) and adds the count of earlier prefixes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_DIGITS = 3
HASH_DIGITS = 32
RANKED_ROWS = 50_000  # rows that a full rank sorts together, about
LAST_HASH = "g"  # sorts after every hex digit


def order_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def require_unique(df: DataFrame, key: str) -> None:
    """Raise if a key stands on several rows, where a sample or a join by key would mix them."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} = {twice[0][0]!r} stands on {twice[0][1]} rows; give each row a key of its own")


def class_counts(df: DataFrame, label: str) -> dict:
    """AG-1 on the driver: one row per class; unlabelled rows are not a class."""
    return {r[0]: r[1] for r in df.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}


def class_cuts(
    df: DataFrame, label: str, key: str, targets: Mapping, seed: int, counts: Mapping
) -> dict:
    """Per class, the hash at each wanted rank: ``{class: [ranks]}`` to ``{class: [hashes]}``.

    Keys must be unique: rows of one key can't be told apart and end up on one side. Only the
    key and the label are read. Each pass counts rows per hash prefix inside the one prefix that
    holds a wanted rank, three digits more every time, until the rank is the last of a prefix:
    after two passes for millions of rows, three for billions.
    """
    hashed = df.select(F.col(label).alias("c"), order_hash(key, seed).alias("h"))
    cuts = {c: [None] * len(ranks) for c, ranks in targets.items()}
    open_ = {}  # (class, position) -> prefix, rank wanted inside it
    for c, ranks in targets.items():
        for i, n in enumerate(ranks):
            if n <= 0:
                cuts[c][i] = ""
            elif n >= counts.get(c, 0):
                cuts[c][i] = LAST_HASH
            else:
                open_[c, i] = ("", n)
    digits = 0
    while open_:
        digits = min(digits + PREFIX_DIGITS, HASH_DIGITS)
        found: dict = {}
        counted = hashed.filter(_in_prefix(open_)).groupBy("c", F.substring("h", 1, digits).alias("p")).count()
        for r in counted.orderBy("c", "p").collect():
            found.setdefault(r["c"], []).append((r["p"], r["count"]))
        for (c, i), (prefix, rank) in list(open_.items()):
            for p, n in found[c]:
                if not p.startswith(prefix):
                    continue
                if rank <= n:
                    open_[c, i] = (p, rank)
                    if rank == n or digits == HASH_DIGITS:
                        cuts[c][i] = p + LAST_HASH
                        del open_[c, i]
                    break
                rank -= n
    return cuts


def _in_prefix(open_: Mapping) -> Column:
    """Set membership of (class, hash prefix), so the hash is computed once per prefix length."""
    by_length: dict[int, set] = {}
    for (c, _), (prefix, _) in open_.items():
        by_length.setdefault(len(prefix), set()).add(f"{_text(c)}|{prefix}")
    hit = F.lit(False)
    for n, wanted in by_length.items():
        cell = F.concat_ws("|", F.col("c").cast("string"), F.substring("h", 1, n))
        hit = hit | cell.isin(sorted(wanted))
    return hit


def _text(value) -> str:
    """A class value as Spark's string cast writes it."""
    return str(value).lower() if isinstance(value, bool) else str(value)


def cuts_passed(label: str, h: Column, cuts: Mapping, otherwise: int = 0) -> Column:
    """How many of its class's cuts a row with hash ``h`` lies beyond; ``otherwise`` without cuts."""
    out = F.lit(otherwise)
    for c, hashes in cuts.items():
        beyond = F.lit(0)
        for cut in hashes:
            beyond = beyond + (h > F.lit(cut)).cast("int")
        out = F.when(F.col(label) == F.lit(c), beyond).otherwise(out)
    return out


def take_per_class(
    df: DataFrame, label: str, key: str, targets: Mapping, seed: int = 1, counts: Mapping | None = None
) -> DataFrame:
    """Exactly ``targets[c]`` rows of each listed class, every row of the others."""
    counts = class_counts(df, label) if counts is None else counts
    cuts = class_cuts(df, label, key, {c: [n] for c, n in targets.items()}, seed, counts)
    return df.filter(cuts_passed(label, order_hash(key, seed), cuts) == 0)


def proportional_allocation(counts: Mapping, n: int) -> dict:
    """Split ``n`` draws over classes in proportion; largest remainders get the spare ones."""
    size = sum(counts.values())
    exact = {c: n * m / size for c, m in counts.items()}
    out = {c: int(x) for c, x in exact.items()}
    order = sorted(counts, key=lambda c: (-(exact[c] - out[c]), c))
    for c in order[: n - sum(out.values())]:
        out[c] += 1
    return out


def mark_split(
    df: DataFrame, label: str, key: str, test_fraction: float = 0.2, seed: int = 1, col: str = "is_test"
) -> DataFrame:
    """RS-5: stratified split as a boolean column; the test part has ceil(fraction * n) rows."""
    counts = class_counts(df, label)
    size = sum(counts.values())
    n_test = -int(-(test_fraction * size) // 1)
    targets = proportional_allocation(counts, n_test)
    cuts = class_cuts(df, label, key, {c: [n] for c, n in targets.items()}, seed, counts)
    return df.withColumn(col, cuts_passed(label, order_hash(key, seed), cuts, otherwise=1) == 0)


def stratified_sample(df: DataFrame, label: str, key: str, fraction: float, seed: int = 1) -> DataFrame:
    """RS-5: ``int(fraction * n)`` rows with class proportions kept."""
    counts = class_counts(df, label)
    targets = proportional_allocation(counts, int(fraction * sum(counts.values())))
    return take_per_class(df, label, key, targets, seed, counts)


def class_rank(
    df: DataFrame, label: str, key: str, seed: int = 1, col: str = "class_rank", digits: int | None = None
) -> DataFrame:
    """W-3: 1-based position of every row inside its class, in hash order.

    The class is sorted in parts of one hash prefix; its length follows from the largest class.
    """
    if digits is None:
        largest = df.groupBy(label).count().agg(F.max("count")).first()[0] or 1
        digits = max(1, math.ceil(math.log(max(largest / RANKED_ROWS, 1), 16)))
    hashed = df.withColumn("_h", order_hash(key, seed)).withColumn("_p", F.substring("_h", 1, digits))
    starts = (
        hashed.groupBy(F.col(label).alias("_c"), F.col("_p").alias("_q"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_start",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy("_c").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(label, "_p").orderBy("_h", key))
    return (
        hashed.withColumn("_local", local)
        .join(starts, F.col(label).eqNullSafe(F.col("_c")) & (F.col("_p") == F.col("_q")))
        .withColumn(col, (F.col("_local") + F.col("_start")).cast("bigint"))
        .drop("_h", "_p", "_local", "_c", "_q", "_start")
    )


def assign_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 1, col: str = "fold") -> DataFrame:
    """RS-6: stratified folds 0..k-1; class sizes differ by at most one between folds.

    Fold f holds the f-th of k equal stretches of its class in hash order, so once the cuts
    are known a row's fold follows from its own key and no row moves.
    """
    counts = class_counts(df, label)
    ranks = {c: [i * n // k for i in range(1, k)] for c, n in counts.items()}
    cuts = class_cuts(df, label, key, ranks, seed, counts)
    hashed = df.withColumn("_h", order_hash(key, seed))  # its own projection: one hash per row
    return hashed.withColumn(col, cuts_passed(label, F.col("_h"), cuts)).drop("_h")
