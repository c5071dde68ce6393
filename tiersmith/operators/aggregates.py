"""Frequency, arg-max, spread and weight aggregates (AG-1..5, AG-7, AG-10, AG-14, AG-16, TK-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiersmith.operators.quantiles import grouped_quantiles


def value_counts(df: DataFrame, array_col: str, value: str = "value", n: str = "n") -> DataFrame:
    """Frequency of each element of an array column."""
    return df.select(F.explode(array_col).alias(value)).groupBy(value).agg(F.count(F.lit(1)).alias(n))


def top_values(df: DataFrame, array_col: str, limit: int, value: str = "value", n: str = "n") -> DataFrame:
    """AG-2: most frequent elements, alphabetical on ties."""
    counted = value_counts(df.filter(F.col(array_col).isNotNull()), array_col, value, n)
    return counted.filter(F.col(value).isNotNull()).orderBy(F.desc(n), value).limit(limit)


def most_frequent(df: DataFrame, col: str):
    """AG-7: commonest non-null value, smallest on ties; None for an all-null column."""
    row = df.filter(F.col(col).isNotNull()).groupBy(col).count().orderBy(F.desc("count"), col).first()
    return None if row is None else row[0]


def group_means(df: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """AG-3: mean per group, highest first."""
    return df.groupBy(*groups).agg(F.avg(value).alias(out)).orderBy(F.desc(out), *groups)


def best_row(df: DataFrame, group: str, value: str, carried: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """AG-4: the row with the largest value per group; ``ties`` columns decide, smallest first.

    ``min_by`` keeps one row per group and task, so a hot group is reduced before the shuffle.
    """
    rank = F.struct((-F.col(value)).alias("v"), *[F.col(t) for t in ties])
    kept = F.struct(*[F.col(c) for c in dict.fromkeys([value, *carried])])
    picked = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.min_by(kept, rank).alias("r"))
    return picked.select(group, "r.*")


def first_per_class(df: DataFrame, label: str, key: str, carried: Sequence[str]) -> DataFrame:
    """TK-3: the row with the smallest key of every class."""
    kept = F.struct(*[F.col(c) for c in dict.fromkeys([key, *carried])])
    return df.groupBy(label).agg(F.min_by(kept, F.col(key)).alias("r")).select(label, "r.*")


def mean_and_spread(df: DataFrame, groups: Sequence[str], value: str, prefix: str) -> DataFrame:
    """AG-5: mean and population standard deviation."""
    return df.groupBy(*groups).agg(
        F.avg(value).alias(f"{prefix}_mean"), F.stddev_pop(value).alias(f"{prefix}_std")
    )


def five_numbers(df: DataFrame, group: str, value: str) -> DataFrame:
    """AG-16: minimum, quartiles and maximum per group."""
    q = grouped_quantiles(df, group, value, [0.0, 0.25, 0.5, 0.75, 1.0], "q")
    names = ["q0", "q25", "q50", "q75", "q100"]
    return q.select(group, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def drop_report(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """AG-10: rows each rule removes when rules run in order, from a single pass.

    A rule is a keep condition; null counts as not kept.
    """
    alive = F.lit(True)
    aggs = [F.count(F.lit(1)).alias("rows_in")]
    for name, keep in rules:
        keep = F.coalesce(keep, F.lit(False))
        aggs.append(F.count_if(alive & ~keep).alias(name))
        alive = alive & keep
    wide = df.agg(*aggs, F.count_if(alive).alias("rows_out"))
    names = ["rows_in", *[n for n, _ in rules], "rows_out"]
    entries = F.array(*[F.struct(F.lit(n).alias("step"), F.col(n).alias("row_count")) for n in names])
    return wide.select(F.explode(entries).alias("e")).select("e.*")


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """AG-14: one row per class with n / (k * n_c)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everyone = Window.partitionBy()  # k class rows
    return counts.select(
        label, "n", (F.sum("n").over(everyone) / (F.count(F.lit(1)).over(everyone) * F.col("n"))).alias(out)
    )


def balanced_weight_expr(counts: dict, label: str) -> Column:
    """AG-14 as a row-local lookup once class counts are known."""
    size, k = sum(counts.values()), len(counts)
    pairs = [F.lit(x) for c, n in counts.items() for x in (float(c), size / (k * n))]
    return F.create_map(*pairs)[F.col(label).cast("double")]


def top_by(df: DataFrame, value: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """TK-2, TK-4, TK-5: global top-n."""
    return df.orderBy(F.desc(value), *ties).limit(n)
