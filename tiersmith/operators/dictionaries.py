"""Multi-hot and one-hot encoding over dictionaries of any size (FT-1, FT-7, SF-18).

The dictionary is a table ``token, slot`` and the encoding a table of active slots, so neither the number of
distinct tokens nor the width of the encoding meets the driver or one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersmith.operators.aggregates import most_frequent
from tiersmith.session import cut_lineage

INDEX_BITS = 33  # of ``monotonically_increasing_id``: the place in a partition, below the partition's number


def token_slots(df: DataFrame, array_col: str) -> DataFrame:
    """FT-1: ``token, slot`` of the distinct tokens, numbered from 0 in their order; null tokens and arrays have none.

    Tokens are sorted in ranges, each numbered by itself and moved by the sizes of the ranges before it.
    """
    tokens = df.select(F.explode(F.array_distinct(array_col)).alias("token")).filter("token IS NOT NULL").distinct()
    sorted_ = tokens.repartitionByRange("token").sortWithinPartitions("token")
    placed = cut_lineage(sorted_.withColumn("at", F.monotonically_increasing_id()))  # range borders are drawn anew by each run
    part = F.shiftright("at", INDEX_BITS)
    sizes = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row per range
    starts, total = [], 0
    for r in sizes:
        starts.append((r["part"], total))
        total += r["count"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "part bigint, start bigint"))
    index = F.col("at").bitwiseAND((1 << INDEX_BITS) - 1)
    return placed.withColumn("part", part).join(offsets, "part").select("token", (F.col("start") + index).alias("slot"))


def active_slots(df: DataFrame, key: str, array_col: str, slots: DataFrame) -> DataFrame:
    """SF-18: ``key, slot`` once for each dictionary token in a row's array; unknown and null tokens have no slot.

    Rows without a slot are absent. Rows that share a key count as one row with the tokens of all.
    """
    tokens = df.select(key, F.explode(F.array_distinct(array_col)).alias("token"))
    return tokens.join(slots, "token").select(key, "slot").distinct()


def slot_lists(df: DataFrame, key: str, array_col: str, slots: DataFrame, out: str = "slots") -> DataFrame:
    """Every key with its sorted active slots, the sparse form of its 0/1 vector; an empty list if it has none."""
    lists = active_slots(df, key, array_col, slots).groupBy(key).agg(F.sort_array(F.collect_list("slot")).alias(out))
    keys = df.select(F.col(key).alias("_key")).distinct()
    joined = keys.join(lists, F.col("_key").eqNullSafe(F.col(key)), "left")
    return joined.select(F.col("_key").alias(key), F.coalesce(out, F.array().cast("array<bigint>")).alias(out))


def level_slots(df: DataFrame, key: str, col: str) -> DataFrame:
    """FT-7: ``key, level, slot`` of a one-hot encoding, nulls filled with the commonest level (ties: the smallest).

    Levels are numbered from 0 in their order. A table without any level gives no row.
    """
    slots = token_slots(df.select(F.array(col).alias("a")), "a")
    filled = F.coalesce(F.col(col), F.lit(most_frequent(df, col)))
    rows = df.select(F.col(key).alias(key), filled.alias("token"))
    return rows.join(slots, "token").select(key, F.col("token").alias("level"), "slot")
