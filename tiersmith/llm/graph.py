"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersmith.session import cut_lineage


def _smallest(edges: DataFrame) -> DataFrame:
    """Each node ``u`` with the smallest of itself and its partners ``v``."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows ``(node, component)`` for every node that occurs in a link; ``component`` is its smallest node.

    Each round is two grouped minima and two joins on the link table, both with map-side
    combining, and ends in a written table, so a lost executor never replays earlier rounds.
    Nulls, self links and repeated links are ignored; an empty table gives an empty one. The
    number of rounds grows with the logarithm of the longest chain, not with the data.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = cut_lineage(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        small = large.join(_smallest(large), "u")
        rows = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = cut_lineage(rows.filter("u != v").distinct())
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
