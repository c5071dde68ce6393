"""One stream into several tables, each batch stored whole under its number."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tiersmith.session import ship_package

COMMITS = "_commits"
Split = Callable[[DataFrame], Mapping[str, DataFrame]]


def store_batch(batch: DataFrame, number: int, target: str, split: Split) -> None:
    """Write the parts of one batch, each to the batch's own folder, and then the commit with their sizes.

    A batch that is replayed after a failure overwrites what it wrote before and no other batch's
    rows, so every input row ends in exactly one row of one part. The batch is read once.
    """
    batch = batch.persist()
    try:
        sizes = [(number, "", batch.count())]
        for name, part in split(batch).items():
            folder = f"{target}/{name}/batch={number}"
            part.write.mode("overwrite").parquet(folder)
            sizes.append((number, name, batch.sparkSession.read.schema(part.schema).parquet(folder).count()))
        commit = batch.sparkSession.createDataFrame(sizes, "batch bigint, part string, rows bigint")
        commit.coalesce(1).write.mode("overwrite").parquet(f"{target}/{COMMITS}/batch={number}")
    finally:
        batch.unpersist()


def store_stream(stream: DataFrame, target: str, checkpoint: str, split: Split) -> StreamingQuery:
    """Start one query that stores all that is available, split into named parts."""
    ship_package(stream.sparkSession)
    writer = stream.writeStream.foreachBatch(lambda batch, number: store_batch(batch, number, target, split))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_commits(spark: SparkSession, target: str) -> DataFrame:
    """Rows ``(batch, part, rows)`` of the batches stored whole; part '' is the input."""
    return spark.read.schema("part string, rows bigint, batch bigint").parquet(f"{target}/{COMMITS}").select("batch", "part", "rows")


def read_part(spark: SparkSession, target: str, name: str, schema: str) -> DataFrame:
    """Rows of one part from the batches stored whole, with their ``batch``."""
    done = read_commits(spark, target).select("batch").distinct()
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(f"{target}/{name}")
    return rows.join(F.broadcast(done), "batch", "left_semi")  # one number per batch
