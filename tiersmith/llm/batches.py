"""Sizes of the batches in which whole texts go to Python workers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tiersmith.session import ship_package

#: Rows and bytes; a worker also holds a few copies of a batch.
LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def text_batches(rows: DataFrame) -> DataFrame:
    """``rows`` as they are; the session's batches become as small as whole texts need, if they aren't yet.

    The functions that read the batches come from this package, which executors get here.
    """
    ship_package(rows.sparkSession)
    conf = rows.sparkSession.conf
    for key, most in LIMITS.items():
        now = conf.get(key, None)
        size = int(now) if now and now.lstrip("-").isdigit() else 0
        if not 0 < size <= most:
            conf.set(key, str(most))
    return rows
