"""Table sources and sinks (IO-1, IO-2, IO-5, IO-6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiersmith.functions.nested import parse_list


def read_tolerant_csv(spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool = True) -> DataFrame:
    """IO-1: all columns as text; rows with too many fields skipped, short rows padded with null.

    The reader flags rows with another number of fields than columns, and keeps their text;
    only in those the separators outside of quotes are counted. A quoted file that spans
    lines is read by one task, so land large sources as many files (gzip, not zip).
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_malformed"]])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_malformed")
        .option("columnPruning", False)  # a pruned row does not show its number of fields
        .csv(path)
    )
    bare = F.regexp_replace("_malformed", r'"(?:[^"]|"")*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    # The reader refuses plans that need the flag alone, so a count has to touch a column.
    touched = F.length(F.coalesce(F.col(columns[0]), F.lit(""))) >= 0
    return raw.filter(F.col("_malformed").isNull() | ((fields <= len(columns)) & touched)).select(*columns)


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a scan with fewer splits than cores, such as one small file of long texts.

    A scan of many splits comes back as it is, so a large table is never shuffled for this.
    Only for plain scans: counting the splits of a plan with shuffles would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_clean_table(
    spark: SparkSession, path: str, list_columns: Sequence[str] = (), schema: str | None = None
) -> DataFrame:
    """IO-2: Parquet, or CSV when a schema is given, with its list columns parsed back to arrays."""
    if schema is None:
        return spark.read.parquet(path)
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape="\\")
    return df.withColumns({c: parse_list(F.col(c)) for c in list_columns if c in df.columns})


def write_clean_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """IO-5: Parquet, or CSV with arrays as JSON text."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
        return
    arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    flat = df.withColumns({c: F.to_json(c) for c in arrays})
    flat.write.mode("overwrite").csv(path, header=True, quote='"', escape="\\")


def write_grid_results(df: DataFrame, path: str) -> None:
    """IO-6."""
    df.write.mode("overwrite").csv(path, header=True)


def read_grid_results(spark: SparkSession, path: str) -> DataFrame:
    schema = "model string, max_tfidf_features int, pls_da_n_components int, qwk_mean double, qwk_std double"
    return spark.read.schema(schema).csv(path, header=True)
