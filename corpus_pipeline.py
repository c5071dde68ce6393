"""A training corpus from raw documents: filter, deduplicate, mask, mix and pack.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; ``run``
writes every stage's rows to the shared folder and reads them back, so a lost executor never
replays an earlier stage. Every stage returns an empty table for an empty one.
"""

from __future__ import annotations

import pathlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from tiersmith.llm import ftrl, mixing, packing, quality, secrets, simhash  # noqa: E402
from tiersmith.llm.queries import mixture  # noqa: E402
from tiersmith.session import cut_lineage  # noqa: E402


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among ``docs``.

    Rows with a null id are scored like any other; empty and null texts get the prior.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~ftrl.held_out("doc_id", 5, 0))
    model = quality.fit_quality(docs, labels)
    return docs.filter(quality.quality(model) >= quality.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by SimHash; null ids are kept."""
    return simhash.keep_one_per_group(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark and ``n_chars`` counted anew. Null texts stay as they are."""
    masked = docs.withColumn("text", secrets.mask_secrets(docs))
    chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return masked.withColumn("n_chars", chars)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target shares of sources, languages and topics."""
    return mixing.sample_mixture(docs, mixture(), mixing.word_count(F.col("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as pieces of token ids, each with its sequence and its place there."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier nor tokenising; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
