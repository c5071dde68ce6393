"""The registered queries of the subpackage, with production parameters."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiersmith.llm import (
    byte_pairs,
    ftrl,
    html_text,
    lm,
    mixing,
    near_vectors,
    packing,
    quality,
    resample,
    secrets,
    simhash,
    spelling,
    topk,
    toxicity,
)
from tiersmith.llm.batches import text_batches

# Parameters of the mixture: target weights of sources, languages and topics, and what marks a topic.
SOURCES = {f"src{i}": 1.0 for i in range(20)}
LANGUAGES = {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}
TOPICS = {"contact": 0.025, "licence": 0.03, "table": 0.03, "prose": 0.915}
#: One in so many runs of letters loses a character before words are counted.
MISPRINT = 199
TOPIC_RULES = [("contact", "@"), ("licence", "icense"), ("table", " | ")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mixture() -> dict[str, tuple[Column, dict[str, float]]]:
    topic = mixing.topic_of(F.col("text"), TOPIC_RULES, "prose")
    return {"source": (F.col("source"), SOURCES), "lang": (F.col("lang"), LANGUAGES), "topic": (topic, TOPICS)}


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = {"ids_crc32": F.crc32("token_ids")}
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), derive=crc, keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_texts(_table(spark, sf_dir, "documents"), ~ftrl.held_out("doc_id", 7, 2))
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels.filter(~ftrl.held_out("doc_id", 5, 0)))
    scored = docs.select("doc_id", ftrl.held_out("doc_id", 5, 0).alias("held_out"), quality.quality(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = mixing.with_probabilities(docs, mixture(), mixing.word_count(F.col("text")))
    return found.select(
        "doc_id", "source", "lang", F.col("_mix_topic").alias("topic"),
        mixing.word_count(F.col("text")).alias("n_tokens"),
        F.round("_mix_probability", 6).alias("probability"),
        (mixing.uniform_draw(F.col("doc_id")) < F.col("_mix_probability")).alias("kept"),
    )


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def _spans_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind != "markov")
    return found.select(
        "doc_id", *(_spans_of(k).alias(f"n_{k}") for k in secrets.KINDS),
        F.sha2(secrets.written(base).cast("binary"), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels.filter(~ftrl.held_out("doc_id", 3, 1)))
    scored = docs.select("doc_id", ftrl.held_out("doc_id", 3, 1).alias("held_out"), toxicity.toxicity(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = text_batches(_table(spark, sf_dir, "pages")).select("page_id", "url", html_text.extract_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def misprinted_words(docs: DataFrame) -> DataFrame:
    """Every run of letters in lower case; about one in ``MISPRINT`` of a document's runs lacks a character.

    A null text has no runs; a null id counts as an empty text.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z\u00c0-\u00ff]+)"))).alias("run"),
    )
    run = F.translate("run", ascii_uppercase, ascii_lowercase)
    runs = runs.select(run.alias("run"), F.crc32(F.concat("id", F.lit(":"), run)).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % MISPRINT == 0, short).otherwise(F.col("run")).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(misprinted_words(_table(spark, sf_dir, "documents")))
    return spelling.spelling_variants(words)


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_pairs.decode_texts(byte_pairs.encode_texts(_table(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_context_tree_scores": op2_context_tree_scores,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_mix_sources": op4_mix_sources,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_secret_scan": op6_secret_scan,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_html_text": op10_html_text,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_byte_pairs": op13_byte_pairs,
}
