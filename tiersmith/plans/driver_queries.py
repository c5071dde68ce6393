"""Every operator as a query over the driver tables; each reads its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiersmith.functions import nested, text, vectors
from tiersmith.operators import (
    aggregates,
    calibrate,
    clean,
    correlation,
    dictionaries,
    encoders,
    explain,
    metrics,
    models,
    neighbours,
    pipeline,
    ranking,
    sampling,
    search,
    stats,
)
from tiersmith.operators.pls import (
    CorrelationPruner,
    PlsDa,
    attach_embeddings,
    fit_pls,
    project,
)
from tiersmith.plans import catalogue
from tiersmith.plans.cleaning import clean_catalogue
from tiersmith.plans.scoring import score
from tiersmith.plans.training import feature_stages
from tiersmith.session import cut_lineage, intermediates, ship_package
from tiersmith.sources.records import LOG_SCHEMA, load_bundle, read_records, save_bundle
from tiersmith.sources.tables import spread
from tiersmith.streaming.batches import read_commits, read_part, store_stream

PRIORITY_TIERS = {"5-LOW": 0, "4-NOT SPECIFIED": 1, "3-MEDIUM": 2, "2-HIGH": 3, "1-URGENT": 4}
STOP_WORDS = ["the", "and", "of", "to", "in", "on", "at", "is", "it", "un", "la", "le", "el", "en", "der", "ein"]
ACCENTED = "À-ÿ"
WORD_FLAGS = {"has_tion": "tion", "has_eaux": "eaux|oui", "has_thth": "th[aeio]*th", "has_digit": "[0-9]{3}"}
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose per-row work is heavy."""
    return spread(table(spark, sf_dir, name))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def tier_summary(spark, sf):
    """J-1, J-2, PF-3, AG-3."""
    joined = clean.suffix_join(
        table(spark, sf, "orders"), table(spark, sf, "customer"), "o_custkey", "c_custkey", ("_o", "_c")
    )
    tiers = joined.transform(clean.bin_target("o_orderpriority", PRIORITY_TIERS, "tier"))
    return tiers.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("o_totalprice"), 4).alias("avg_price"),
        F.round(F.avg("c_acctbal"), 4).alias("avg_balance"),
    )


def clean_html(spark, sf):
    """SF-1..3, PF-5."""
    df = texts(spark, sf, "pages").transform(clean.clean_texts(["html"])).transform(clean.require_text(["html"]))
    return df.select("page_id", F.col("html").alias("text"), _big(F.length("html")).alias("n_chars"))


def script_filter(spark, sf):
    """PF-6 on text and on a token list."""
    docs = texts(spark, sf, "documents").withColumn("tokens", F.split("text", " "))
    return docs.transform(clean.drop_scripts(["text"], ["tokens"], ACCENTED)).select("doc_id", "lang")


def quality_report(spark, sf):
    """AG-10."""
    return aggregates.drop_report(
        texts(spark, sf, "documents"),
        [
            ("language", F.col("lang") != "de"),
            ("script", ~text.has_script(F.col("text"), ACCENTED)),
            ("length", F.col("n_chars") >= 100),
        ],
    )


def keyword_flags(spark, sf):
    """SF-6, SF-7."""
    raw = text.joined_lower(F.col("source"), F.col("text"))
    flags = text.keyword_flags(raw, WORD_FLAGS)
    return texts(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in flags.items()])


def quantity_extract(spark, sf):
    """SF-8 on requirement text rendered from part sizes."""
    size = F.col("p_size").cast("string")
    spec = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("<b>Memory:</b> "), size, F.lit("00 MB RAM")))
        .when(F.col("p_type") == "STANDARD", F.concat(size, F.lit(",5 gb ram, 2 GB VRAM")))
        .when(F.col("p_type") == "PROMO", F.concat(F.lit("memory "), size, F.lit("000 KB")))
        .otherwise(F.concat(size, F.lit(" GB storage space")))
    )
    return table(spark, sf, "part").select("p_partkey", r6(text.quantity(text.strip_html(spec))).alias("ram_gb"))


def json_lookup(spark, sf):
    """SF-9, SF-12."""
    m = nested.parse_dict(F.col("props"))
    return table(spark, sf, "events").select(
        "event_id", nested.int_field(m, "k").alias("k"), nested.lookup(m, "absent", "none").alias("absent")
    )


def literal_lists(spark, sf):
    """SF-10, SF-11, SF-13, SF-14 on list literals rendered from part columns."""
    name = F.col("p_name")
    dicts = F.concat(F.lit("[{'id': "), "p_size", F.lit(", 'description': '"), name, F.lit("'}, {'flag': True}]"))
    listed = F.concat(F.lit("['"), name, F.lit(" ', '"), "p_brand", F.lit("']"))
    commas = F.concat_ws(", ", name, "p_type", F.lit(""))
    return table(spark, sf, "part").select(
        "p_partkey",
        F.array_join(nested.descriptions(dicts), "|").alias("described"),
        F.array_join(nested.simple_list(listed), "|").alias("listed"),
        F.array_join(nested.simple_list(commas), "|").alias("commas"),
        _big(nested.list_length(listed)).alias("n_listed"),
        _big(F.size(text.comma_tokens(commas))).alias("n_commas"),
    )


def coerce_impute(spark, sf):
    """PF-8, PF-9, SF-22."""
    k = F.col("k").cast("string")
    raw = (
        F.when(F.col("event_type") == "error", F.concat(k, F.lit("+")))
        .when(F.col("event_type") == "view", F.concat(F.lit(" "), k, F.lit(".9")))
        .when(F.col("event_type") == "click", F.concat(F.lit("-"), k))
        .otherwise(k)
    )
    df = table(spark, sf, "events").withColumn("k", nested.int_field(nested.parse_dict(F.col("props")), "k"))
    return df.withColumn("raw", raw).select(
        "event_id", clean.int_or_zero(F.col("raw")).alias("number"), clean.unit_flag(F.col("raw")).alias("flag")
    )


def presence_flags(spark, sf):
    """PF-4."""
    df = table(spark, sf, "events").withColumn("notice", F.nullif(F.col("event_type"), F.lit("error")))
    return df.transform(clean.presence_flags({"notice": "has_notice"})).select("event_id", "has_notice")


def date_parts_filter(spark, sf):
    """SF-15, SF-16, PF-7 on dates rendered in mixed layouts."""
    d, status = F.col("o_orderdate"), F.col("o_orderpriority")
    shown = (
        F.when(status == "1-URGENT", F.date_format(d, "d MMM, yyyy"))
        .when(status == "2-HIGH", F.date_format(d, "MMM d, yyyy"))
        .when(status == "3-MEDIUM", F.concat(F.lit("{'date': '"), F.date_format(d, "MMM yyyy"), F.lit("'}")))
        .when(status == "5-LOW", F.date_format(d, "yyyy-MM-dd"))
        .otherwise(F.lit("Coming soon"))
    )
    df = table(spark, sf, "orders").withColumn("released", shown)
    df = df.transform(clean.release_filter("released", "1998-06-15", "year", "month"))
    return df.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


def price_rules(spark, sf):
    """PF-10."""
    df = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("initialprice"),
        (F.col("l_discount") == 0).alias("is_free"),
        F.col("l_discount").alias("discount"),
    )
    return df.transform(clean.set_price()).select(
        "l_orderkey", "l_linenumber", "l_partkey", r6("price").alias("price"), r6("discount").alias("discount")
    )


def review_ratio(spark, sf):
    """PF-11 per user."""
    per_user = table(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("positive"),
        F.count_if(F.col("event_type") == "error").alias("negative"),
    )
    return per_user.transform(clean.set_ratio("positive", "negative", "ratio")).select(
        "user_id", r6("ratio").alias("ratio")
    )


def _catalogue_sources(spark, sf):
    """Raw store and usage tables in catalogue layout, rendered from documents, labels and parts."""
    docs = texts(spark, sf, "documents")
    n = F.col("n_chars")
    store = docs.select(
        F.when(F.col("lang") == "es", F.lit("dlc")).otherwise(F.lit("game")).alias("type"),
        F.concat_ws(" ", "source", "lang").alias("name"),
        F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("steam_appid"),
        F.when(n % 7 == 0, "True").otherwise("False").alias("is_free"),
        F.when(n % 3 == 0, "full").alias("controller_support"),
        F.when(n % 2 == 0, "[10, 20]").alias("dlc"),
        F.col("text").alias("detailed_description"),
        F.concat(F.lit("<p>"), "source", F.lit("</p>")).alias("short_description"),
        F.concat(F.lit("{'minimum': 'Memory: "), n, F.lit(" MB RAM, GTX 560'}")).alias("pc_requirements"),
        F.concat(F.lit("{'windows': True, 'mac': "), F.when(n % 5 == 0, "True").otherwise("False"), F.lit("}")).alias(
            "platforms"
        ),
        F.lit("[{'id': 1, 'description': 'Single player'}]").alias("categories"),
        F.concat(F.lit("{'coming_soon': False, 'date': '"), n % 28 + 1, F.lit(" Nov, 2019'}")).alias("release_date"),
    )
    usage = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("appid"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") < 15, "0 .. 20,000")
        .when(F.col("p_size") < 30, "50,000 .. 100,000")
        .when(F.col("p_size") < 45, "1,000,000 .. 2,000,000")
        .alias("owners"),
        F.col("p_size").cast("string").alias("positive"),
        F.length("p_name").cast("string").alias("negative"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").cast("string").alias("initialprice"),
        F.lit("15").alias("discount"),
        F.concat(F.lit("{'"), "p_brand", F.lit("': 3, '"), "p_type", F.lit("': 9}")).alias("tags"),
        F.regexp_replace("p_name", " ", ", ").alias("languages"),
    )
    return store, usage


def catalogue_clean(spark, sf):
    """The whole cleaning job: PF-1..13, J-1, SF-1..17, TK-1."""
    out = clean_catalogue(*_catalogue_sources(spark, sf), "2019-11-20")
    return out.select(
        "steam_appid",
        "name",
        _big(F.length("detailed_description")).alias("n_text"),
        "short_description",
        F.array_join("tags", "|").alias("tags"),
        F.array_join("categories", "|").alias("categories"),
        "num_languages_supported",
        "num_dlc",
        "platform_mac",
        "is_controller_supported",
        "req_dedicated_gpu",
        r6("min_ram_gb").alias("min_ram_gb"),
        r6("rec_ram_gb").alias("rec_ram_gb"),
        r6("price").alias("price"),
        r6("discount").alias("discount"),
        r6("review_ratio").alias("review_ratio"),
        "release_month",
        "target_owners",
    )


def top_tokens(spark, sf):
    """AG-2, TK-2."""
    df = texts(spark, sf, "documents").select(F.split("text", " ").alias("tokens"))
    return aggregates.top_values(df, "tokens", 20, "token", "n")


def multi_hot(spark, sf):
    """FT-1, SF-18: active vocabulary slots per row."""
    df = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("tokens"))
    hot = encoders.multi_hot(df, "tokens", encoders.vocabulary(df, "tokens"), "hot")
    active = F.filter(
        F.transform(vector_to_array("hot"), lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull()
    )
    return hot.select("p_partkey", F.array_join(active.cast("array<string>"), ",").alias("slots"))


def word_slots(spark, sf):
    """FT-1, SF-18: active slots of whole documents over the dictionary of all their words."""
    df = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("words"))
    found = dictionaries.active_slots(df, "doc_id", "words", dictionaries.token_slots(df, "words"))
    return found.select(_big("doc_id").alias("doc_id"), "slot")


def top_creator_flags(spark, sf):
    """FT-2: rows hit by any of the top five brands."""
    df = table(spark, sf, "part").withColumn("makers", F.array("p_brand", "p_type"))
    top = [r["value"] for r in aggregates.top_values(df, "makers", 5).collect()]
    flags = encoders.member_flags("makers", top, "dev")
    total = F.lit(0)
    for c in flags.values():
        total = total + c
    return df.select("p_partkey", total.alias("hits"))


def top_map_keys(spark, sf):
    """TK-1: each user's three commonest event types."""
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    entries = F.sort_array(F.collect_list(F.struct("event_type", "n")))  # one entry per event type
    per_user = counts.groupBy("user_id").agg(F.map_from_entries(entries).alias("m"))
    return per_user.select("user_id", F.array_join(nested.top_keys(F.col("m"), 3), "|").alias("top"))


def tfidf_terms(spark, sf):
    """FT-3: fitted terms and idf over whole documents."""
    vocab, idf = encoders.fit_text(texts(spark, sf, "documents"), "text", 30, STOP_WORDS)
    rows = list(zip(vocab, idf, strict=True))
    return spark.createDataFrame(rows, "term string, idf double").select("term", r6("idf").alias("idf"))


def tfidf_vectors(spark, sf):
    """FT-3: unit-length term weights per document."""
    docs = texts(spark, sf, "documents").select("doc_id", "text")
    vocab, idf = encoders.fit_text(docs, "text", 15, STOP_WORDS)
    df = encoders.terms(docs, "text", "t", STOP_WORDS)
    out = encoders.tfidf(df.select("doc_id", "t"), "t", vocab, idf, "v").drop("t")
    long = out.select("doc_id", F.posexplode(vector_to_array("v")).alias("slot", "weight")).filter("weight <> 0")
    return long.select("doc_id", "slot", r6("weight").alias("weight"))


def robust_scale(spark, sf):
    """FT-6, AG-6."""
    df = table(spark, sf, "lineitem")
    stats_ = encoders.robust_stats(df, LINE_NUMBERS)
    return df.select(
        "l_orderkey", "l_linenumber", *[r6(encoders.robust_scaled(c, stats_[c])).alias(c) for c in LINE_NUMBERS]
    )


def inverse_scale(spark, sf):
    """FT-12, EX-3: scaled and brought back."""
    df = table(spark, sf, "lineitem")
    stats_ = encoders.robust_stats(df, LINE_NUMBERS)
    scaled = {c: encoders.robust_scaled(c, stats_[c]) for c in LINE_NUMBERS}
    back = [F.round(encoders.unscaled(x, stats_[c]), 4).alias(c) for c, x in scaled.items()]
    return df.select("l_orderkey", "l_linenumber", *back, *[r6(x).alias(f"{c}_scaled") for c, x in scaled.items()])


MOST_LEVELS = 100  # flag columns


def mode_impute_onehot(spark, sf):
    """FT-7, AG-7."""
    hidden = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    df = table(spark, sf, "orders").withColumn("priority", hidden)
    fill = aggregates.most_frequent(df, "priority")
    levels = df.select("priority").filter("priority IS NOT NULL").distinct().orderBy("priority")
    found = levels.limit(MOST_LEVELS + 1).collect()
    if len(found) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels, too many for a flag column each")
    flags = encoders.one_hot_flags("priority", fill, [r["priority"] for r in found])
    return df.select("o_orderkey", *[c.alias(f"level_{i}") for i, c in enumerate(flags.values())])


def price_level_slots(spark, sf):
    """FT-7, AG-7: every distinct total price as a level; nulls take the commonest."""
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("double"))
    df = table(spark, sf, "orders").withColumn("price", price)
    found = dictionaries.level_slots(df, "o_orderkey", "price")
    return found.select("o_orderkey", F.round("level", 6).alias("level"), "slot")


def _line_vector(spark, sf):
    cols = [*LINE_NUMBERS, "gross", "net", "flag"]
    df = texts(spark, sf, "lineitem").select(
        *LINE_NUMBERS,
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("gross"),
        (-F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        F.lit(1.0).alias("flag"),
    )
    return cols, VectorAssembler(inputCols=cols, outputCol="v").transform(df).select("v")


def corr_matrix(spark, sf):
    """AG-9."""
    cols, df = _line_vector(spark, sf)
    names = F.array(*map(F.lit, cols))
    r = F.when(~F.isnan("r"), r6(F.abs("r")))  # none with a constant
    found = correlation.correlation_pairs(df, "v")
    return found.select(names[F.col("earlier")].alias("a"), names[F.col("later")].alias("b"), r.alias("r"))


def corr_prune(spark, sf):
    """FT-10."""
    cols, df = _line_vector(spark, sf)
    gone = {r["slot"] for r in correlation.correlated_slots(df, "v", 0.95).collect()}
    rows = [(c, int(i in gone)) for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "name string, dropped int")


#: First letter by length: slots of the wide table, and the slots of a column block.
LETTERS, LENGTHS, WIDE_BLOCK = 26, 24, 128


def _word_shapes(spark, sf) -> DataFrame:
    """Per document, how many of its words have each first letter and length: one wide vector."""
    words = table(spark, sf, "documents").select(
        "doc_id", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), " ")).alias("w")
    )
    words = words.filter(F.ascii("w").between(97, 96 + LETTERS))
    slot = (F.ascii("w") - 97) * LENGTHS + F.least(F.length("w"), F.lit(LENGTHS)) - 1
    cells = words.groupBy("doc_id", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    held = cells.groupBy("doc_id").agg(F.collect_list(F.struct("slot", "n")).alias("c"))  # at most one entry per slot

    @F.arrow_udf("array<double>")
    def dense(at: pa.Array, n: pa.Array) -> pa.Array:
        out = np.zeros((len(at), LETTERS * LENGTHS))
        rows = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
        out[rows, at.flatten().to_numpy()] = n.flatten().to_numpy()
        return neighbours._lists(list(out), pa.float64())

    return cut_lineage(held.select(array_to_vector(dense("c.slot", "c.n")).alias("v")))


def wide_corr_prune(spark, sf):
    """AG-9, FT-10 over several column blocks: slots that an earlier one makes redundant, and the first such slot."""
    return correlation.correlated_slots(_word_shapes(spark, sf), "v", 0.95, WIDE_BLOCK)


def class_weights(spark, sf):
    """AG-1, AG-14."""
    out = aggregates.balanced_weights(table(spark, sf, "labels"), "quality")
    return out.select("quality", "n", r6("weight").alias("weight"))


def undersample(spark, sf):
    """RS-1, W-3: the commonest quality class shrinks to a quarter."""
    df = table(spark, sf, "labels")
    counts = ranking.class_counts(df, "quality")
    targets = sampling.undersample_target(counts, majority=1, floor=0)
    return ranking.take_per_class(df, "quality", "doc_id", targets, 7, counts).select("doc_id", "quality")


def oversample_plan(spark, sf):
    """RS-2: target size of the rare class."""
    df = table(spark, sf, "labels")
    counts = ranking.class_counts(df, "quality")
    targets = sampling.oversample_target(counts, rare=0, anchor=1)
    grown = F.coalesce(clean.map_value(F.col("quality"), targets or {-1: -1}).cast("bigint"), F.col("n"))
    return df.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).select("quality", "n", grown.alias("target"))


def strat_split(spark, sf):
    """RS-5."""
    df = ranking.mark_split(table(spark, sf, "events"), "event_type", "event_id", 0.2, 3)
    return df.select("event_id", F.col("is_test").cast("int").alias("is_test"))


def strat_sample(spark, sf):
    """RS-5: stratified fraction."""
    df = ranking.stratified_sample(table(spark, sf, "events"), "event_type", "event_id", 0.2, 5)
    return df.select("event_id", "event_type")


def kfold(spark, sf):
    """RS-6."""
    df = ranking.assign_folds(table(spark, sf, "events"), "event_type", "event_id", 5, 1)
    return df.select("event_id", "fold")


def class_rank(spark, sf):
    """W-3: exact position of every row inside its class."""
    return ranking.class_rank(table(spark, sf, "events"), "event_type", "event_id", 2).select("event_id", "class_rank")


def _rule_predictions(spark, sf):
    """Three ordinal classes from the labels, predicted from document length."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    rule = F.when(F.col("n_chars") < 300, 0).when(F.col("n_chars") < 900, 1).otherwise(2)
    joined = table(spark, sf, "labels").join(docs, "doc_id")
    return joined.select("lang", (F.col("quality") + F.col("toxic")).alias("actual"), rule.alias("predicted"))


def confusion(spark, sf):
    """AG-11."""
    return metrics.confusion(_rule_predictions(spark, sf), "actual", "predicted", [0, 1, 2])


def macro_metrics(spark, sf):
    """AG-12 per language."""
    out = metrics.macro_metrics(_rule_predictions(spark, sf), "actual", "predicted", ["lang"])
    return out.select("lang", *[r6(m).alias(m) for m in metrics.METRICS])


def class_report(spark, sf):
    """AG-13."""
    out = metrics.class_report(_rule_predictions(spark, sf), "actual", "predicted")
    return out.select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


def group_means(spark, sf):
    """AG-3."""
    out = aggregates.group_means(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "m")
    return out.select("l_returnflag", "l_linestatus", r6("m").alias("mean_quantity"))


def group_mean_std(spark, sf):
    """AG-5."""
    out = aggregates.mean_and_spread(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "q")
    return out.select("l_returnflag", r6("q_mean").alias("q_mean"), r6("q_std").alias("q_std"))


def argmax_per_group(spark, sf):
    """AG-4."""
    carried = ["l_orderkey", "l_linenumber"]
    return aggregates.best_row(
        table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", carried, ["l_orderkey", "l_linenumber"]
    )


def first_per_class(spark, sf):
    """TK-3."""
    return aggregates.first_per_class(table(spark, sf, "events"), "event_type", "event_id", ["user_id"])


def five_number(spark, sf):
    """AG-16."""
    out = aggregates.five_numbers(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")
    return out.select("l_returnflag", *[r6(c).alias(c) for c in ("q0", "q25", "q50", "q75", "q100")])


def top_by_value(spark, sf):
    """TK-4."""
    df = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 4).alias("total"))
    return aggregates.top_by(df, "total", 20, ["l_partkey"])


def ranked_models(spark, sf):
    """TK-5, ST-4 ordering: event types ranked by mean value."""
    df = table(spark, sf, "events").select(F.col("event_type").alias("model"), F.col("value").alias("score"))
    out = stats.ranked_models(df, "score").limit(1)
    return out.select("model", r6("mean_score").alias("mean_score"))


def friedman(spark, sf):
    """ST-2, W-1: event types over days, one test per quarter of the day."""
    cells = (
        table(spark, sf, "events")
        .groupBy(
            _big(F.floor(F.hour("ts") / 6)).alias("part"), F.to_date("ts").alias("day"), "event_type"
        )
        .agg(r6(F.avg("value")).alias("score"))
    )
    out = stats.friedman(cells, ["part"], "day", "event_type", "score", 5)
    return out.select("part", "blocks", r6("statistic").alias("statistic"), r6("p_value").alias("p_value"))


def wilcoxon(spark, sf):
    """ST-3, W-2: purchases against every other type over hours."""
    cells = (
        table(spark, sf, "events")
        .groupBy(F.date_trunc("hour", "ts").alias("block"), "event_type")
        .agg(r6(F.avg("value")).alias("score"))
    )
    best = cells.filter("event_type = 'purchase'").select("block", F.col("score").alias("best"))
    others = cells.filter("event_type <> 'purchase'").join(best, "block")
    diffs = others.select(F.col("event_type").alias("other"), r6(F.col("best") - F.col("score")).alias("diff"))
    out = stats.wilcoxon(diffs, ["other"], method="normal")
    return out.select("other", "n", "w_plus", "w_minus", "statistic", r6("z").alias("z"), r6("p_value").alias("p_value"))


def wilcoxon_exact(spark, sf):
    """ST-3 by the exact null distribution: mean balances of customers and suppliers over each region's nations."""
    nation = table(spark, sf, "nation")
    sides = [
        table(spark, sf, name).groupBy(F.col(f"{c}_nationkey").alias("n_nationkey")).agg(r6(F.avg(f"{c}_acctbal")).alias(name))
        for name, c in (("customer", "c"), ("supplier", "s"))
    ]
    both = nation.join(sides[0], "n_nationkey").join(sides[1], "n_nationkey")
    diffs = both.select(F.col("n_regionkey").alias("region"), r6(F.col("customer") - F.col("supplier")).alias("diff"))
    out = stats.wilcoxon(diffs, ["region"], method="exact")
    return out.select("region", "n", "statistic", r6("p_value").alias("p_value"))


def knn_in_class(spark, sf):
    """J-3."""
    out = neighbours.neighbours_in_class(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", 3)
    return out.select("label", "vec_id", "rank", "neighbour", r6("distance").alias("distance"))


def tomek_links(spark, sf):
    """J-4, RS-4."""
    return sampling.tomek_links(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")


def tomek_removed(spark, sf):
    """RS-4: rows left after removal."""
    out = sampling.remove_tomek(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")
    return out.select("vec_id", "label")


def pad_and_guard(spark, sf):
    """PF-19, PF-20."""
    df = table(spark, sf, "conversations").withColumn("name", F.when(F.col("turn") > 0, F.col("role")))
    accepted, _ = clean.guard(df, ["text"], ACCENTED)
    padded = clean.pad(accepted, {"name": ("string", "nobody"), "price": ("double", 0.0)})
    return padded.select("conv_id", "turn", "name", "price", F.array_join("imputed_keys", ",").alias("imputed"))


def vector_scores(spark, sf):
    """SF-19..21, AG-15 on part of each embedding's arithmetic."""
    w = F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: 1.0 / i)
    scaled = vectors.weighted(F.transform("embedding", lambda x: F.exp(x.cast("double"))), w)
    df = table(spark, sf, "embeddings").withColumn("s", scaled)
    share = vectors.rounded(vectors.normalised(F.col("s")), 6)
    return df.select("vec_id", vectors.argmax(F.col("s")).alias("best"), F.get(share, F.lit(0)).alias("first_share"))


# Ten embedding labels -> five uneven tiers.
LABEL_TIERS = {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 2, 8: 3, 9: 4}
CANDIDATES = [
    [1.0, 1.0, 1.0, 1.0, 1.0],
    [0.6, 1.0, 1.1, 1.2, 1.3],
    [0.3, 0.7, 1.5, 1.6, 2.0],
    [2.0, 1.0, 0.5, 0.4, 0.3],
    [0.9, 1.2, 0.8, 1.4, 0.7],
    [0.1, 0.2, 0.4, 0.8, 1.6],
]


def _tiers(spark, sf) -> DataFrame:
    """Embeddings as a five-tier training table."""
    df = table(spark, sf, "embeddings").transform(clean.bin_target("label", LABEL_TIERS, "tier"))
    return df.select(
        F.col("vec_id").alias("key"), F.col("tier").alias("label"), F.col("embedding").cast("array<double>")
    )


def _grow(counts):
    return sampling.oversample_target(counts, rare=4, anchor=0, fraction=0.6)


def _vectors(spark, sf) -> DataFrame:
    """Embeddings with two derived flags as a mixed feature vector."""
    flags = F.array((F.col("embedding")[0] > 0).cast("double"), (F.col("embedding")[1] > 0.1).cast("double"))
    return _tiers(spark, sf).select("key", "label", array_to_vector(F.concat("embedding", flags)).alias("features"))


def smotenc(spark, sf):
    """RS-3: every row of the rebalanced table."""
    df = _vectors(spark, sf)
    out = sampling.smotenc(df, "key", "label", "features", _grow(ranking.class_counts(df, "label")), 3)
    v = vector_to_array("features")
    slots = [r6(v[i]).alias(f"x{i}") for i in range(64)]
    return out.select("key", "label", *slots, v[64].alias("flag0"), v[65].alias("flag1"))


def smotenc_counts(spark, sf):
    """RS-2, RS-3: exact class sizes afterwards."""
    return smotenc(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def two_valued(spark, sf):
    """AG-8: which slots count as categorical."""
    cols = ["l_quantity", "l_discount", "is_open", "one"]
    df = table(spark, sf, "lineitem").select(
        "l_quantity", "l_discount", (F.col("l_linestatus") == "O").cast("double").alias("is_open"), F.lit(1.0).alias("one")
    )
    mask, low, high = sampling.two_valued_slots(VectorAssembler(inputCols=cols, outputCol="v").transform(df), "v")
    rows = [(c, int(m), float(a), float(b)) for c, m, a, b in zip(cols, mask, low, high, strict=True)]
    return spark.createDataFrame(rows, "name string, categorical int, low double, high double")


def pls_scores(spark, sf):
    """FT-9."""
    df = _tiers(spark, sf)
    mean, scale, rotations = fit_pls(df, "embedding", "label", 20)
    scores = project(F.col("embedding"), mean, scale, rotations)
    return df.select("key", F.posexplode(scores).alias("component", "score")).select(
        "key", "component", r6("score").alias("score")
    )


def attach_embedding(spark, sf):
    """FT-8: precomputed vectors joined on the row key, source text dropped."""
    known = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    out = attach_embeddings(table(spark, sf, "documents"), known, "doc_id", "embedding", "text")
    return out.select("doc_id", "lang", _big(F.size("embedding")).alias("width"), r6(F.col("embedding")[0].cast("double")).alias("x0"))


def _centroid_probabilities(spark, sf) -> DataFrame:
    """Soft class membership from distances to the class means."""
    df = _tiers(spark, sf)
    cells = df.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    means = np.zeros((5, 64))
    for r in cells.collect():  # classes x dimensions
        means[r["label"], r["i"]] = r["x"]
    centre = F.array(*[F.array(*map(F.lit, m)) for m in means.tolist()])

    def weight(m: Column) -> Column:
        gaps = F.zip_with("embedding", m, lambda a, b: (a - b) * (a - b))
        return F.exp(-F.sqrt(vectors.total(gaps)))

    share = vectors.normalised(F.col("w"))
    return df.withColumn("w", F.transform(centre, weight)).select("key", "label", share.alias("probability"))


def calibration_grid(spark, sf):
    """CS-1, SF-19, SF-20: kappa of each weight vector."""
    pairs = calibrate.candidate_pairs(_centroid_probabilities(spark, sf), "probability", "label", CANDIDATES)
    out = metrics.macro_from_pairs(pairs, ["candidate"])
    return out.select("candidate", r6("accuracy").alias("accuracy"), r6("quadratic_weighted_kappa").alias("kappa"))


def calibrated_labels(spark, sf):
    """CS-3, AG-15, PF-21."""
    df = _centroid_probabilities(spark, sf)
    out = calibrate.apply_weights(df, "probability", CANDIDATES[2], {0: "low", 4: "high"})
    return out.select("key", "prediction", "prediction_label", F.array_max("confidence").alias("confidence"))


def weight_search(spark, sf):
    """CS-2."""
    df = cut_lineage(_centroid_probabilities(spark, sf))
    weights, kappa = calibrate.search_weights(df, "probability", "label", 5)
    return calibrate.apply_weights(df, "probability", weights).select(
        "key", "label", "prediction", F.lit(round(kappa, 6)).alias("kappa")
    )


def _stages(components: int = 8, select: bool = False):
    out = [
        sampling.Undersample(lambda c: sampling.undersample_target(c, fraction=0.5)),
        PlsDa(components=components),
        encoders.BlockAssembler(inputCols=["pls"]),
        CorrelationPruner(threshold=0.95),
        sampling.Smotenc(_grow, neighbours=3),
        sampling.RemoveTomek(),
    ]
    return [*out, models.ImportanceSelector(models.random_forest(trees=10, depth=4))] if select else out


def _predictions(model, df: DataFrame) -> DataFrame:
    p = vector_to_array("probability")
    return model.transform(df).select("key", "label", _big("prediction").alias("prediction"), r6(F.array_max(p)).alias("top"))


def train_predict(spark, sf):
    """ML-2, ML-4: resampling pipeline with a balanced random forest, scored on every row."""
    df = _tiers(spark, sf)
    model = pipeline.ImbalancePipeline(_stages(select=True), models.random_forest(trees=20, depth=6)).fit(df)
    return _predictions(model, df)


def boosted_predict(spark, sf):
    """ML-3 on the plain vectors."""
    df = _vectors(spark, sf)
    model = models.fit_balanced(models.BoostedTrees(trees=5, depth=3), df)
    return _predictions(model, df)


def tree_importance(spark, sf):
    """ML-1, ML-5, TK-4."""
    model = models.fit_balanced(models.decision_tree(depth=6), _vectors(spark, sf))
    return models.importance_table(spark, model, [f"x{i}" for i in range(66)])


def select_features(spark, sf):
    """FT-11: slots kept at the median importance."""
    stage = models.ImportanceSelector(models.random_forest(trees=10, depth=5))
    kept = stage.fit(_vectors(spark, sf)).get("indices")
    return spark.createDataFrame([(i,) for i in kept], "slot int")


def out_of_fold(spark, sf):
    """SV-5."""
    def make():
        return pipeline.ImbalancePipeline(_stages()[1:4], models.decision_tree(depth=5))

    out = pipeline.out_of_fold(_tiers(spark, sf), make, "label", "key", 3)
    return out.select("key", "label", "fold", _big("prediction").alias("prediction"))


def _described(spark, sf) -> DataFrame:
    """The training table with the text of the document of the same id."""
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")
    return cut_lineage(_tiers(spark, sf).join(documents, "key", "left"))


#: The published models by name; also what selects features for them.
CLASSIFIERS = {
    "DecisionTree": models.decision_tree,
    "RandomForest": models.random_forest,
    "XGBoost": models.BoostedTrees,
}


def _text_stages(terms: int, components: int = 20, selector: str | None = None, threshold: str = "median") -> list:
    """TF-IDF terms of the text beside the PLS scores, resampled; ``selector`` names the model that selects slots."""
    under, pls, _, prune, grow, tomek = _stages(components)
    text_block = encoders.ListTextEncoder(textCol="text", maxTerms=terms, stopWords=STOP_WORDS)
    out = [text_block, under, pls, encoders.BlockAssembler(inputCols=["encoded", "pls"]), prune, grow, tomek]
    return [*out, models.ImportanceSelector(CLASSIFIERS[selector](), threshold=threshold)] if selector else out


def feature_grid(spark, sf):
    """SV-1, AG-4, AG-5: the published grid of text terms and PLS components, three models and folds."""
    return search.feature_size_grid(_described(spark, sf), "label", "key", _text_stages, CLASSIFIERS)


#: The published joint grid: sizes of the feature part and settings of the boosted classifier.
JOINT_FEATURES = {"terms": [15, 30, 50], "components": [20, 50, 80]}
JOINT_SPACE = {"depth": [3, 6, 9], "trees": [100, 200, 400], "rate": [0.05, 0.1, 0.19]}


def joint_grid(spark, sf):
    """SV-2: all 243 feature and classifier settings, every fold's kappa beside its setting's mean and place."""
    out = search.joint_grid(_described(spark, sf), "label", "key", _text_stages, JOINT_FEATURES, models.BoostedTrees, JOINT_SPACE)
    size = F.from_json("features", "terms int, components int")
    boost = F.from_json("params", "depth int, trees int, rate double")
    return out.select(
        size.terms.alias("terms"), size.components.alias("components"), boost.depth.alias("depth"), boost.trees.alias("trees"),
        boost.rate.alias("rate"), "fold", "kappa", "qwk_mean", "qwk_std", "place",
    )


def _space(model: str, terms: int, **own) -> dict:
    chosen = {"features__terms": [terms], "features__selector": [model], "features__threshold": ["median", "mean"]}
    return own | chosen


#: The published searches: model, its space and its trials. The least rows of a split and the L2 term have no counterpart.
NESTED = {
    "DecisionTree": (models.decision_tree, _space("DecisionTree", 50, depth=(5, 30), min_rows=(1, 10)), 5),
    "RandomForest": (
        models.Forest,
        _space("RandomForest", 30, trees=(100, 400), depth=(5, 30), min_rows=(1, 8), share=(0.1, 0.6)),
        40,
    ),
    "XGBoost": (
        models.BoostedTrees,
        _space("XGBoost", 15, trees=(100, 400), depth=(3, 9), rate=(0.05, 0.19), min_rows=(1, 8), subsample=(0.6, 1.0)),
        50,
    ),
}


def nested_search(spark, sf):
    """SV-2..4, ST-1: nested search over the published spaces, flattened to one row per model and fold."""
    return stats.flatten_log(search.nested_search(_described(spark, sf), "label", "key", _text_stages, NESTED))


def _forest(spark, sf):
    df = _vectors(spark, sf)
    return df, models.fit_balanced(models.random_forest(trees=10, depth=5), df)


def shapley(spark, sf):
    """EX-1: mean absolute attribution per class and slot over a stratified sample."""
    df, model = _forest(spark, sf)
    sample = explain.explain_sample(df, "label", "key", 2000)
    background = explain.background_matrix(df, "features", "key")
    return explain.global_importance(explain.shapley(sample, model, background, "key"))


def surrogates(spark, sf):
    """EX-2."""
    df, model = _forest(spark, sf)
    background = explain.background_matrix(df, "features", "key", 200)
    scored = model.transform(df).select("key", "features", "prediction")
    return explain.surrogates(scored, model, background, "key", "prediction")


def experiment_log(spark, sf):
    """IO-3, IO-7, ST-1: a log rendered as JSON text, parsed and flattened."""
    day = F.to_date("ts")
    cells = table(spark, sf, "events").groupBy("event_type", day.alias("day")).agg(r6(F.avg("value")).alias("v"))
    fold = F.struct(
        F.dayofmonth("day").alias("fold"),
        F.struct(F.col("v").alias("accuracy"), (-F.col("v")).alias("quadratic_weighted_kappa")).alias("metrics"),
    )
    per_model = cells.groupBy("event_type").agg(F.collect_list(fold).alias("folds_data"))  # one entry per day
    # A log per model, as separate jobs write them: no row holds more than one model.
    text_log = per_model.select(F.to_json(F.create_map("event_type", F.struct("folds_data"))).alias("value"))
    parsed = text_log.select(F.from_json("value", LOG_SCHEMA, {"mode": "FAILFAST"}).alias("results"))
    return stats.flatten_log(parsed)


def _hashed_embedding(df: DataFrame, text_col: str) -> DataFrame:
    """Hashed word counts standing in for the frozen text encoder."""
    words = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), " "), lambda w: w != "")
    df = HashingTF(numFeatures=16, inputCol="_w", outputCol="_tf").transform(df.withColumn("_w", words))
    df = Normalizer(inputCol="_tf", outputCol="_e").transform(df)
    return df.withColumn("embedding", vector_to_array("_e")).drop("_w", "_tf", "_e", text_col)


def _catalogue_model(spark, sf):
    df = _hashed_embedding(clean_catalogue(*_catalogue_sources(spark, sf), "2019-11-20"), "detailed_description")
    df = cut_lineage(df)
    stages_ = feature_stages(terms=10, components=5, stop_words=STOP_WORDS)
    model = pipeline.ImbalancePipeline(stages_, models.random_forest(trees=10, depth=5), catalogue.TARGET)
    return df, model.fit(df)


def catalogue_training(spark, sf):
    """The catalogue pipeline fitted on cleaned rows: FT-1..10, RS-1..4, ML-4."""
    df, model = _catalogue_model(spark, sf)
    return metrics.class_report(model.transform(df), catalogue.TARGET, "prediction")


def score_records(spark, sf):
    """CS-4: conversation turns as JSON records through the catalogue model."""
    _, model = _catalogue_model(spark, sf)
    record = F.to_json(
        F.struct(
            F.col("role").alias("name"),
            F.col("text").alias("short_description"),
            F.col("text").alias("detailed_description"),
            F.col("turn").cast("double").alias("price"),
        )
    )
    broken = F.when(F.col("role") == "system", F.concat(F.lit("{"), record)).otherwise(record)
    lines = table(spark, sf, "conversations").select("conv_id", "turn", broken.alias("value"))
    scored, _ = score(
        lines, model, [0.2] * 5, lambda d: _hashed_embedding(d, "detailed_description")
    )
    return scored.select("conv_id", "turn", "prediction", "prediction_label", F.size("imputed_keys").alias("imputed"))


def _turn_lines(turns: DataFrame) -> DataFrame:
    """Turns as JSON text; those of the system lack their opening brace."""
    record = F.to_json(F.struct(F.col("role").alias("name"), "text"))
    broken = F.when(F.col("role") == "system", F.substring(record, 2, 1 << 30)).otherwise(record)
    return turns.select("conv_id", "turn", broken.alias("value"))


def stream_outcomes(spark, sf):
    """CS-4, IO-4, PF-19: turns as a stream; accepted and rejected ones, with the sizes that their batch committed."""
    source = table(spark, sf, "conversations")
    files = f"{sf}/conversations.parquet*"  # a pattern, as a stream's source may be one file only by pattern
    stream = _turn_lines(spark.readStream.schema(source.schema).parquet(files))

    def split(batch: DataFrame) -> dict[str, DataFrame]:
        records, malformed = read_records(batch, "name string, text string")
        accepted, foreign = clean.guard(records, ["name", "text"], catalogue.FORBIDDEN_SCRIPTS)
        kept = accepted.select("conv_id", "turn", F.lit("accepted").alias("outcome"))
        lost = [(malformed, "malformed"), (foreign, "script")]
        rejected = [part.select("conv_id", "turn", F.lit(reason).alias("outcome")) for part, reason in lost]
        return {"accepted": kept, "rejected": rejected[0].unionByName(rejected[1])}

    target = f"{intermediates(spark)}/stream-{uuid.uuid4().hex}"
    store_stream(stream, target, f"{target}/progress", split).awaitTermination()
    kinds = dict(source.dtypes)
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, outcome string"
    parts = [read_part(spark, target, name, schema) for name in ("accepted", "rejected")]
    sizes = read_commits(spark, target).groupBy("part").agg(F.sum("rows").alias("n")).collect()  # one row per part
    n = {r["part"]: r["n"] for r in sizes}
    whole = n.get("", 0) == n.get("accepted", 0) + n.get("rejected", 0)
    rows = parts[0].unionByName(parts[1])
    return rows.select(
        _big("conv_id").alias("conv_id"), _big("turn").alias("turn"), "outcome",
        F.lit(n.get("", 0)).cast("bigint").alias("n_input"), F.lit(whole).alias("whole"),
    )


def bundle_scores(spark, sf):
    """IO-8, CS-3, ML-1: a fitted tree and its class weights saved, loaded through the manifest, and applied."""
    df = _vectors(spark, sf)
    fitted = PipelineModel([models.fit_balanced(models.decision_tree(depth=6), df)])
    root = save_bundle(fitted, CANDIDATES[2], f"{intermediates(spark)}/bundles", uuid.uuid4().hex)
    model, weights = load_bundle(spark, root)
    both = [m.transform(df).withColumn("probability", vector_to_array("probability")) for m in (fitted, model)]
    one, other = (calibrate.apply_weights(d, "probability", w).select("key", "label", "prediction", "confidence")
                  for d, w in zip(both, (CANDIDATES[2], weights), strict=True))
    sure = F.abs(F.aggregate("confidence", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-3
    same = other.withColumnsRenamed({"prediction": "p", "confidence": "c"}).drop("label")
    return one.join(same, "key").select(
        "key", _big("label").alias("label"), sure.alias("sums_to_one"), ((F.col("prediction") == F.col("p")) & (F.col("confidence") == F.col("c"))).alias("same")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tier_summary, catalogue_clean, clean_html, script_filter, quality_report, keyword_flags, quantity_extract,
        json_lookup, literal_lists, coerce_impute, presence_flags, date_parts_filter, price_rules, review_ratio,
        top_tokens, multi_hot, word_slots, top_creator_flags, top_map_keys, tfidf_terms, tfidf_vectors, robust_scale,
        inverse_scale, mode_impute_onehot, price_level_slots, corr_matrix, corr_prune, wide_corr_prune, class_weights, undersample, oversample_plan,
        strat_split, strat_sample, kfold, class_rank, confusion, macro_metrics, class_report, group_means, group_mean_std,
        argmax_per_group, first_per_class, five_number, top_by_value, ranked_models, friedman, wilcoxon, wilcoxon_exact,
        knn_in_class, tomek_links, tomek_removed, pad_and_guard, vector_scores,
        smotenc, smotenc_counts, two_valued, pls_scores, attach_embedding, calibration_grid, calibrated_labels,
        weight_search, train_predict, boosted_predict, tree_importance, select_features, out_of_fold, feature_grid,
        joint_grid, nested_search, shapley, surrogates, experiment_log, catalogue_training, score_records,
        stream_outcomes, bundle_scores,
    )
}
