"""The catalogue cleaning job: two raw tables to the clean feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersmith.functions import dates, nested, text
from tiersmith.operators import clean
from tiersmith.operators.aggregates import drop_report
from tiersmith.plans import catalogue as cat
from tiersmith.session import cut_lineage


def join_sources(store: DataFrame, usage: DataFrame) -> DataFrame:
    """Ids are coerced before the join, so a text-polluted id column cannot break it.

    Store prices and usage prices share no name but ``price``, which is rebuilt from cents.
    """
    a = store.transform(clean.coerce_id("steam_appid"))
    b = usage.transform(clean.coerce_id("appid"))
    return clean.suffix_join(a, b, "steam_appid", "appid", ("_store", "_spy"))


def derive(df: DataFrame) -> DataFrame:
    """All derived columns; keeps every row."""
    return (
        df.transform(clean.presence_flags(cat.PRESENCE))
        .transform(clean.count_list("dlc", "num_dlc"))
        .transform(
            clean.flatten_nested(
                cat.PLATFORM_FLAGS,
                cat.NESTED_NUMBERS,
                ["categories", "genres"],
                ["publishers", "developers"],
                ["tags"],
            )
        )
        .transform(clean.split_languages("languages", "num_languages_supported"))
        .transform(
            clean.requirement_features(cat.REQUIREMENT_COLUMNS, cat.MEMORY_LEVELS, cat.HARDWARE_PATTERNS)
        )
        .transform(clean.set_price())
        .transform(clean.set_ratio("positive", "negative", "review_ratio"))
        .transform(clean.clean_texts(cat.TEXT_COLUMNS))
    )


def clean_catalogue(store: DataFrame, usage: DataFrame, as_of: str) -> DataFrame:
    """Steps 1-10 of the cleaning job as one lazy plan.

    ``steam_appid`` stays; where a source repeats an id, :func:`with_row_key` tells its rows apart.
    """
    return (
        join_sources(store, usage)
        .transform(clean.keep_type("type", "game"))
        .transform(clean.bin_target("owners", cat.OWNER_TIERS, cat.TARGET))
        .transform(clean.release_filter("release_date", as_of))
        .transform(derive)
        .transform(clean.require_text(cat.REQUIRED_TEXT))
        .transform(
            clean.drop_scripts(
                cat.REQUIRED_TEXT, ["tags", "genres", "publishers", "developers"], cat.FORBIDDEN_SCRIPTS
            )
        )
        .transform(clean.coerce_numbers(cat.COERCED_INTS, cat.BINARY_FLAGS))
        .transform(clean.arrange(["steam_appid", *cat.COLUMN_ORDER], cat.TARGET, {"name_store": "name"}))
        .transform(clean.drop_columns(cat.DROPPED))
    )


def with_row_key(df: DataFrame, col: str = "key") -> DataFrame:
    """``df`` with a bigint key of each row's own, written once so that the keys stay as they are."""
    return cut_lineage(df.withColumn(col, F.monotonically_increasing_id()))


def cleaning_report(store: DataFrame, usage: DataFrame, as_of: str) -> DataFrame:
    """AG-10: rows lost at each filter, in order, from one pass over the joined rows."""
    raw = F.col("release_date")
    held = F.when(raw.contains("{"), nested.lookup(nested.parse_dict(raw), "date", "")).otherwise(raw)
    joined = join_sources(store, usage).transform(derive)
    texts = F.lit(True)
    for c in cat.REQUIRED_TEXT:
        texts = texts & F.col(c).isNotNull()
    foreign = text.any_has_script(
        [F.col(c) for c in cat.REQUIRED_TEXT],
        [F.col(c) for c in ("tags", "genres", "publishers", "developers")],
        cat.FORBIDDEN_SCRIPTS,
    )
    return drop_report(
        joined,
        [
            ("type", F.col("type") == "game"),
            ("target", clean.map_value(F.col("owners"), cat.OWNER_TIERS).isNotNull()),
            ("release", dates.released_by(dates.parse_date(held), as_of)),
            ("text", texts),
            ("script", ~foreign),
        ],
    )


def feature_scope(df: DataFrame, scope: str) -> DataFrame:
    """PF-14: scope ``pre`` drops what is known only after launch."""
    if scope not in ("pre", "post"):
        raise ValueError(f"unknown scope {scope!r}")
    return df.drop(*cat.POST_RELEASE) if scope == "pre" else df
