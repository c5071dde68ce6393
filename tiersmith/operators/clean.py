"""Catalogue cleaning steps, each ``DataFrame -> DataFrame`` for ``df.transform`` (PF-1..20, J-1, J-2).

A step skips columns that are absent, so partial sources work. All steps are row-local
expressions; the join is the only shuffle, and Catalyst moves one-sided filters below it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiersmith.functions import dates, nested, text


def has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def computed_once(df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns that later filters use, without the optimizer copying them there.

    A filter moves below a projection by repeating its expressions; it cannot move below a
    generator, so costly text work runs once per row. Use it after the join, where no
    one-sided filter has to pass.
    """
    if not cols:
        return df
    kept = [F.col(c) for c in df.columns if c not in cols]
    return df.select(*kept, F.inline(F.array(F.struct(*[x.alias(n) for n, x in cols.items()]))))


def coerce_id(col: str):
    """PF-1: numeric ids as bigint; rows whose id is text go.

    Whole numbers are read as such, since a double tells ids apart only below 2**53.
    """
    whole = text.strip(F.col(col).cast("string")).try_cast("bigint")
    number = F.coalesce(whole, text.to_number(F.col(col)).try_cast("bigint"))
    return lambda df: df.withColumn(col, number).filter(F.col(col).isNotNull())


def suffix_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, suffixes: Sequence[str]):
    """J-1: inner join on differently named keys; shared column names get suffixes."""
    shared = (set(left.columns) & set(right.columns)) - {left_key, right_key}
    a = left.select(*[F.col(c).alias(c + suffixes[0] if c in shared else c) for c in left.columns])
    b = right.select(*[F.col(c).alias(c + suffixes[1] if c in shared else c) for c in right.columns])
    return a.join(b, a[left_key] == b[right_key], "inner")


def keep_type(col: str, wanted: str):
    """PF-2."""
    return lambda df: df.filter(F.col(col) == wanted) if has(df, col) else df


def map_value(c: Column, table: Mapping) -> Column:
    """J-2 for a fixed table: row-local lookup, null when absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def bin_target(col: str, table: Mapping, out: str):
    """PF-3: ordinal tier by exact value; unmapped rows go."""
    return lambda df: df.withColumn(out, map_value(F.col(col), table).cast("int")).filter(F.col(out).isNotNull())


def presence_flags(flags: Mapping[str, str]):
    """PF-4: ``{source: flag}``; source columns are dropped."""

    def run(df: DataFrame) -> DataFrame:
        found = {s: f for s, f in flags.items() if has(df, s)}
        return df.withColumns({f: F.col(s).isNotNull().cast("int") for s, f in found.items()}).drop(*found)

    return run


def count_list(col: str, out: str):
    """SF-13."""
    return lambda df: df.withColumn(out, nested.list_length(F.col(col))).drop(col) if has(df, col) else df


def int_or_zero(c: Column) -> Column:
    """PF-8: truncated number, 0 when missing or not numeric."""
    return F.coalesce(text.to_number(c).try_cast("int"), F.lit(0))


def clipped(c: Column) -> Column:
    """PF-9: 0..1."""
    return F.greatest(F.lit(0), F.least(F.lit(1), c))


def unit_flag(c: Column) -> Column:
    return clipped(int_or_zero(c))


def set_price(cents: str = "initialprice", free: str = "is_free", discount: str = "discount"):
    """PF-10."""

    def run(df: DataFrame) -> DataFrame:
        if not has(df, cents):
            return df
        price = text.to_number(F.col(cents)) / 100.0
        if not has(df, free):
            df = df.withColumn("price", price)
            return df.withColumn(free, F.coalesce(F.col("price") == 0.0, F.lit(False)))
        is_free = F.lower(F.col(free).cast("string")).eqNullSafe("true")
        cols = {"price": F.when(is_free, 0.0).otherwise(price)}
        if has(df, discount):
            cols[discount] = F.when(is_free, 0.0).otherwise(text.to_number(F.col(discount)))
        return df.withColumns(cols)

    return run


def ratio(positive: Column, negative: Column) -> Column:
    """PF-11: share of positives, 0 without any."""
    total = positive + negative
    return F.when(total > 0, positive / total).otherwise(F.lit(0.0))


def set_ratio(positive: str, negative: str, out: str):
    p, n = text.to_number(F.col(positive)), text.to_number(F.col(negative))
    return lambda df: df.withColumn(out, ratio(p, n)) if has(df, positive, negative) else df


def release_filter(col: str, as_of: str, year: str = "release_year", month: str = "release_month"):
    """SF-15, SF-16, PF-7: parse a date or a dict holding one, keep released rows, add year and month."""

    def run(df: DataFrame) -> DataFrame:
        if not has(df, col):
            return df
        raw = F.col(col)
        held = F.when(raw.contains("{"), nested.lookup(nested.parse_dict(raw), "date", "")).otherwise(raw)
        df = df.withColumn("_date", dates.parse_date(held)).filter(dates.released_by(F.col("_date"), as_of))
        return df.withColumns({year: F.year("_date"), month: F.month("_date")}).drop("_date")

    return run


def flatten_nested(
    flags: Mapping[str, Mapping[str, str]],
    numbers: Mapping[str, tuple[str, str]],
    described: Sequence[str],
    lists: Sequence[str],
    scored: Sequence[str],
    top_n: int = 5,
):
    """SF-17: every nested column in one projection.

    ``flags`` {column: {key: output}}, ``numbers`` {column: (key, output)}, ``described``
    lists of dicts, ``lists`` plain lists, ``scored`` maps reduced to their top keys.
    """

    def run(df: DataFrame) -> DataFrame:
        # Maps read by several outputs are parsed once, in a projection of their own.
        maps = {f"_{c}": nested.parse_dict(F.col(c)) for c in flags if has(df, c)}
        df = df.withColumns(maps) if maps else df
        cols: dict[str, Column] = {}
        for c, outs in flags.items():
            if has(df, c):
                cols |= {out: nested.bool_flag(F.col(f"_{c}"), key) for key, out in outs.items()}
        for c, (key, out) in numbers.items():
            if has(df, c):
                cols[out] = nested.int_field(nested.parse_dict(F.col(c)), key)
        cols |= {c: nested.descriptions(F.col(c)) for c in described if has(df, c)}
        cols |= {c: nested.simple_list(F.col(c)) for c in lists if has(df, c)}
        cols |= {c: nested.top_keys(nested.parse_dict(F.col(c), "double"), top_n) for c in scored if has(df, c)}
        return df.withColumns(cols).drop(*maps) if cols else df

    return run


def split_languages(col: str, out: str):
    """SF-5, SF-14."""

    def run(df: DataFrame) -> DataFrame:
        if not has(df, col):
            return df
        return df.withColumn(col, text.comma_tokens(F.col(col))).withColumn(out, F.size(col))

    return run


def requirement_features(cols: Sequence[str], levels: Mapping[str, str], patterns: Mapping[str, str]):
    """SF-7, SF-8: memory per level from tag-stripped text, flags from the raw text of all columns.

    A missing later level falls back to the first one.
    """

    def run(df: DataFrame) -> DataFrame:
        found = [c for c in cols if has(df, c)]
        df = df.withColumns({f"_{c}": nested.parse_dict(F.col(c)) for c in found}) if found else df
        out: dict[str, Column] = {}
        for key, name in levels.items():
            parts = [nested.lookup(F.col(f"_{c}"), key, "") for c in found]
            out[name] = text.quantity(text.strip_html(F.concat_ws(" ", *parts))) if parts else F.lit(None)
        df = df.withColumns({n: c.cast("double") for n, c in out.items()})
        first, *rest = levels.values()
        df = df.withColumns({n: F.coalesce(F.col(n), F.col(first)) for n in rest})
        raw = text.joined_lower(*[F.col(c) for c in found]) if found else F.lit("")
        return df.withColumns(text.keyword_flags(raw, patterns)).drop(*[f"_{c}" for c in found])

    return run


def clean_texts(cols: Sequence[str]):
    """SF-1..3."""
    return lambda df: computed_once(df, {c: text.clean_text(F.col(c)) for c in cols if has(df, c)})


def require_text(cols: Sequence[str]):
    """PF-5: null goes, empty text stays."""
    return lambda df: df.dropna(subset=[c for c in cols if has(df, c)])


def drop_scripts(texts: Sequence[str], lists: Sequence[str], char_class: str):
    """PF-6."""

    def run(df: DataFrame) -> DataFrame:
        scalars = [F.col(c) for c in texts if has(df, c)]
        arrays = [F.col(c) for c in lists if has(df, c)]
        return df.filter(~text.any_has_script(scalars, arrays, char_class))

    return run


def coerce_numbers(ints: Sequence[str], flags: Sequence[str]):
    """PF-8, PF-9; columns that already hold integers skip the text check."""

    def run(df: DataFrame) -> DataFrame:
        def whole(c: str) -> Column:
            if df.schema[c].dataType == T.IntegerType():
                return F.coalesce(F.col(c), F.lit(0))
            return int_or_zero(F.col(c))

        cols = {c: whole(c) for c in ints if has(df, c)}
        return df.withColumns(cols | {c: clipped(whole(c)) for c in flags if has(df, c)})

    return run


def arrange(order: Sequence[str], last: str, renames: Mapping[str, str]):
    """PF-12: renamed, listed columns first, target last."""

    def run(df: DataFrame) -> DataFrame:
        for a, b in renames.items():
            df = df.withColumnRenamed(a, b)
        head = [c for c in dict.fromkeys(order) if has(df, c) and c != last]
        rest = [c for c in df.columns if c not in head and c != last]
        return df.select(*head, *rest, *([last] if has(df, last) else []))

    return run


def drop_columns(names: Sequence[str]):
    """PF-13, PF-14: absent names are ignored."""
    return lambda df: df.drop(*names)


def pad(df: DataFrame, defaults: Mapping[str, tuple[str, object]], report: str = "imputed_keys") -> DataFrame:
    """PF-20: absent or null columns get defaults; ``report`` lists what was filled."""

    def default(kind: str, value) -> Column:
        return F.array().cast(kind) if kind.startswith("array") else F.lit(value).cast(kind)

    missing = {k: F.lit(True) if k not in df.columns else F.col(k).isNull() for k in defaults}
    names = F.array_compact(F.array(*[F.when(m, F.lit(k)) for k, m in missing.items()]))
    cols = {
        k: default(kind, v) if k not in df.columns else F.coalesce(F.col(k).cast(kind), default(kind, v))
        for k, (kind, v) in defaults.items()
    }
    return df.withColumn(report, names).withColumns(cols)


def guard(df: DataFrame, texts: Sequence[str], char_class: str) -> tuple[DataFrame, DataFrame]:
    """PF-19: (accepted, rejected) by script."""
    bad = text.any_has_script([F.col(c) for c in texts if has(df, c)], [], char_class)
    return df.filter(~bad), df.filter(bad)
