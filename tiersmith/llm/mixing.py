"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Tokens are summed per source, language and topic, the sums are raked until they agree with the
target share of every source, language and topic, and each document is kept with a probability
in proportion to its cell's fitted over its present tokens, calibrated so that a given share of
all tokens is kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
#: Name of the category of null and of all that the targets don't list.
OTHER = "*"


def word_count(text: Column) -> Column:
    """Tokens of a text: its runs of other than ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column, rules: Sequence[tuple[str, str]], rest: str) -> Column:
    """Name of the first rule whose string the whole text contains, else ``rest``."""
    topic = F.lit(rest)
    for name, part in reversed(rules):
        topic = F.when(F.contains(text, F.lit(part)), F.lit(name)).otherwise(topic)
    return topic


def uniform_draw(key: Column) -> Column:
    """A number from 0 to 1, one and the same for equal keys: 32 bits of the key's MD5."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(2.0**32)


def rake(tokens: np.ndarray, targets: Sequence[np.ndarray], rounds: int) -> np.ndarray:
    """``tokens`` scaled along each axis in turn until its margins have the shares in ``targets``.

    Where categories that hold all tokens of another can't meet their targets together, the
    result is that of the last round, in which the last axis has its shares.
    """
    fitted = tokens / max(tokens.sum(), 1)
    for _ in range(rounds):
        for axis, share in enumerate(targets):
            others = tuple(i for i in range(fitted.ndim) if i != axis)
            margin = fitted.sum(axis=others)
            factor = np.divide(share, margin, out=np.zeros_like(margin), where=margin > 0)
            fitted = fitted * np.expand_dims(factor, others)
    return fitted


def target_shares(present: np.ndarray, wanted: Sequence[float]) -> np.ndarray:
    """Shares that sum to one: listed categories that occur, in proportion to ``wanted``, beside the others' own.

    ``present`` has the tokens per listed category, then those of the rest, whose share stays.
    """
    total = max(present.sum(), 1)
    weights = np.where(present[:-1] > 0, np.asarray(wanted, float), 0.0)
    rest = present[-1] / total if weights.sum() > 0 else 1.0
    listed = weights / weights.sum() * (1 - rest) if weights.sum() > 0 else weights
    return np.append(listed, rest)


def keep_scale(tokens: np.ndarray, ratios: np.ndarray, keep: float) -> float:
    """The number that times ``ratios``, but at most one, keeps the share ``keep`` of ``tokens``.

    Cells from the largest ratio down are kept whole as long as the others' scale calls for it.
    """
    order = np.argsort(-ratios, kind="stable")
    tokens, ratios = tokens[order], ratios[order]
    whole = np.cumsum(tokens) - tokens
    below = np.cumsum((tokens * ratios)[::-1])[::-1]
    scales = (keep * tokens.sum() - whole) / below
    fits = np.flatnonzero(scales * ratios <= 1.0)
    return float(scales[fits[0]]) if len(fits) else float("inf")


def mixing_weights(
    docs: DataFrame, categories: Mapping[str, tuple[Column, Mapping[str, float]]], tokens: Column, keep: float,
    rounds: int = 30,
) -> tuple[DataFrame, float]:
    """Rows ``(one column per category, probability)`` of the cells that hold tokens, and the scale.

    ``categories`` maps a name to a column and its target weights. Cells are bounded by the
    product of the target lists, each longer by one for the rest, however many values the columns
    have, so their sums come to the driver.
    """
    named = [_listed(column, wanted).alias(name) for name, (column, wanted) in categories.items()]
    sums = docs.select(*named, tokens.alias("_n")).groupBy(*categories).agg(F.sum("_n").alias("_n")).collect()
    values = [[*wanted, OTHER] for _, wanted in categories.values()]
    table = np.zeros([len(v) for v in values])
    for row in sums:
        table[tuple(v.index(c) for v, c in zip(values, row[:-1], strict=True))] = row[-1]
    axes = range(table.ndim)
    shares = [
        target_shares(table.sum(axis=tuple(i for i in axes if i != k)), list(wanted.values()))
        for k, (_, wanted) in enumerate(categories.values())
    ]
    fitted, present = rake(table, shares, rounds), table / max(table.sum(), 1)
    held = np.argwhere(table > 0)
    ratios = fitted[table > 0] / present[table > 0]
    scale = keep_scale(table[table > 0], ratios, keep)
    rows = [
        (*(v[i] for v, i in zip(values, at, strict=True)), float(min(1.0, scale * r) if r > 0 else 0.0))
        for at, r in zip(held, ratios, strict=True)
    ]
    fields = [T.StructField(name, T.StringType()) for name in categories]
    schema = T.StructType([*fields, T.StructField("probability", T.DoubleType())])
    return docs.sparkSession.createDataFrame(rows, schema), scale


def _listed(column: Column, wanted: Mapping[str, float]) -> Column:
    text = column.cast("string")
    return F.when(text.isin(*(w for w in wanted if w != OTHER)), text).otherwise(F.lit(OTHER))


def with_probabilities(
    docs: DataFrame, categories: Mapping[str, tuple[Column, Mapping[str, float]]], tokens: Column, keep: float = 0.5,
    rounds: int = 30, prefix: str = "_mix_",
) -> DataFrame:
    """``docs`` with ``{prefix}probability``, by which the share ``keep`` of all tokens stays on average.

    Tokens kept have the target shares, but for cells so scarce that even all their documents
    fall short: those are kept whole. Documents of cells without tokens (empty and null texts)
    are kept as often as the average document. Null and unlisted categories form one category
    whose share stays; a listed one that doesn't occur leaves its share to the others. Empty
    tables give empty ones.
    """
    weights, scale = mixing_weights(docs, categories, tokens, keep, rounds)
    weights = weights.select(*(F.col(name).alias(prefix + name) for name in categories), F.col("probability").alias(prefix + "p"))
    keyed = docs.withColumns({prefix + n: _listed(column, wanted) for n, (column, wanted) in categories.items()})
    joined = keyed.join(F.broadcast(weights), [prefix + n for n in categories], "left")
    chance = F.coalesce(F.col(prefix + "p"), F.lit(min(1.0, scale)))
    return joined.select(*docs.columns, *(prefix + n for n in categories), chance.alias(prefix + "probability"))


def sample_mixture(
    docs: DataFrame, categories: Mapping[str, tuple[Column, Mapping[str, float]]], tokens: Column,
    id_col: str = "doc_id", keep: float = 0.5, rounds: int = 30,
) -> DataFrame:
    """The documents of the mixture, columns as they are.

    A document is kept if the hash of its id falls below its probability, so equal ids share
    their fate, at any partitioning; a null id is hashed as an empty text.
    """
    found = with_probabilities(docs, categories, tokens, keep, rounds)
    return found.filter(uniform_draw(F.col(id_col)) < F.col("_mix_probability")).select(*docs.columns)
