"""Column expressions for HTML, whitespace, script and keyword work (SF-1..8, PF-6)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point Python's str.strip and \s treat as space; Java's \s is ASCII-only.
# The Latin-1 ones are listed singly because Java then tests them with one bit lookup.
LATIN_SPACE = r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
WIDE_SPACE = r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def strip_html(c: Column) -> Column:
    """SF-1: every ``<...>`` run becomes one space."""
    return F.regexp_replace(c, r"<[^>]+>", " ")


def plain_spaces(c: Column) -> Column:
    """Wide spaces as plain ones; texts without any character in their range are not rewritten."""
    wide = F.regexp_replace(c, f"[{WIDE_SPACE}]", " ")
    return F.when(c.rlike(r"[\u1680-\u3000]"), wide).otherwise(c)


def collapse_space(c: Column) -> Column:
    """SF-2: any whitespace run becomes one space, ends trimmed."""
    return F.trim(F.regexp_replace(plain_spaces(c), f"[{LATIN_SPACE}]+", " "))


def clean_text(c: Column) -> Column:
    """SF-1..3: markup and whitespace cleaned; the text ``nan`` counts as missing."""
    spaced = F.regexp_replace(strip_html(plain_spaces(c)), f"[{LATIN_SPACE}]+", " ")
    return F.nullif(F.trim(spaced), F.lit("nan"))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARACTERS))


def underscore(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def token(c: Column) -> Column:
    """SF-4: trimmed, inner spaces as underscores."""
    return underscore(strip(c))


def comma_tokens(c: Column) -> Column:
    """SF-5: comma-separated text to tokens, empties dropped; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), token)
    return F.filter(parts, lambda x: x != "")


def joined_lower(*cols: Column) -> Column:
    """SF-6: lower-cased concatenation, null as empty text."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols]))


def matches(c: Column, pattern: str) -> Column:
    """Unicode-aware regex search; null text never matches."""
    return F.coalesce(c.rlike("(?U)" + pattern), F.lit(False))


def keyword_flags(text: Column, patterns: Mapping[str, str]) -> dict[str, Column]:
    """SF-7: one 0/1 column per named pattern."""
    return {name: matches(text, p).cast("int") for name, p in patterns.items()}


def has_script(c: Column, char_class: str) -> Column:
    """PF-6: true when ``c`` holds a character of the class; null is false."""
    return F.coalesce(c.rlike(f"[{char_class}]"), F.lit(False))


def any_has_script(scalars: Sequence[Column], arrays: Sequence[Column], char_class: str) -> Column:
    found = [has_script(c, char_class) for c in scalars]
    found += [has_script(F.array_join(c, " "), char_class) for c in arrays]
    out = F.lit(False)
    for f in found:
        out = out | f
    return out


def to_number(c: Column) -> Column:
    """Numeric text to double, anything else to null.

    The regex keeps out what a JVM cast accepts but a catalogue does not mean (``1d``, ``inf``).
    """
    s = strip(c.cast("string"))
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


# Words removed before looking for an amount, and units per gigabyte.
MEMORY_NOISE = r"video\s*memory|vram|graphics\s*memory|storage|hard\s*drive|space"
MEMORY_AMOUNT = r"memory[:\s-]*\d+[.,]?\d*\s*(?:mb|gb|kb)|\d+[.,]?\d*\s*(?:mb|gb|kb)\s*ram"
UNITS_PER_GB = {"kb": 1024.0 * 1024.0, "mb": 1024.0, "gb": 1.0}


def quantity(
    text: Column,
    noise: str = MEMORY_NOISE,
    amount: str = MEMORY_AMOUNT,
    units: Mapping[str, float] = UNITS_PER_GB,
) -> Column:
    """SF-8: first amount-with-unit in ``text``, converted to the base unit.

    A comma is always a decimal mark, so ``1,024 mb`` reads as 1.024 MB.
    """
    kept = F.regexp_replace(F.lower(text), "(?U)" + noise, "")
    hit = F.regexp_extract(kept, "(?U)" + amount, 0)
    value = F.replace(F.regexp_extract(hit, r"(\d+[.,]?\d*)", 1), F.lit(","), F.lit(".")).try_cast("double")
    unit = F.regexp_extract(hit, "(?U)\\d\\s*[.,]?\\s*(" + "|".join(units) + ")", 1)
    per_base = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])
    return value / F.try_element_at(per_base, unit)
