"""Stringified dict/list columns parsed with ``from_json`` (SF-9..14, TK-1).

The sources hold Python literals: single quotes, ``True/False/None`` and ``\\xHH``
escapes. They are turned into lenient JSON text with regexes that step over quoted
strings, then parsed inside the JVM; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JSON_OPTIONS = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
QUOTED = r"""'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+\""""
WORDS = {"True": "true", "False": "false", "None": "null"}
_ATOM = (
    r"(?:[+-]?(?:0|[1-9]\d*)(?:\.\d*)?(?:[eE][+-]?\d+)?|[+-]?\.\d+|True|False|None|" + QUOTED + ")"
)
NON_LIST_LITERAL = rf"(?s)^[ \t]*\(?\s*{_ATOM}(?:\s*,\s*{_ATOM})*+\s*,?\s*\)?\s*$"


def literal_json(c: Column) -> Column:
    """Python-literal text as lenient JSON text."""
    out = F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    for word, json_word in WORDS.items():
        # \G chains matches end to end, so quoted strings are consumed whole and skipped.
        head = rf"\G((?:[^'\"{word[0]}]++|{QUOTED}|(?<=\w){word[0]}|{word[0]}(?!{word[1:]}\b))*+)"
        out = F.regexp_replace(out, head + rf"{word}\b", "$1" + json_word)
    return out


def _bracketed(c: Column, left: str, right: str) -> Column:
    return c.rlike(rf"(?s)^[ \t]*\{left}.*\{right}\s*$")


def parse_dict(c: Column, value_type: str = "string") -> Column:
    """SF-9: dict text to a map; anything unparseable is null."""
    parsed = F.from_json(literal_json(c), f"map<string,{value_type}>", JSON_OPTIONS)
    return F.when(_bracketed(c, "{", "}"), parsed)


def parse_list(c: Column) -> Column:
    """List text to an array of element texts; anything else is null."""
    parsed = F.from_json(literal_json(c), "array<string>", JSON_OPTIONS)
    return F.when(_bracketed(c, "[", "]"), parsed)


def lookup(m: Column, key: str, default) -> Column:
    """SF-12: map lookup with a default for a missing map, key or value."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def bool_flag(m: Column, key: str) -> Column:
    value = F.lower(F.try_element_at(m, F.lit(key)))
    return F.coalesce(value.isin("true", "1").cast("int"), F.lit(0))


def int_field(m: Column, key: str) -> Column:
    value = F.try_element_at(m, F.lit(key)).try_cast("double")
    return F.coalesce(value.try_cast("int"), F.lit(0))


def _empty() -> Column:
    return F.array().cast("array<string>")


def descriptions(c: Column, field: str = "description") -> Column:
    """SF-10: list of dicts to the tokens of one field; non-dict items skipped."""
    items = F.filter(parse_list(c), lambda x: x.startswith("{"))
    maps = F.transform(items, lambda x: F.from_json(x, "map<string,string>"))

    def name(m: Column) -> Column:
        absent = F.when(F.map_contains_key(m, F.lit(field)), F.lit("None")).otherwise(F.lit(""))
        return F.replace(F.coalesce(F.try_element_at(m, F.lit(field)), absent), F.lit(" "), F.lit("_"))

    return F.coalesce(F.transform(F.filter(maps, lambda m: m.isNotNull()), name), _empty())


def simple_list(c: Column) -> Column:
    """SF-11: list text to tokens, else comma-separated text to tokens.

    Text that is some other literal (a number, a quoted string, a tuple, a dict) gives no tokens.
    """
    from tiersmith.functions.text import comma_tokens, token

    listed = F.transform(parse_list(c), lambda x: token(F.coalesce(x, F.lit("None"))))
    other = c.rlike(NON_LIST_LITERAL) | parse_dict(c).isNotNull()
    return F.when(c.isNull() | other, _empty()).otherwise(F.coalesce(listed, comma_tokens(c)))


def top_keys(m: Column, n: int = 5) -> Column:
    """TK-1: the n keys with the largest values, earlier entry first on ties."""
    ranked = F.array_sort(
        F.transform(
            F.map_entries(m),
            lambda e, i: F.struct((-e["value"]).alias("v"), i.alias("i"), e["key"].alias("k")),
        )
    )
    keys = F.transform(F.slice(ranked, 1, n), lambda s: F.replace(s["k"], F.lit(" "), F.lit("_")))
    return F.coalesce(keys, _empty())


def list_length(c: Column) -> Column:
    """SF-13: element count of list text; 0 when missing or unparseable."""
    return F.coalesce(F.size(parse_list(c)), F.lit(0))
