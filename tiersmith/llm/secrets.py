"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Both models are counts of character pairs. They are learnt from samples which the text labels
itself: values that the patterns found are random strings, identifiers made of words (letters
alone, snake_case, camelCase, dotted, paths, with digits after words) are ordinary. A long token
is a secret if the log-likelihood ratio of the two models is high in all and per character.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.batches import text_batches
from tiersmith.session import cut_lineage

KINDS = ("assign", "access", "hex", "markov")
# The patterns of the base kinds and their least lengths.
KEYS = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the whole run, as nothing shorter counts
LEAST = {"assign": 6, "access": 20}
#: Long tokens, dotted ones whole. The models learn from those that :data:`WORDS` matches, and judge every part between dots.
TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
PART = re.compile(r"[^.]+")
#: Words in one case or with a capital first, joined by case or marks; up to four digits may follow a word. Random strings
#: of digits and letters in both cases hardly ever look like that.
_HUMPS = r"(?:[A-Za-z]?[a-z]{2,}(?:[0-9]{0,4}[A-Z][a-z]+)*|[A-Z]{3,})[0-9]{0,4}"
WORDS = re.compile(rf"[_/-]*{_HUMPS}(?:[_./-]+(?:{_HUMPS}|[A-Za-z]?[0-9]{{1,4}}|[A-Za-z]))*[_/-]*")
#: Characters of encoded secrets.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
#: Printable ASCII, and one more for the start and for all else.
SIZE = 96
TOKENS = "array<struct<start:int,token:string>>"
SPAN_LIST = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Kind, start, end and secret of the pattern matches of one text, leftmost first within each kind."""
    spans = []
    if KEYS.search(text):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                spans.append(("assign", m.start(), m.end(), m[2]))
    if "AKIA" in text:
        spans += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    spans += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def loose_tokens(text: str, spans: list[tuple[str, int, int, str]]) -> list[tuple[int, str]]:
    """Long tokens that touch no span, without dots at their ends; of those that do, the long parts that touch none."""
    found = []
    for m in TOKEN.finditer(text):
        near = [(a, b) for _, a, b, _ in spans if a < m.end() and m.start() < b]
        if near:
            pieces = [(m.start() + p.start(), p[0]) for p in PART.finditer(m[0])]
        else:
            pieces = [(m.start() + len(m[0]) - len(m[0].lstrip(".")), m[0].strip("."))]
        for start, token in pieces:
            if len(token) >= 16 and not any(a < start + len(token) and start < b for a, b in near):
                found.append((start, token))
    return found


def pair_codes(token: str) -> np.ndarray:
    """Index of each character pair, the first paired with the start."""
    raw = np.frombuffer(token.encode("latin-1", "replace"), np.uint8).astype(np.int64) - 32
    raw = np.where((raw >= 0) & (raw < SIZE - 1), raw, SIZE - 1)
    return np.concatenate([[SIZE - 1], raw[:-1]]) * SIZE + raw if len(raw) else raw


def ordinary(token: str) -> bool:
    """Whether a token labels itself as an identifier made of words: a sample, not a verdict."""
    return WORDS.fullmatch(token) is not None


def _records(spans: list[tuple[str, int, int, str]]) -> list[dict]:
    return [dict(zip(("kind", "start", "end", "value"), s, strict=True)) for s in spans]


def scan(docs: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    """Rows ``(id, spans, tokens)``: pattern matches and long tokens, one row per row of ``docs``.

    Without ``id_col`` the ids are null.
    """
    kind = docs.schema[id_col].dataType.simpleString() if id_col else "boolean"
    loose = pa.list_(pa.struct([("start", pa.int32()), ("token", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                found = base_spans(text)
                spans.append(_records(found))
                tokens.append([{"start": a, "token": t} for a, t in loose_tokens(text, found)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, SPAN_LIST), pa.array(tokens, loose)], names=["id", "spans", "tokens"]
            )

    ident = F.col(id_col) if id_col else F.lit(None).cast(kind)
    rows = text_batches(docs).select(ident.alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, f"id {kind}, spans {SPANS}, tokens {TOKENS}")


def pair_chances(counts: np.ndarray, shares: tuple[float, float, float] = (0.9, 0.09, 0.01)) -> np.ndarray:
    """Chance of each next character: fixed shares of pair counts, single counts and a uniform choice.

    Only the proportions of the counts matter, so a table ten times as large gives the same chances.
    """
    single, rows = counts.sum(axis=0), counts.sum(axis=1, keepdims=True)
    single = single / single.sum() if single.sum() else np.full(SIZE, 1.0 / SIZE)
    pair = np.where(rows > 0, counts / np.maximum(rows, 1e-300), single)
    return shares[0] * pair + shares[1] * single + shares[2] / SIZE


def any_case(counts: np.ndarray, share: float = 0.1) -> np.ndarray:
    """Counts and a share of them with the case of all letters swapped: a word is ordinary in capitals, too."""
    swap = np.array([ord(c.swapcase()) - 32 if c.isalpha() else i for i, c in enumerate(map(chr, range(32, 32 + SIZE)))])
    return counts + share * counts[np.ix_(swap, swap)]


def log_ratios(ordinary_pairs: np.ndarray, random_pairs: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of random against ordinary for each character pair.

    Random strings are half what the samples show and half a free choice of ``ALPHABET``, as the
    samples need not show every kind.
    """
    free = np.full(SIZE, 1e-6)
    free[np.frombuffer(ALPHABET, np.uint8) - 32] = 1.0 / len(ALPHABET)
    drawn = 0.5 * pair_chances(random_pairs) + 0.5 * free
    return np.log(drawn / pair_chances(any_case(ordinary_pairs))).ravel()


def fit_models(scanned: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of random against ordinary for each character pair, from all labelled samples.

    Counts are summed per pair inside the tasks; at most 2 x 96 x 96 sums come back. Without
    samples of a kind its counts are zero.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            for spans, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for s in spans:
                    np.add.at(sums[1], pair_codes(s["value"]), 1)
                plain = [pair_codes(t["token"]) for t in tokens if ordinary(t["token"])]
                if plain:
                    sums[0] += np.bincount(np.concatenate(plain), minlength=SIZE * SIZE)
        label, code = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label), pa.array(code), pa.array(sums[label, code])], names=["label", "code", "n"]
        )

    table = np.zeros((2, SIZE, SIZE))
    counted = scanned.select("spans", "tokens").mapInArrow(count, "label bigint, code bigint, n bigint")
    for label, code, n in counted.groupBy("label", "code").sum("n").collect():
        table[label, code // SIZE, code % SIZE] = n
    return log_ratios(table[0], table[1])


@dataclass(frozen=True)
class Bar:
    """What a token must reach: characters, ratio in all, ratio per character."""

    least: int = 20
    total: float = 20.0
    mean: float = 1.0


def random_spans(tokens: Iterable[tuple[int, str]], ratios: np.ndarray, bar: Bar) -> list[tuple[str, int, int, str]]:
    """Spans of the tokens, or of their parts between dots, that the models take for random strings."""
    found = []
    for start, token in tokens:
        for m in PART.finditer(token):
            if len(m[0]) >= bar.least and not m[0].isdigit():
                if float(ratios[pair_codes(m[0])].sum()) >= max(bar.total, bar.mean * len(m[0])):
                    found.append(("markov", start + m.start(), start + m.end(), m[0]))
    return found


def judge(ratios: np.ndarray, bar: Bar) -> Column:
    @F.arrow_udf(SPANS)
    def spans(tokens: pa.Array) -> pa.Array:
        rows = ([(t["start"], t["token"]) for t in row or []] for row in tokens.to_pylist())
        return pa.array([_records(random_spans(row, ratios, bar)) for row in rows], SPAN_LIST)

    return spans(F.col("tokens"))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bar: Bar = Bar()
) -> DataFrame:
    """Rows ``(id, spans)``, one per row of ``docs``; ``spans`` holds kind, start, end and value.

    Positions are code points, the end exclusive; spans stand by start, then by kind in the order
    of ``KINDS``. Pattern matches are all kept; the models only add spans, which touch none of
    them. Whole texts are read once, and both models are counted over every document. A null or
    empty text has no spans; repeated rows are scanned as often as they come.
    """
    scanned = cut_lineage(scan(docs, id_col, text_col))
    ratios = fit_models(scanned)
    order = F.array(*map(F.lit, KINDS))
    keyed = F.transform(
        F.concat("spans", judge(ratios, bar)),
        lambda s: F.struct(s.start.alias("start"), F.array_position(order, s.kind).alias("rank"), s.alias("span")),
    )
    return scanned.select(F.col("id").alias(id_col), F.transform(F.array_sort(keyed), lambda s: s.span).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def mask_secrets(docs: DataFrame, text_col: str = "text", bar: Bar = Bar(), mask: str = "[SECRET]") -> Column:
    """``text_col`` with every span of :func:`find_secrets` replaced; spans that overlap are replaced as one.

    One pass over ``docs`` counts the models and a second, row by row, finds and covers the spans,
    so nothing is joined and rows of one id may differ. A null text stays null.
    """
    ratios = fit_models(scan(docs, None, text_col))

    @F.arrow_udf("string")
    def cover(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            text = value.as_py()
            found = base_spans(text or "")
            found = sorted(s[1:3] for s in found + random_spans(loose_tokens(text or "", found), ratios, bar))
            if found:
                parts, at = [], 0
                for start, end in found:
                    if not parts or start >= at:
                        parts += [text[at:start], mask]
                    at = max(at, end)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pa.array(out, pa.string())

    return cover(F.col(text_col).cast("string"))
