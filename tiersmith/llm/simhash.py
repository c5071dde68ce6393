"""SimHash fingerprints of word shingles and their links, by the generalised pigeonhole principle.

Fingerprints differ in at most ``max_distance`` bits only if, for some partition of the bits,
they differ there in at most that partition's threshold, when the thresholds plus one sum to
``max_distance + 1``. Bits that vary together share a partition; a dynamic program over counted
candidates picks the number of partitions and a threshold for each. Signatures that few
fingerprints share are probed and verified. Members of crowded signatures meet at midpoints
instead (see :func:`_crowded_links`), which finds the same links in linear room.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.batches import text_batches
from tiersmith.llm.graph import connected_components
from tiersmith.session import cut_lineage

BITS = 64
SEED = 42
#: A signature shared by more fingerprints is crowded.
CROWD = 32


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Fingerprint of one text as a signed 64-bit number: the bits set in over half its shingle hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(itertools.accumulate(map(len, words), lambda at, n: at + n + 1))
        starts = [0, *(e + 1 for e in ends[: len(ends) - shingle])]
        hash64 = xxhash.xxh64_intdigest
        hashes = [hash64(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=True)]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.array(hashes[at : at + 65536], ">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes))
    return int(bits.view(">i8")[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """Rows ``(id, fp)``, one per row of ``docs``; a null text counts as empty."""
    kind = docs.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = [fingerprint(t.as_py() or b"", shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    rows = text_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, f"id {kind.simpleString()}, fp bigint")


def _bit_pairs(fps: DataFrame) -> np.ndarray:
    """How often two bits are set together, over all fingerprints: a fixed 64 x 64 table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype(">i8")
            bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
        row = np.repeat(np.arange(BITS), BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row), pa.array(np.tile(np.arange(BITS), BITS)), pa.array(total.ravel())], names=["i", "j", "n"]
        )

    table = np.zeros((BITS, BITS))
    for i, j, n in fps.select("fp").mapInArrow(work, "i bigint, j bigint, n bigint").groupBy("i", "j").sum("n").collect():
        table[i, j] = n
    return table


def bit_order(pairs: np.ndarray, total: int) -> list[int]:
    """Bits from the left, arranged so that those which vary together stand together.

    Clusters are merged by the strongest correlation left between them.
    """
    mean = np.diag(pairs) / max(total, 1)
    cov = pairs / max(total, 1) - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(spread, spread))
    clusters = {i: [i] for i in range(BITS)}
    home = list(range(BITS))
    strongest = sorted(itertools.combinations(range(BITS), 2), key=lambda p: -corr[p])
    for i, j in strongest:
        a, b = home[i], home[j]
        if a != b and len(clusters[a]) + len(clusters[b]) <= BITS // 2:
            clusters[a] += clusters.pop(b)
            for k in clusters[a]:
                home[k] = a
    return [k for _, c in sorted(clusters.items(), key=lambda x: (-len(x[1]), x[0])) for k in c]


def cut_bits(order: list[int], parts: int) -> list[list[int]]:
    """``order`` cut into ``parts`` runs whose lengths differ by one at most."""
    edges = [round(k * BITS / parts) for k in range(parts + 1)]
    return [order[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def allocate(costs: list[list[float]], max_distance: int) -> tuple[float, list[int]]:
    """Thresholds, -1 for an unused partition, that sum with one each to ``max_distance + 1`` at least cost.

    ``costs[i][t]`` is the cost of partition ``i`` at threshold ``t``; a dynamic program over
    partitions and the threshold still to be given.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for given, (cost, chosen) in best.items():
            for t in range(-1, max_distance - given + 1):
                option = (cost + (row[t] if t >= 0 else 0.0), [*chosen, t])
                if given + t + 1 not in step or option < step[given + t + 1]:
                    step[given + t + 1] = option
        best = step
    return best[max_distance + 1]


def _mask(bits: list[int]) -> int:
    value = sum(1 << (BITS - 1 - b) for b in bits)
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _signature(part: int, mask: int) -> Column:
    return F.struct(F.lit(part).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key"))


def plan_partitions(fps: DataFrame, max_distance: int, most_parts: int | None = None) -> list[tuple[list[int], int]]:
    """Partitions of the bits and their thresholds, by counts over all distinct fingerprints.

    The driver gets 64 x 64 bit counts and one row per partition tried. A signature's count is
    exact; thresholds above zero scale it by the number of signatures within reach.
    """
    total = fps.count()
    order = bit_order(_bit_pairs(fps), total)
    tries = {m: cut_bits(order, m) for m in range(1, (most_parts or max_distance + 2) + 1)}
    parts = [p for m in tries for p in tries[m]]
    keys = fps.select(F.explode(F.array(*(_signature(i, _mask(p)) for i, p in enumerate(parts)))).alias("s"))
    sizes = keys.groupBy("s").agg(F.count("*").cast("double").alias("n"))
    pairs = F.sum(F.least(F.col("n") * (F.col("n") - 1) / 2, F.col("n") * (BITS + 1)))
    shared = {r["part"]: r["pairs"] for r in sizes.groupBy("s.part").agg(pairs.alias("pairs")).collect()}
    costs = []
    for i, part in enumerate(parts):
        reach = list(itertools.accumulate(comb(len(part), t) for t in range(max_distance + 1)))
        uniform = total * total / 2 / 2.0 ** len(part)
        costs.append([total * r + shared.get(i, 0.0) + uniform * (r - 1) for r in reach])
    best: tuple[float, list[int], list[list[int]]] | None = None
    at = 0
    for split in tries.values():
        cost, chosen = allocate(costs[at : at + len(split)], max_distance)
        at += len(split)
        if best is None or cost < best[0]:
            best = (cost, chosen, split)
    return [(part, t) for part, t in zip(best[2], best[1], strict=True) if t >= 0]


def _crowded_links(crowded: DataFrame, max_distance: int) -> DataFrame:
    """Links among members of crowded signatures, as a star around the least member at each meeting point.

    Two fingerprints within ``d`` bits share a point that is within ``ceil(d / 2)`` of both, and
    all that lie within ``d // 2`` of a point are within ``d`` of each other. For even ``d`` these
    agree, so each star holds links only and all of them; at most 1 + 64 + ... members share a point.
    """
    half = (max_distance + 1) // 2
    flips = [_mask(list(c)) for k in range(half + 1) for c in itertools.combinations(range(BITS), k)]
    points = crowded.select("fp", F.explode(F.array(*map(F.lit, flips))).alias("flip"))
    groups = points.groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).agg(F.collect_set("fp").alias("fps"))
    groups = groups.filter(F.size("fps") > 1)
    if max_distance % 2 == 0:
        return groups.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a != b")
    pairs = groups.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b")).filter("a > b")
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)


def fingerprint_links(fps: DataFrame, max_distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` whose closure is that of all pairs in reach.

    Every pair within ``max_distance`` is linked, or joined through links by way of a third
    fingerprint within the same distance of both; no other pair is linked.
    """
    plan = plan_partitions(fps, max_distance)
    own = F.explode(F.array(*(_signature(i, _mask(p)) for i, (p, _) in enumerate(plan)))).alias("s")
    index = fps.select("fp", own)
    sizes = index.groupBy("s").agg(F.count("*").alias("n"))
    counted = cut_lineage(index.join(sizes, "s").select("s.part", "s.key", "fp", (F.col("n") > crowd).alias("crowded")))
    spread = counted.filter(~F.col("crowded")).select("part", "key", F.col("fp").alias("b"))
    probes = []
    for i, (part, threshold) in enumerate(plan):
        flips = [_mask(list(c)) for k in range(threshold + 1) for c in itertools.combinations(part, k)]
        rows = counted.filter(F.col("part") == i)
        if threshold == 0:
            rows = rows.filter(~F.col("crowded"))  # its own signature is the only one it probes
        rows = rows.select("part", "key", F.col("fp").alias("a"))
        if threshold > 0:
            rows = rows.select("part", "a", F.explode(F.array(*map(F.lit, flips))).alias("flip"), "key")
            rows = rows.select("part", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), "a")
        probes.append(rows)
    probe = probes[0]
    for rows in probes[1:]:
        probe = probe.unionByName(rows)
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
    one_way = F.col("a") > F.col("b") if all(t == 0 for _, t in plan) else F.lit(True)
    found = probe.join(spread, ["part", "key"]).filter(near & one_way).select("a", "b")
    return found.unionByName(_crowded_links(counted.filter("crowded").select("fp").distinct(), max_distance))


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_distance: int = 2,
    crowd: int = CROWD,
) -> DataFrame:
    """Rows ``(id, fingerprint, component_id)``, one per row of ``docs``.

    Words are runs of other than ASCII white space after lower-casing A-Z; a text of fewer
    words than ``shingle`` is one shingle, one without words (empty or null) has fingerprint
    zero and links like any other. ``component_id`` is the smallest id reachable over links of at
    most ``max_distance`` bits; rows with a null id keep their fingerprint and take part, but a
    component of null ids only has a null ``component_id``. Repeated rows are returned as often as
    they come, an empty table gives an empty one, other columns are not read.
    """
    rows = cut_lineage(with_fingerprints(docs, id_col, text_col, shingle))
    fps = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("first")))
    groups = connected_components(fingerprint_links(fps.select("fp"), max_distance, crowd), "a", "b")
    named = fps.join(groups, fps.fp == groups.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    named = named.join(least, "c").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Column that names an id and a text while groups are formed.
OWN_KEY = "_id_and_text"


def keep_one_per_group(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without those that are not the first of their component; columns as they are.

    A document is an id and a text: rows that share an id but not the text are judged each for
    itself, and of rows that share both one stays. Rows with a null id are kept, as no group can be
    named by them.
    """
    id_col, text_col = settings.pop("id_col", "doc_id"), settings.pop("text_col", "text")
    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    key = F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), digest.alias("digest")))
    rows = docs.withColumn(OWN_KEY, key)
    found = simhash_components(rows, OWN_KEY, text_col, **settings)
    dropped = found.filter(F.col(OWN_KEY) != F.col("component_id")).select(OWN_KEY).distinct()
    kept = rows.filter(F.col(OWN_KEY).isNotNull()).join(dropped, OWN_KEY, "left_anti").dropDuplicates([OWN_KEY])
    return kept.select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
