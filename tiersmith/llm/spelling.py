"""Spelling variants by a trie-node pair dictionary.

Words one edit apart agree in what stands before and after the edit. All words hang in two tries,
one read forwards and one read backwards, whose nodes are numbered: a prefix is one number, a suffix
another. A word with its i-th character skipped is the pair (node before i, node after i), a word
cut before its i-th character the pair (node before i, node from i on). Two words with the same
skipped pair differ in that one character; a skipped pair equal to a cut pair is a character left
out. So equal pairs of integers are exactly the neighbours, and no texts are compared.

A pair is shared by at most one word per character that can fill the gap, and one that leaves it
out, so groups stay as small as the alphabet, however many words there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiersmith.session import cut_lineage

#: Node and word numbers that one part of the sorted words may use.
PART_BITS = 40


def common_prefix(a: str, b: str) -> int:
    """Characters that two words share at their start."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most - 1
    while low < high:  # the longest equal start, by halving
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes on the path of each sorted word, numbered where they first appear in this part."""
    part = TaskContext.get().partitionId()
    nodes = part << PART_BITS
    place, first, last, path = 0, None, "", []
    for batch in batches:
        rows = []
        for word in batch.column(0).to_pylist():
            kept = common_prefix(last, word)
            path = [*path[:kept], *range(nodes + 1, nodes + 1 + len(word) - kept)]
            nodes += len(word) - kept
            first = word if first is None else first
            shared = common_prefix(first, word)
            rows.append((word, part, place, shared, path))
            place, last = place + 1, word
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        names = ["word", "part", "place", "shared", "path"]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else []
        if rows:
            yield pa.RecordBatch.from_arrays(columns, names=names)


def number_nodes(words: DataFrame) -> DataFrame:
    """Rows ``(word, number, path)``: ``path[i]`` numbers the trie node of the first ``i + 1`` characters.

    ``words`` are distinct. They are sorted in ranges; a part numbers the nodes that it meets
    first, and takes over those that its first word shares with the parts before, which is one path
    per part. ``number`` rises in code-point order.
    """
    spark = words.sparkSession
    sorted_ = words.select("word").repartitionByRange("word").sortWithinPartitions("word")
    rows = cut_lineage(sorted_.mapInArrow(_paths, "word string, part int, place bigint, shared int, path array<bigint>"))
    # Two words per part of the shuffle, whose number the session sets.
    ends = rows.groupBy("part").agg(
        F.min_by("word", "place").alias("first"), F.max_by(F.struct("word", "path", "shared"), "place").alias("last")
    )
    earlier: tuple[str, list[int]] = ("", [])
    taken = []
    for row in sorted(ends.collect(), key=lambda r: r["part"]):
        over = earlier[1][: common_prefix(earlier[0], row["first"])]
        word, path, shared = row["last"]
        kept = over[: min(len(over), shared)]
        taken.append((row["part"], over))
        earlier = (word, kept + path[len(kept) :])
    carried = F.broadcast(spark.createDataFrame(taken, "part int, carried array<bigint>"))
    kept = F.least("shared", F.size("carried"))
    path = F.concat(F.slice("carried", F.lit(1), kept), F.slice("path", kept + 1, F.size("path") - kept))
    number = F.shiftleft(F.col("part").cast("long"), PART_BITS) + F.col("place")
    return rows.join(carried, "part").select("word", number.alias("number"), path.alias("path"))


def node_pairs(words: DataFrame) -> DataFrame:
    """Rows ``(before, after, skips, leads, number, n)``: every skipped and every cut pair of each word.

    ``words`` has ``word, number, n, path, back`` with the paths of both tries. ``skips`` tells a
    skipped pair from a cut one; ``leads`` marks the first of a run of equal characters, as leaving
    out any of a run gives the same word.
    """
    length = F.length("word")
    rows = words.select(
        "number", "n", "word",
        F.concat(F.array(F.lit(0).cast("long")), "path").alias("before"),
        F.reverse(F.concat(F.array(F.lit(0).cast("long")), "back")).alias("after"),
    )
    letters = F.split("word", "")
    leads = F.transform(
        F.sequence(F.lit(0), length - 1), lambda i: (i == 0) | (F.get("letters", i) != F.get("letters", i - 1))
    )
    skipped = rows.filter(length > 0).withColumn("letters", letters).select(
        "number", "n",
        F.inline(F.arrays_zip(
            F.slice("before", F.lit(1), length).alias("before"), F.slice("after", F.lit(2), length).alias("after"),
            leads.alias("leads"),
        )),
    )
    cut = rows.select("number", "n", F.inline(F.arrays_zip("before", "after")))
    names = ["before", "after", "skips", "leads", "number", "n"]
    return skipped.withColumn("skips", F.lit(True)).select(names).union(
        cut.withColumns({"skips": F.lit(False), "leads": F.lit(False)}).select(names)
    )


def neighbours(pairs: DataFrame) -> DataFrame:
    """Rows ``(number, n_near, best)`` per word: neighbours, and the one of most occurrences as ``(-n, number)``."""
    group = Window.partitionBy("before", "after")
    order = F.struct((-F.col("n")).alias("less"), "number")

    def least(which: Column) -> Column:
        return F.min(F.when(which, F.col("order"))).over(group)

    def count(which: Column) -> Column:
        return F.count_if(which).over(group)

    skips, leads = F.col("skips"), F.col("leads")
    seen = pairs.withColumn("order", order).withColumns({
        "n_skips": count(skips), "n_leads": count(leads), "n_cuts": count(~skips),
        "top": least(skips), "top_lead": least(leads), "top_cut": least(~skips),
    })
    seen = seen.withColumn("second", least(skips & (F.col("order") > F.col("top"))))
    other = F.when(F.col("order") == F.col("top"), F.col("second")).otherwise(F.col("top"))
    near = F.when(skips, F.col("n_skips") - 1 + F.when(leads, F.col("n_cuts")).otherwise(0)).otherwise(F.col("n_leads"))
    best = F.when(skips, F.least(other, F.when(leads, F.col("top_cut")))).otherwise(F.col("top_lead"))
    found = seen.select("number", near.alias("near"), best.alias("best")).filter("near > 0")
    return found.groupBy("number").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def follow(links: DataFrame) -> DataFrame:
    """Rows ``(number, root)`` for links ``(number, form)`` without circles: the end of each word's chain.

    Every round doubles the steps that a row has gone, and is written.
    """
    rows = cut_lineage(links.select("number", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while rows.filter("moved").limit(1).count():
        further = rows.select(F.col("number").alias("root"), F.col("root").alias("beyond"))
        rows = cut_lineage(
            rows.drop("moved").join(further, "root", "left").select(
                "number", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")
            )
        )
    return rows.drop("moved")


def count_words(words: DataFrame, least_chars: int = 6, least_count: int = 5) -> DataFrame:
    """Rows ``(word, n)`` for the distinct words of a column ``word`` that are long and frequent enough."""
    long_enough = words.filter(F.length("word") >= least_chars)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def spelling_variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """Each word of distinct ``(word, n)`` rows as ``(word, form, root, n, n_near, form_n)``.

    ``n_near`` counts the other words that one inserted, deleted or replaced code point away; the
    ``form`` is the one of largest ``n``, ties to the smaller in code-point order, if it occurs at
    least ``factor`` times as often, else null; ``root`` is the end of the chain of forms, the
    word itself if it has none. All neighbours are found, whatever the length of the word.

    Null words and counts below 1 are left out, an empty word is a word like any other, repeated
    words add up, an empty table gives an empty one, and other columns are not read. ``factor`` is 2 or more, so that
    chains of forms end.
    """
    if factor < 2:
        raise ValueError("a form occurs at least twice as often as its variant")
    known = words.filter(F.col("word").isNotNull() & (F.col("n") > 0)).groupBy("word").agg(F.sum("n").alias("n"))
    known = cut_lineage(known)
    forwards = number_nodes(known)
    backwards = number_nodes(known.select(F.reverse("word").alias("word")))
    backwards = backwards.select(F.reverse("word").alias("word"), F.col("path").alias("back"))
    numbered = cut_lineage(known.join(forwards, "word").join(backwards, "word"))
    near = neighbours(node_pairs(numbered))
    has_form = -F.col("best.less") >= factor * F.col("n")
    judged = cut_lineage(
        numbered.select("number", "word", "n").join(near, "number", "left").select(
            "number", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has_form, F.col("best.number")).alias("form"), F.when(has_form, -F.col("best.less")).alias("form_n"),
        )
    )
    links = judged.filter("form IS NOT NULL").select("number", "form")
    names = judged.select("number", "word")
    linked = (
        links.join(follow(links), "number")
        .join(names.select(F.col("number").alias("form"), F.col("word").alias("form_word")), "form")
        .join(names.select(F.col("number").alias("root"), F.col("word").alias("root_word")), "root")
        .select("number", "form_word", "root_word")
    )
    return judged.drop("form").join(linked, "number", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )
