"""How quality filters interact: who removes what, alone, in any order.

1. One pass over whole texts gives every document a mask of the filters it
   fails and a 128-bit hash of its text.
2. Counting-Bloom prepass: each task counts the cells its texts hash to, Spark
   merges the counts.  A text with a cell of its own is unique for certain.
3. Only texts whose cells all count twice or more are shuffled whole; grouping
   on their bytes gives the smallest id of equal texts.
4. Masks, completed by that, are counted per part.  A count per mask is
   additive, so every order of the filters is a sum over 32 numbers.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from signalspark.llm.tables import FILTER_BITS, bit_filter, store
from signalspark.llm.textmap import with_text_columns
from signalspark.operators.frames import attach

FILTERS = "ABCDE"
SHORT, WORN = 1, 2
LOUD, MARKED = 4, 8
COPY = 16
MASKS = 1 << len(FILTERS)
LEAST_WORDS = 200
#: Cells per text and table cells per row: two texts share both cells with a chance of some 1 in 70.
CELLS, ROOM = 2, 16
_UPPER = bytes(range(65, 91))
_MARKS = b"#$%&*|"
_INNER = bytes(range(128, 192))  # bytes of UTF-8 that begin no code point
_SIGN = 1 << 63


def failures(text: bytes) -> int:
    """Mask of the conditions that need no other text."""
    words = text.split()
    n = len(words)
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _INNER))
    return (
        SHORT * (n < LEAST_WORDS)
        | WORN * (100 * len(set(words)) < 50 * n)
        | LOUD * (100 * upper > 2 * points)
        | MARKED * (len(text.translate(None, _MARKS)) < len(text))
    )


def halves(text: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(text)
    return (h >> 64) - _SIGN, (h & (2 * _SIGN - 1)) - _SIGN


def flagged(documents: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """doc_id, row (unique), part, h1, h2, mask (without copies) of every row."""

    def task():
        def run(texts):
            bodies = [t or b"" for t in texts]
            hashes = [halves(b) for b in bodies]
            return [a for a, _ in hashes], [b for _, b in hashes], [failures(b) for b in bodies]

        return run

    x = documents.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.col(f"`{text}`").alias("text"),
    )
    return with_text_columns(x, task, "h1 long, h2 long, mask int", keep=["doc_id", "row", "part"], binary=True)


def local_counts(flags: DataFrame) -> DataFrame:
    """h1, h2, times: equal texts of a batch as one row, so a frequent text is a row per batch."""

    def run(batches):
        for batch in batches:
            got = pa.Table.from_batches([batch]).group_by(["h1", "h2"]).aggregate([([], "count_all")])
            yield from got.select(["h1", "h2", "count_all"]).rename_columns(["h1", "h2", "times"]).to_batches()

    return flags.select("h1", "h2").mapInArrow(run, "h1 long, h2 long, times long")


def cells(rows: int) -> list[Column]:
    """The cells of a text in a sketch for so many rows."""
    size = 1 << max(10, (rows * ROOM - 1).bit_length())
    return [F.pmod(F.xxhash64("h1", "h2", F.lit(i)), F.lit(size)) for i in range(CELLS)]


def possible_repeats(flags: DataFrame) -> DataFrame:
    """h1, h2 of texts that the counting sketch does not prove to be unique.

    The sketch is a table of cells and counts, merged as any sum, and as large
    as the input asks for; no task or broadcast holds it whole.
    """
    place = {f"c{i}": c for i, c in enumerate(cells(flags.count()))}
    texts = local_counts(flags).select("h1", "h2", "times", *[c.alias(name) for name, c in place.items()])
    # a text that hits one cell twice counts there once
    hit = texts.select("times", F.explode(F.array_distinct(F.array(*place))).alias("cell"))
    crowded = hit.groupBy("cell").agg(F.sum("times").alias("n")).filter("n > 1")
    for name in place:
        texts = texts.join(crowded.select(F.col("cell").alias(name)), name, "left_semi")
    return texts.select("h1", "h2").distinct()


def repeats(documents: DataFrame, possible: DataFrame, doc_id: str, text: str) -> DataFrame:
    """h1, h2, first_doc of texts that several rows have, compared byte by byte.

    Texts outside the filter of possible repeats are dropped where they are
    read; equal texts of a task combine before the shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(bit_filter(possible.select("h1")))

    @F.pandas_udf("boolean")
    def listed(h: pd.Series) -> pd.Series:
        bit = h.to_numpy() % FILTER_BITS
        return pd.Series((shared.value[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).astype(bool))

    def task():
        def run(texts):
            hashes = [halves(t or b"") for t in texts]
            return [t or b"" for t in texts], [a for a, _ in hashes], [b for _, b in hashes]

        return run

    x = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    x = with_text_columns(x, task, "body binary, h1 long, h2 long", keep=["doc_id"], binary=True).filter(listed("h1"))
    same = x.groupBy("body").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))
    return same.filter("n > 1").select("h1", "h2", "first_doc")


def mask_counts(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """part, mask, n, good, toxic: documents of a part that fail exactly the filters of a mask."""
    flags, _ = store(flagged(documents, doc_id, text, part), "flags")
    possible, _ = store(possible_repeats(flags), "possible")
    same, _ = store(repeats(documents, possible, doc_id, text), "repeats")
    label = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    x = attach(flags, same, ["h1", "h2"], "row", how="left", grows=True)
    x = x.withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("first_doc"), COPY).otherwise(0))
    x = attach(x.select("doc_id", "row", "part", "mask"), label, ["doc_id"], "row", how="left", grows=True)
    return x.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )


def orders() -> Column:
    """All orders of the filters with their steps, as one literal array."""
    steps = [
        (f"'{''.join(p)}'", k + 1, sum(1 << FILTERS.index(f) for f in p[:k]), 1 << FILTERS.index(p[k]))
        for p in permutations(FILTERS) for k in range(len(FILTERS))
    ]
    rows = ", ".join(f"struct({o} AS filter_order, {k} AS step, {b} AS before, {f} AS bit)" for o, k, b, f in steps)
    return F.expr(f"array({rows})")


def audit(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """Effect of five filters on every part, for all orders and steps.

    A document fails A with under 200 words, B with 100 * distinct words under
    50 * words, C with 100 * ``[A-Z]`` characters over 2 * code points, D with any of
    ``#$%&*|``, E with a text that a row with a smaller id has, in any part.
    Per part, ``filter_order`` and ``step``: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley; parts without losses have zeros.

    A null text is an empty one, a null part the empty string.  A null id is
    neither smaller nor larger than others, so such rows never fail E, nor do
    rows that repeat the smallest id; a null id has no labels.  Of several
    labels of an id, one of 1 is enough.  Other columns are ignored; no
    documents give no rows.
    """
    counts, _ = store(mask_counts(documents, labels, doc_id, text, part), "masks")
    # what passes all filters of a set, for the 32 sets
    passing = [
        F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(m) == 0, F.col(c)).otherwise(0)) for m in range(MASKS)]).alias(c)
        for c in ("n", "good", "toxic")
    ]
    alone = F.map_from_arrays(
        F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]),
        F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(len(FILTERS))]),
    ).alias("alone")
    parts = counts.groupBy("part").agg(*passing, alone)
    x = parts.select("*", F.explode(orders()).alias("o")).select("*", "o.*")
    after = F.col("before").bitwiseOR(F.col("bit"))

    def lost(c: str, before: Column, then: Column) -> Column:
        return F.element_at(c, before + 1) - F.element_at(c, then + 1)

    removed = lost("n", F.col("before"), after)
    fails = lost("n", F.lit(0), F.col("bit"))
    # each set of filters that may come first does so in so many orders
    size = len(FILTERS)
    weights = {m: factorial(m.bit_count()) * factorial(size - 1 - m.bit_count()) for m in range(MASKS) if m.bit_count() < size}
    first = F.map_from_arrays(F.array(*map(F.lit, weights)), F.array(*map(F.lit, weights.values())))
    free = F.filter(F.array(*map(F.lit, weights)), lambda m: m.bitwiseAND(F.col("bit")) == 0)
    shapley = F.aggregate(
        free, F.lit(0).cast("long"), lambda total, m: total + F.element_at(first, m) * lost("n", m, m.bitwiseOR(F.col("bit")))
    )
    return x.select(
        "part", "filter_order", "step",
        F.element_at("n", after + 1).alias("kept"),
        removed.alias("removed"),
        (fails - removed).alias("redundant"),
        F.element_at("alone", F.col("bit")).alias("unique_fails"),
        lost("good", F.col("before"), after).alias("good_lost"),
        lost("toxic", F.col("before"), after).alias("toxic_lost"),
        shapley.alias("shapley"),
    )
