"""Order-dependent operators that never put one whole key into one task.

A recording key may own a third of all rows, so a plain
``Window.partitionBy(key)`` is avoided everywhere.  Rows of a key are cut into
slices (time slices, or runs of ``rows`` consecutive row numbers); windows run
inside a slice, and the little that crosses a border travels through a table
with one row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType


def spread(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Hash ``df`` by ``cols`` over the session's shuffle partitions.

    The number is given, so adaptive execution keeps it: rows may be few
    while each is about to be exploded into many fields.  The small sides of the
    joins below are hinted to merge: the big side is hashed and sorted already,
    and a broadcast of it would leave the work to the few tasks of the other.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def _part(df: DataFrame, keys: Sequence[str], last: str) -> list[str]:
    """Keys in sorting order: numbers first, since a sort tells rows apart by its first column cheaply."""
    return [*sorted(keys, key=lambda k: isinstance(df.schema[k].dataType, StringType)), last]


def _sliced(df: DataFrame, part: Sequence[str], slice_by: Column) -> DataFrame:
    """Rows with their slice.  The joins on ``part`` drop rows without one; said here, it holds for both
    their sides, which then share an exchange."""
    x = df.withColumn("slice_no", slice_by)
    for c in part:
        x = x.filter(F.col(c).isNotNull())
    return x


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    slice_by: Column,
    depth: int = 1,
    facts: DataFrame | None = None,
    facts_keys: Sequence[str] = (),
) -> DataFrame:
    """Add ``<col>_p1 .. <col>_p<depth>``: the values of the preceding rows of the key.

    ``slice_by`` must not decrease along ``order``.  The result keeps it as
    ``slice_no`` and numbers rows inside a slice as ``slice_row``.  ``facts`` (a row per
    ``facts_keys``, some of ``keys``) are joined to the borders of the slices and come
    along with these, so that rows need no other shuffle to meet them; rows without one are dropped.
    """
    part = _part(df, keys, "slice_no")
    x = spread(_sliced(df, part, slice_by), part)
    w = Window.partitionBy(*part).orderBy(*order)
    x = x.withColumn("slice_row", F.row_number().over(w))
    n = F.count(F.lit(1)).over(Window.partitionBy(*part))
    # all columns are kept, so that both sides of the join below read one and the same exchange
    rest = [c for c in df.columns if c not in cols and c not in part]
    last = (
        x.select(*part, "slice_row", *cols, *rest)
        .withColumn("_n", n)
        .filter(F.col("slice_row") > F.col("_n") - depth)
        .groupBy(*part)
        .agg(
            F.sort_array(F.collect_list(F.struct((-F.col("slice_row")).alias("_o"), *cols, *rest))).alias("_tail")
        )
    )
    across = Window.partitionBy(*keys).orderBy("slice_no")
    empty = F.expr("slice(_tail, 1, 0)")
    carry = F.concat(*[F.coalesce(F.lag("_tail", k).over(across), empty) for k in range(1, depth + 1)])
    borders = last.select(*part, carry.alias("_carry"))
    if facts is not None:
        borders = borders.join(facts, list(facts_keys))
    joined = x.join(borders.hint("merge"), part)
    for c in cols:
        for k in range(1, depth + 1):
            before = F.expr(f"get(_carry, {k} - slice_row).{c}")
            joined = joined.withColumn(
                f"{c}_p{k}", F.when(F.col("slice_row") > k, F.lag(c, k).over(w)).otherwise(before)
            )
    return joined.drop("_carry")


def with_next(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], slice_by: Column
) -> DataFrame:
    """Add ``<col>_n1``: the values of the following row of the key."""
    part = _part(df, keys, "slice_no")
    x = spread(_sliced(df, part, slice_by), part)
    w = Window.partitionBy(*part).orderBy(*order)
    firsts = x.groupBy(*part).agg(
        F.min_by(F.struct(*cols), F.struct(*order)).alias("_first")
    )
    across = Window.partitionBy(*keys).orderBy("slice_no")
    borders = firsts.select(*part, F.lead("_first").over(across).alias("_carry"))
    x = x.withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    joined = x.join(borders.hint("merge"), part)
    for c in cols:
        joined = joined.withColumn(
            f"{c}_n1", F.when(F.col("_last"), F.col(f"_carry.{c}")).otherwise(F.lead(c).over(w))
        )
    return joined.drop("_carry", "_last")


def with_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, name: str = "rn"
) -> DataFrame:
    """Dense row number per key: number inside the slice plus the rows before it."""
    part = _part(df, keys, "slice_no")
    sliced = _sliced(df, part, slice_by)
    x = spread(sliced, part)
    # counted before the shuffle: of the rows themselves only x crosses the network
    counts = sliced.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(*keys).orderBy("slice_no").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*part, F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return (
        x.withColumn("_in", inside)
        .join(before.hint("merge"), part)
        .withColumn(name, F.col("_before") + F.col("_in"))
        .drop("_in", "_before", "slice_no")
    )


def with_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    slice_by: Column,
) -> DataFrame:
    """Running totals per key: total inside the slice plus that of earlier slices."""
    part = _part(df, keys, "slice_no")
    x = df.withColumn("slice_no", slice_by)
    for name, c in sums.items():
        x = x.withColumn(name, c)
    x = spread(x, part)
    totals = x.groupBy(*part).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    across = Window.partitionBy(*keys).orderBy("slice_no").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *part, *[F.coalesce(F.sum(f"_t_{c}").over(across), F.lit(0)).alias(f"_b_{c}") for c in sums]
    )
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for c in sums:
        x = x.withColumn(f"_r_{c}", F.coalesce(F.sum(c).over(w), F.lit(0)))
    out = x.join(before.hint("merge"), part)
    for c in sums:
        out = out.withColumn(c, F.col(f"_b_{c}") + F.col(f"_r_{c}"))
    return out.drop(*[f"{p}{c}" for c in sums for p in ("_b_", "_r_")], "slice_no")


def trailing_sums(
    df: DataFrame, keys: Sequence[str], rn: str, sums: dict[str, Column], length: int, rows: int = 8192
) -> DataFrame:
    """Sums over the last ``length`` rows of a key, given a dense row number.

    Each run of ``rows`` consecutive numbers is one window partition; the
    ``length - 1`` rows before it are copied in, so no partition can outgrow
    ``rows + length``.
    """
    run = F.floor((F.col(rn) - 1) / rows)
    last_run = F.floor((F.col(rn) - 1 + length - 1) / rows)
    part = _part(df, keys, "_run")
    x = spread(df.withColumn("_run", F.explode(F.sequence(run, last_run))), part)
    w = Window.partitionBy(*part).orderBy(rn).rowsBetween(-(length - 1), 0)
    for name, c in sums.items():
        x = x.withColumn(name, F.sum(c).over(w))
    return x.filter(F.col("_run") == run).drop("_run")
