"""Frame grouping, cadence and message census."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from signalspark.context import cut_lineage
from signalspark.functions.payload import ascii_preview, to_bytes
from signalspark.operators.slices import with_previous

KEY = ["session_id", "arb_id"]
SLICE_S = 60.0


def organic(frames: DataFrame) -> DataFrame:
    """Received traffic only: what the recorder itself sent is left out."""
    return frames.filter(F.col("direction") == "rx")


def time_slice(t: str = "t_mono", seconds: float = SLICE_S) -> Column:
    return F.floor(F.col(t) / F.lit(float(seconds)))


def attach(
    big: DataFrame, small: DataFrame, keys: Sequence[str], spread: str, copies: int = 8, how: str = "inner", grows: bool = False
) -> DataFrame:
    """Join per-key facts onto many rows without gathering a key in one task.

    The small side is copied ``copies`` times and rows of a key are dealt over
    the copies by ``spread``.  The salt is part of the join key, so adaptive
    execution may still broadcast a side it measured to be small, and may split
    partitions that stay too large.  The size of a stored table is that of its packed files,
    without the copies: a side that ``grows`` with the rows is never broadcast.
    """
    salt = F.pmod(F.xxhash64(F.col(spread)), F.lit(copies)).cast("int")
    left = big.withColumn("_salt", salt)
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    if grows:
        right = right.hint("merge")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def payload_width(frames: DataFrame) -> DataFrame:
    """Widest payload of every id, in bytes."""
    return frames.groupBy(*KEY).agg(F.max(F.octet_length("data")).alias("width"))


def padded(frames: DataFrame) -> DataFrame:
    """Every payload padded with zero bytes to the widest of its id."""
    wide = attach(frames, payload_width(frames), KEY, "t_mono")
    return wide.withColumn("data", F.expr("rpad(data, width, X'00')"))


#: Buckets of a range per round, and distinct values that may be ranked at once.
BUCKETS = 1024
RANKED = 8192


def exact_median(df: DataFrame, keys: Sequence[str], value: str, ranked: int = RANKED) -> DataFrame:
    """Exact median per key by narrowing down the range that holds its rank.

    Values are counted once, combined before the shuffle, and stored.  A round counts the buckets of a
    key's range and goes on in the one that holds the rank, between the smallest and the largest value
    found there; when at most ``ranked`` distinct values are left, they are
    ranked.  So no task orders more values of a key than that, however close together they lie.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = cut_lineage(counts, "values")
    span = [F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_rows"), F.sum("_n").alias("_sum")]
    state = counts.groupBy(*keys).agg(*span).select(
        *keys, "_lo", "_hi", "_rows", F.floor((F.col("_sum") + 1) / 2).alias("_rank"), (F.col("_sum") % 2 == 0).alias("_even")
    )
    state = cut_lineage(state, "ranges")

    def inside(ranges: DataFrame) -> DataFrame:
        return attach(counts, ranges, keys, "_v").filter("_v BETWEEN _lo AND _hi")

    while not state.filter(F.col("_rows") > ranked).isEmpty():
        wide = state.filter(F.col("_rows") > ranked)
        part = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BUCKETS), F.lit(BUCKETS - 1))
        buckets = inside(wide).groupBy(*keys, "_rank", "_even", part.alias("_b")).agg(*span)
        upto = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_b"))
        held = buckets.withColumn("_before", upto - F.col("_sum")).filter("_before < _rank AND _rank <= _before + _sum")
        held = held.select(*keys, "_lo", "_hi", "_rows", (F.col("_rank") - F.col("_before")).alias("_rank"), "_even")
        state = cut_lineage(state.filter(F.col("_rows") <= ranked).unionByName(held), "ranges")
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v"))
    low = inside(state).withColumn("_cum", upto).filter("_cum - _n < _rank AND _rank <= _cum")
    low = cut_lineage(low.select(*keys, F.col("_v").alias("_low"), (F.col("_even") & (F.col("_cum") == F.col("_rank"))).alias("_two")), "lower")
    after = attach(counts, low.filter("_two"), keys, "_v").filter("_v > _low").groupBy(*keys).agg(F.min("_v").alias("_up"))
    return low.join(after, keys, "left").select(*keys, ((F.col("_low") + F.coalesce("_up", "_low")) / 2).alias("median"))


def frame_gaps(frames: DataFrame, slice_s: float = SLICE_S) -> DataFrame:
    """Time to the preceding frame of the same id; NULL on its first frame.  A frame history knows it already."""
    if "t_mono_p1" in frames.columns:
        return frames.select(*KEY, "t_mono", (F.col("t_mono") - F.col("t_mono_p1")).alias("gap"))
    x = with_previous(
        frames.select(*KEY, "t_mono", "row_seq"),
        KEY,
        ["t_mono", "row_seq"],
        ["t_mono"],
        time_slice("t_mono", slice_s),
    )
    return x.select(*KEY, "t_mono", (F.col("t_mono") - F.col("t_mono_p1")).alias("gap"))


def period_estimate(frames: DataFrame, slice_s: float = SLICE_S) -> DataFrame:
    """Median inter-frame gap per id, 0 for a single frame."""
    gaps = frame_gaps(frames, slice_s)
    med = exact_median(gaps, KEY, "gap").withColumnRenamed("median", "period_s")
    ids = gaps.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    return ids.join(med, KEY, "left").withColumn("period_s", F.coalesce("period_s", F.lit(0.0)))


def message_roles(frames: DataFrame, cv_periodic: float = 0.25, slice_s: float = SLICE_S) -> DataFrame:
    """Cadence class of every id; counts sent frames as well."""
    g = (
        frame_gaps(frames, slice_s)
        .groupBy(*KEY)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("gap").alias("mean_gap"),
            F.stddev_pop("gap").alias("std_gap"),
        )
    )
    few = F.col("n") < 3
    cv = F.when(few, 0.0).when(F.col("mean_gap") > 0, F.col("std_gap") / F.col("mean_gap")).otherwise(1.0)
    return g.select(
        *KEY,
        "n",
        F.when(few, 0.0).otherwise(F.col("mean_gap") * 1000.0).alias("period_ms"),
        cv.alias("jitter"),
        F.when(few, "on_demand").when(cv <= cv_periodic, "periodic").otherwise("sporadic").alias("role"),
    )


def byte_ranges(frames: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Smallest and largest value of every byte position."""
    return (
        frames.select(*keys, F.posexplode(to_bytes("data")).alias("pos", "byte"))
        .groupBy(*keys, "pos")
        .agg(F.min("byte").alias("lo"), F.max("byte").alias("hi"))
    )


def message_census(frames: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Count, period, width, changing bytes and last payload of every received id.

    A byte counts as changing when some frame differs there from the first
    frame; since the first frame is one of those compared, that is the same as
    its minimum and maximum differing, which needs no join back to the frames.
    """
    rx = organic(frames)
    order = F.struct("t_mono", "row_seq")
    base = rx.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("t_mono").alias("t_first"),
        F.max("t_mono").alias("t_last"),
        F.max(F.octet_length("data")).alias("dlc"),
        F.min_by(F.octet_length("data"), order).alias("first_len"),
        F.max_by("data", order).alias("last_data"),
        F.max_by("is_extended", order).alias("is_extended"),
    )
    changing = (
        byte_ranges(rx, keys)
        .filter(F.col("lo") < F.col("hi"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("pos")).alias("_changing"))
    )
    j = base.join(changing, list(keys), "left")
    in_first = F.filter(F.coalesce("_changing", F.array().cast("array<int>")), lambda p: p < F.col("first_len"))
    span = F.col("t_last") - F.col("t_first")
    return j.select(
        *keys,
        F.when(F.col("is_extended"), F.format_string("0x%08X", "arb_id"))
        .otherwise(F.format_string("0x%03X", "arb_id"))
        .alias("arb_hex"),
        "is_extended",
        "n",
        F.when((F.col("n") > 1) & (span > 0), F.round(span / (F.col("n") - 1) * 1000.0, 3)).alias("period_ms"),
        "dlc",
        in_first.alias("changing_bytes"),
        F.lower(F.hex("last_data")).alias("sample_hex"),
        ascii_preview(to_bytes("last_data")).alias("sample_ascii"),
    )
