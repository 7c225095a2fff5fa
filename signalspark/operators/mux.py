"""Multiplexor detection and extraction per selector value."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from signalspark.functions.payload import byte_at, byte_fields, field_label
from signalspark.operators import fieldblocks as fb
from signalspark.operators.fields import fits, plain_words, with_field, byte_spread, payload_bytes_of
from signalspark.operators.frames import KEY, attach, time_slice


def selector_bytes(steps: DataFrame, max_values: int = 16, min_frames: int = 32) -> DataFrame:
    """Byte positions with few values, and the ids' other bytes that vary."""
    spread = byte_spread(steps, 1).filter(F.col("total") >= min_frames)
    few = (F.col("distinct") >= 2) & (F.col("distinct") <= max_values)
    return (
        spread.groupBy(*KEY)
        .agg(
            F.collect_list(F.when(few, F.col("off"))).alias("selectors"),
            F.collect_list(F.when(F.col("distinct") > 1, F.col("off"))).alias("varying"),
        )
        .filter((F.size("selectors") > 0) & (F.size("varying") > 1))
    )


def ratio_sums(steps: DataFrame, selectors: DataFrame, max_values: int) -> DataFrame:
    """Sums of each varying byte per value of each selector byte; ``max_values`` bounds a selector's values.

    A byte with more values in some run of frames is no selector, so nothing is known of the
    selectors while the frames are read.
    """
    x, n_words = plain_words(steps)
    singles = [f for f in byte_fields(payload_bytes_of(steps), 1) if not f.signed]
    g = (
        fb.partial_ratios(x, KEY, singles, n_words, max_values)
        .groupBy(*KEY, "sel", "other", "sv")
        .agg(*[F.sum(c).alias(c) for c in "nsq"])
    )
    wanted = F.expr("array_contains(selectors, sel) AND array_contains(varying, other)")
    return g.join(selectors, KEY).filter(wanted).select(*KEY, "sel", "other", "sv", "n", "s", "q")


def correlation_ratios(steps: DataFrame, selectors: DataFrame, max_values: int = 256) -> DataFrame:
    """Share of each byte's variance that a selector byte explains (eta squared).

    One pass over the frames sums every other byte per (selector, value); both
    sums of squares follow from those few rows.
    """
    return _ratios(ratio_sums(steps, selectors, max_values)).drop("mux_values")


def _ratios(g: DataFrame) -> DataFrame:
    tot = g.groupBy(*KEY, "sel", "other").agg(
        F.sum("n").alias("tn"),
        F.sum("s").alias("ts"),
        F.sum("q").alias("tq"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between_raw"),
        F.collect_list("sv").alias("mux_values"),
    )
    mean_part = F.col("ts") * F.col("ts") / F.col("tn")
    total_ss = F.col("tq") - mean_part
    return tot.select(
        *KEY,
        "sel",
        "other",
        F.when(total_ss < 1e-9, 0.0).otherwise((F.col("between_raw") - mean_part) / total_ss).alias("eta2"),
        F.sort_array("mux_values").alias("mux_values"),
    )


def detect_multiplexor(steps: DataFrame, max_values: int = 16, min_score: float = 0.5) -> DataFrame:
    """Best selector byte of each id: highest explained share, first byte on ties."""
    eta = _ratios(ratio_sums(steps, selector_bytes(steps, max_values), max_values))
    score = eta.groupBy(*KEY, "sel").agg(F.max("eta2").alias("score"), F.first("mux_values").alias("mux_values"))
    score = score.filter(F.col("score") >= min_score)
    best = score.groupBy(*KEY).agg(
        F.max_by(F.struct("sel", "score", "mux_values"), F.struct(F.round("score", 12), -F.col("sel"))).alias("m")
    )
    return best.select(
        *KEY, F.col("m.sel").alias("mux_byte"), F.col("m.score").alias("score"), F.col("m.mux_values").alias("mux_values")
    )


def extract_multiplexed(steps: DataFrame, mux: DataFrame, max_width: int = 2, min_rows: int = 8) -> DataFrame:
    """Fields that vary within one selector value, the selector byte excluded."""
    fields = byte_fields(payload_bytes_of(steps), max_width)
    part = [*KEY, "mux_byte", "mux_value"]
    x = steps.select(*KEY, "size", "w", time_slice("t_mono").alias("slice_no"))
    x = attach(x, mux.select(*KEY, "mux_byte"), KEY, "slice_no").withColumn("mux_value", byte_at("w", "mux_byte").cast("int"))
    x, n_words = plain_words(x, 0, [F.col("mux_byte"), F.col("mux_value")])
    st = (
        fb.partial_stats(x.sortWithinPartitions(*part), part, fields, n_words, set())
        .groupBy(*part, "seq")
        .agg(F.sum("n").alias("n"), F.max("width").alias("width"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))
        .filter((F.col("n") >= min_rows) & (F.col("vmax") > F.col("vmin")))
    )
    st = with_field(st, fields).filter(fits()).filter("NOT (f.off <= mux_byte AND mux_byte < f.off + f.width)").drop("seq")
    label = F.format_string(
        "0x%X[m%d=%d][%d:%d]%s%s",
        "arb_id", "mux_byte", "mux_value", "f.off", F.col("f.off") + F.col("f.width"), "f.endian",
        F.when(F.col("f.signed"), "s").otherwise("u"),
    )
    return st.drop("width").withColumn("label", label)


def plain_candidate(mux_candidates: DataFrame) -> DataFrame:
    """The same field without its selector condition."""
    return mux_candidates.withColumn("plain_label", field_label(F.col("arb_id")))
