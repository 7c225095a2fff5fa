"""Candidate fields: enumeration, behaviour statistics, pruning, taxonomy.

Payloads meet their predecessors once per frame; a batch of such pairs gives the
statistics of all fields as column operations (``fieldblocks``), so what is
exchanged is one row per (id, field) and run of frames, never exploded values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from signalspark.context import cut_lineage
from signalspark.functions import stats
from signalspark.functions.payload import (
    Field,
    all_fields,
    big_words,
    byte_fields,
    decode,
    field_array,
    field_label,
    word_array,
    word_count,
)
from signalspark.operators import fieldblocks as fb
from signalspark.operators.frames import KEY, SLICE_S, attach, organic, time_slice
from signalspark.operators.slices import spread, with_previous

MIN_FRAMES = 8


def payload_bytes_of(df: DataFrame, *words: str) -> int:
    """Payload width of a history or of steps, as ``frame_words`` noted it on their words."""
    for c in words or ("w", "big_0"):
        if c in df.columns and "payload_bytes" in df.schema[c].metadata:
            return df.schema[c].metadata["payload_bytes"]
    raise ValueError("no payload width on the words; make them with frame_history, or give the width")


def frame_words(frames: DataFrame, rx_only: bool = True, pad: bool = True, payload_bytes: int | None = None) -> DataFrame:
    """Payload of each frame as ``big_<j>`` word columns, for statistics that need no predecessor.

    The width is that of the widest payload, read off the frames unless the
    caller knows it; it travels with the words, so every field of it is
    enumerated later.  Bytes past the end of a payload are zero in its words, up to the widest
    of its id; with ``pad`` they count as values, which is noted on ``size``.
    """
    f = organic(frames) if rx_only else frames
    if payload_bytes is None:
        payload_bytes = f.agg(F.max(F.octet_length("data"))).first()[0] or 1
    noted = {"payload_bytes": payload_bytes}
    return f.select(
        *KEY,
        "t_mono",
        "row_seq",
        F.octet_length("data").alias("size", metadata={"own": not pad}),
        *[c.alias(f"big_{j}", metadata=noted) for j, c in enumerate(big_words("data", payload_bytes))],
    )


def frame_history(
    frames: DataFrame, slice_s: float = SLICE_S, rx_only: bool = True, pad: bool = True, payload_bytes: int | None = None
) -> DataFrame:
    """Payload of each frame next to the two before it, as ``big_<j>`` word columns, see ``frame_words``.

    Field statistics, value counts and counter tests each read this, so plans
    that need several of them store it first.
    """
    f = frame_words(frames, rx_only, pad, payload_bytes)
    noted = {"payload_bytes": payload_bytes_of(f, "big_0")}
    big = [c for c in f.columns if c.startswith("big_")]
    x = with_previous(f, KEY, ["t_mono", "row_seq"], ["t_mono", *big], time_slice("t_mono", slice_s), depth=2)
    cols = [f"{c}{p}" for c in big for p in ("", "_p1", "_p2")]
    words = [F.col(c).alias(c, metadata=noted) for c in cols]
    size = F.col("size").alias("size", metadata={"own": not pad})
    return x.select(*KEY, "t_mono", "t_mono_p1", "t_mono_p2", "row_seq", size, *words)


def frame_steps(history: DataFrame) -> DataFrame:
    """Word arrays ``w``, ``w1``, ``w2`` of a frame and the two before it; of ``frame_words`` just ``w``."""
    big = [c for c in history.columns if c.startswith("big_") and not c.endswith(("_p1", "_p2"))]
    before = [
        word_array([f"{c}_p{k}" for c in big]).alias(f"w{k}") for k in (1, 2) if f"big_0_p{k}" in history.columns
    ]
    return history.select(
        *KEY,
        "t_mono",
        "row_seq",
        "size",
        word_array(big).alias("w", metadata={"payload_bytes": payload_bytes_of(history)}),
        *before,
    )


def explode_fields(steps: DataFrame, fields: list[Field], keep: list[str] | None = None) -> DataFrame:
    """One row per frame and field with value ``v``, previous ``v1``, before that ``v2``."""
    return (
        steps.withColumn("f", F.explode(field_array(fields)))
        .select(
            *KEY,
            *(keep or []),
            "size",
            "f",
            decode("w").alias("v"),
            decode("w1").alias("v1"),
            decode("w2").alias("v2"),
        )
    )


def plain_words(steps: DataFrame, before: int = 0, more: list[Column] | None = None) -> tuple[DataFrame, int]:
    """Steps with their words in plain columns, and how many words a payload has."""
    n = word_count(payload_bytes_of(steps))
    sides = [("w", "w"), ("q", "w1"), ("r", "w2")][: before + 1]
    words = [c for prefix, a in sides for c in fb.word_columns(prefix, a, n)]
    return steps.select(*KEY, *(more or []), "size", *words), n


def with_field(df: DataFrame, fields: list[Field]) -> DataFrame:
    """The field ``f`` of a number, looked up once per result row."""
    by_seq = {f.seq: f for f in fields}
    lookup = [by_seq.get(i, fields[0]) for i in range(max(by_seq) + 1)]
    return df.withColumn("f", F.element_at(field_array(lookup), F.col("seq") + 1))


def fits() -> Column:
    """Whether field ``f`` lies inside the widest payload of its id."""
    return F.col("f.off") + F.greatest(F.col("f.width"), F.lit(1)) <= F.col("width")


def _stats(steps: DataFrame, fields: list[Field], lagged: set[int]) -> DataFrame:
    """Ranges of the fields, and lag statistics of the ``lagged`` ones, in one pass."""
    x, n_words = plain_words(steps, 1)
    rows = fb.partial_stats(x, KEY, fields, n_words, lagged)
    aggs = [F.sum("n").alias("n"), F.max("width").alias("width"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax")]
    aggs.append(F.sum("n_flips").alias("n_flips"))
    if lagged:
        # sums of squares come in halves; as decimals they are exact
        aggs += [F.sum(c).alias(c) for c in fb.MOMENT_COLS]
    a = with_field(rows.groupBy(*KEY, "seq").agg(*aggs), fields)
    flips = F.when(F.col("n") > 1, F.col("n_flips") / (F.col("n") - 1)).otherwise(0.0)
    cols = [*KEY, "seq", "f", "n", "vmin", "vmax", flips.alias("flip_rate")]
    if lagged:
        def whole(c: str) -> Column:
            return F.col(c).cast("decimal(20,0)")

        def spread_of(n: str, s: str, s2: str, k: str) -> Column:
            """n * n times the (co)variance: an integer."""
            product = F.col(f"h{k}").cast("decimal(24,0)") * F.lit(1 << 32) + F.col(f"l{k}")
            return F.try_divide((whole(n) * product - whole(s) * whole(s2)).cast("double"), F.pow(F.col(n).cast("double"), 2))

        s0, s1 = F.sqrt(spread_of("n2", "sc", "sc", "c")), F.sqrt(spread_of("n1", "s1", "s1", "1"))
        lag = [
            F.least(s0, s1).alias("lag_std"),
            F.try_divide(spread_of("n2", "sc", "so", "x"), s0 * s1).alias("lag_corr"),
            spread_of("n0", "s0", "s0", "0").alias("variance"),
        ]
        has = F.col("seq").isin(sorted(lagged)) if lagged < {f.seq for f in fields} else F.lit(True)
        cols += [F.when(has, c).alias(n) for c, n in zip(lag, ("lag_std", "lag_corr", "variance"))]
    return a.filter(fits()).select(*cols)


def field_ranges(steps: DataFrame, fields: list[Field]) -> DataFrame:
    """Per id and field: rows, range and change rate."""
    return _stats(steps, fields, set())


def lag_stats(steps: DataFrame, fields: list[Field]) -> DataFrame:
    """Per id and field: correlation with the preceding value, and variance."""
    return field_stats(steps, fields).select(*KEY, "seq", "lag_std", "lag_corr", "variance")


def field_stats(steps: DataFrame, fields: list[Field]) -> DataFrame:
    return _stats(steps, fields, {f.seq for f in fields})


def counter_fields(steps: DataFrame, ranges: DataFrame, fields: list[Field]) -> DataFrame:
    """(id, field) pairs that step by one constant between wrap-arounds.

    ``ranges`` has one row per (id, field) with ``vmin``, ``vmax``.  A counter
    needs one nonzero step on more than 90 % of the steps shorter than half the
    range.  Counting every distinct step of every field would shuffle the
    exploded frames, so a bound is checked first: at most 10 % of the short
    steps may differ, each of those can spoil two neighbouring pairs, hence
    equal neighbouring steps >= short neighbouring pairs - 20 % of short steps,
    and zero steps stay below 10 %.  Each run of frames also counts one step that
    repeats in it; what these counts do not settle is counted exactly.
    """
    pairs = ranges.select(
        *KEY, F.col("f.seq").alias("seq"), (F.col("vmax") - F.col("vmin") + 1).alias("span")
    )
    x, n_words = plain_words(steps, 2, [time_slice("t_mono").alias("slice_no")])
    part = [*reversed(KEY), "slice_no"]
    wanted = pairs.groupBy(*KEY).agg(F.collect_list(F.struct("seq", "span")).alias("p"))
    heads = x.select(*part).distinct().join(wanted, KEY).select(*part, F.col("p.seq").alias("seqs"), F.col("p.span").alias("spans"))
    both = x.withColumn("is_frame", F.lit(True)).unionByName(heads.withColumn("is_frame", F.lit(False)), allowMissingColumns=True)
    both = spread(both, part).sortWithinPartitions(*part, "is_frame")
    rows = fb.partial_steps(both, part, fields, n_words)
    sums = ["n", "n_short", "n_zero", "n_near", "n_equal"]
    by_step = rows.groupBy(*KEY, "seq", "step").agg(*[F.sum(c).alias(c) for c in (*sums, "c")])
    counts = by_step.groupBy(*KEY, "seq").agg(*[F.sum(c).alias(c) for c in sums], F.max(F.struct("c", "step")).alias("top"))
    possible = counts.filter(
        (F.col("n") >= MIN_FRAMES)
        & (F.col("n_short") >= 4)
        & (F.col("n_zero") <= F.col("n_short") * 0.1)
        & (F.col("n_equal") + 1e-6 >= F.col("n_near") - F.col("n_short") * 0.2)
    )
    sure = (F.col("top.c") / F.col("n_short") > 0.9) & (F.col("top.step") != 0)
    possible = cut_lineage(possible.select(*KEY, "seq", F.col("top.step").alias("step"), sure.alias("sure")), "counters")
    found = possible.filter("sure").select(*KEY, "seq", "step")
    open_ = possible.filter("NOT sure")
    if open_.isEmpty():
        return found
    left = pairs.join(open_.select(*KEY, "seq"), [*KEY, "seq"], "left_semi")
    return found.unionByName(_counted_exactly(steps, left, fields))


def _counted_exactly(steps: DataFrame, pairs: DataFrame, fields: list[Field]) -> DataFrame:
    """The counters among the listed (id, seq, span), by counting every distinct short step."""
    exact = (
        _steps(_explode_attached(steps, pairs, fields))
        .filter("ok")
        .groupBy(*KEY, "seq", "d")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy(*KEY, "seq")
        .agg(F.sum("c").alias("total"), F.max(F.struct("c", "d")).alias("top"))
        .filter((F.col("top.c") / F.col("total") > 0.9) & (F.col("top.d") != 0))
    )
    return exact.select(*KEY, "seq", F.col("top.d").alias("step"))


def _explode_attached(steps: DataFrame, pairs: DataFrame, fields: list[Field]) -> DataFrame:
    """Frames times the listed fields of their id; ``pairs`` has (id, seq, span)."""
    per_id = pairs.groupBy(*KEY).agg(F.collect_list(F.struct("seq", "span")).alias("wanted"))
    x = attach(steps.select(*KEY, "t_mono", "w", "w1", "w2"), per_id, KEY, "t_mono")
    x = x.select(*KEY, "w", "w1", "w2", F.explode("wanted").alias("p"))
    x = with_field(x.withColumn("seq", F.col("p.seq")), fields)
    return x.select(
        *KEY, F.col("p.seq").alias("seq"), F.col("p.span").alias("span"),
        decode("w").alias("v"), decode("w1").alias("v1"), decode("w2").alias("v2"),
    )


def _steps(x: DataFrame) -> DataFrame:
    d, d1 = F.col("v") - F.col("v1"), F.col("v1") - F.col("v2")
    limit = F.col("span") * F.lit(0.5)
    return x.select(
        *KEY,
        "seq",
        "span",
        d.alias("d"),
        d1.alias("d1"),
        F.coalesce(F.abs(d) < limit, F.lit(False)).alias("ok"),
        F.coalesce(F.abs(d1) < limit, F.lit(False)).alias("ok1"),
    )


def _value_rows(steps: DataFrame, max_width: int, payload_bytes: int | None) -> DataFrame:
    """Occurrences of every value, also past the end of an id's payload; ``size`` is the widest payload seen."""
    groups = [f for f in byte_fields(payload_bytes or payload_bytes_of(steps), max_width) if f.endian == "BE" and not f.signed]
    x, n_words = plain_words(steps)
    rows = fb.partial_counts(x, KEY, groups, n_words, _own(steps), steps=False)
    return rows.groupBy(*KEY, "off", "width", "value").agg(F.sum("c").alias("c"), F.max("size").alias("size"))


def _own(steps: DataFrame) -> bool:
    """Whether a payload counts only as far as it goes itself (``pad=False``)."""
    return steps.schema["size"].metadata.get("own", False)


def value_counts(steps: DataFrame, max_width: int = 1, payload_bytes: int | None = None) -> DataFrame:
    """Occurrences of every value of every byte group of up to two bytes.

    Byte order and sign only rename values, so one count per (offset, width)
    serves all four variants of a field.  At most 65,536 values per group.
    """
    rows = _value_rows(steps, max_width, payload_bytes)
    wide = rows.groupBy(*KEY).agg(F.max("size").alias("widest"))
    return rows.join(wide, KEY).filter("off + width <= widest").select(*KEY, "off", "width", "value", "c")


def value_spread(counts: DataFrame) -> DataFrame:
    """Distinct values and entropy in bits per byte group."""
    return counts.groupBy(*KEY, "off", "width").agg(
        F.count(F.lit(1)).alias("distinct"),
        F.sum("c").alias("total"),
        stats.entropy_of_counts(F.col("c")).alias("entropy"),
    )


def byte_spread(steps: DataFrame, max_width: int = 1, payload_bytes: int | None = None) -> DataFrame:
    """``value_spread`` of the ``value_counts``; every frame is in every group, so a group knows its id's width."""
    rows = _value_rows(steps, max_width, payload_bytes)
    a = rows.groupBy(*KEY, "off", "width").agg(
        F.count(F.lit(1)).alias("distinct"),
        F.sum("c").alias("total"),
        stats.entropy_of_counts(F.col("c")).alias("entropy"),
        F.max("size").alias("widest"),
    )
    return a.filter("off + width <= widest").drop("widest")


def checksum_rule(spread_distinct: Column) -> Column:
    """One-byte fields without temporal structure and with many values."""
    return (
        (F.col("f.width") == 1)
        & (F.col("n") >= 16)
        & (F.col("lag_std") >= 1e-9)
        & (spread_distinct / F.col("n") > 0.6)
        & (F.abs("lag_corr") < 0.2)
    )


def candidates(
    steps: DataFrame,
    payload_bytes: int | None = None,
    max_width: int = 4,
    bits: bool = True,
    drop_counters: bool = True,
    drop_checksums: bool = True,
    max_toggle: float = 0.45,
) -> DataFrame:
    """Fields worth matching: constants, counters, checksums, busy bits removed."""
    payload_bytes = payload_bytes or payload_bytes_of(steps)
    fields = all_fields(payload_bytes, max_width, bits)
    # only one-byte fields can be checksums, so only they need lag statistics
    st = _stats(steps, fields, {f.seq for f in fields if f.width == 1} if drop_checksums else set())
    st = st.filter((F.col("n") >= MIN_FRAMES) & (F.col("vmax") > F.col("vmin")))
    st = cut_lineage(st.filter((F.col("f.width") > 0) | (F.col("flip_rate") <= max_toggle)), "ranges")
    if drop_counters:
        byte_ranges = st.filter("f.width > 0")
        counters = counter_fields(steps, byte_ranges, [f for f in fields if f.width > 0])
        st = st.join(counters.select(*KEY, "seq"), [*KEY, "seq"], "left_anti")
    if drop_checksums:
        distinct = byte_spread(steps, 1, payload_bytes).select(*KEY, "off", "distinct")
        singles = st.filter("f.width = 1").withColumn("off", F.col("f.off"))
        checksums = singles.join(distinct, [*KEY, "off"]).filter(checksum_rule(F.col("distinct")))
        st = st.join(checksums.select(*KEY, "seq"), [*KEY, "seq"], "left_anti").drop("lag_std", "lag_corr", "variance")
    return st.withColumn("label", field_label(F.col("arb_id")))


def byte_facts(steps: DataFrame, payload_bytes: int | None = None, max_width: int = 2) -> DataFrame:
    """Statistics, distinct values, entropy and counter flag of every byte field of up to two bytes."""
    payload_bytes = payload_bytes or payload_bytes_of(steps)
    fields = all_fields(payload_bytes, max_width, bits=False)
    st = cut_lineage(field_stats(steps, fields), "stats")
    distinct = byte_spread(steps, max_width, payload_bytes)
    counters = counter_fields(steps, st.filter("vmax > vmin"), fields).withColumn("is_counter", F.lit(True))
    return (
        st.withColumn("off", F.col("f.off"))
        .withColumn("width", F.col("f.width"))
        .join(distinct, [*KEY, "off", "width"])
        .join(counters, [*KEY, "seq"], "left")
    )


def byte_candidates(facts: DataFrame) -> DataFrame:
    """The ``candidates`` among whole bytes, from ``byte_facts``."""
    x = facts.filter((F.col("n") >= MIN_FRAMES) & (F.col("vmax") > F.col("vmin")) & F.col("is_counter").isNull())
    x = x.filter(~F.coalesce(checksum_rule(F.col("distinct")), F.lit(False)))
    return x.select(*KEY, "seq", "f", "n", "vmin", "vmax", "flip_rate").withColumn("label", field_label(F.col("arb_id")))


def classify(
    steps: DataFrame, payload_bytes: int | None = None, max_width: int = 2, switch_max_levels: int = 8
) -> DataFrame:
    """Behaviour class of every byte field of up to two bytes."""
    return byte_classes(byte_facts(steps, payload_bytes, max_width), switch_max_levels)


def byte_classes(x: DataFrame, switch_max_levels: int = 8) -> DataFrame:
    """Behaviour classes from ``byte_facts``."""
    ac1 = F.when((F.col("n") > 2) & (F.col("lag_std") > 1e-12), F.abs("lag_corr")).otherwise(0.0)
    constant = F.col("vmin") == F.col("vmax")
    label = (
        F.when(constant, "constant")
        .when(F.col("is_counter"), "counter")
        .when((F.col("flip_rate") >= 0.99) & (F.col("entropy") > 6.0) & (ac1 < 0.3), "checksum")
        .when(F.col("distinct") <= switch_max_levels, "switch")
        .otherwise("dynamic")
    )
    ratio = F.col("distinct") / F.col("n")

    def unless_constant(c: Column) -> Column:
        return F.when(constant, 0.0).otherwise(c)

    return x.select(
        *KEY,
        "f",
        "seq",
        "n",
        "variance",
        label.alias("behaviour"),
        unless_constant(F.col("flip_rate")).alias("flip_rate"),
        unless_constant(ratio).alias("distinct_ratio"),
        unless_constant(F.col("entropy")).alias("entropy"),
        unless_constant(F.col("flip_rate") * ratio).alias("theta"),
    )


def fingerprint_bytes(steps: DataFrame, payload_bytes: int | None = None) -> DataFrame:
    """Behaviour vector inputs per byte: entropy, change rate, counter and checksum flags."""
    singles = [f for f in byte_fields(payload_bytes or payload_bytes_of(steps), 1) if not f.signed]
    x, n_words = plain_words(steps, 1)
    c = (
        fb.partial_counts(x, KEY, singles, n_words, _own(steps), steps=True)
        .groupBy(*KEY, F.col("off").alias("pos"), "is_step", "value")
        .agg(F.sum("c").alias("c"), F.max("size").alias("size"))
    )
    value, step = F.when(~F.col("is_step"), F.col("c")), F.when(F.col("is_step"), F.col("c"))
    short = F.col("is_step") & (F.abs("value") < 128)
    a = c.groupBy(*KEY, "pos").agg(
        stats.entropy_of_counts(value).alias("entropy"),
        F.sum(value).alias("n"),
        F.max("size").alias("widest"),
        (F.sum(F.when(F.col("value") != 0, step).otherwise(0)) / F.sum(step)).alias("change_rate"),
        F.sum(F.when(short, F.col("c"))).alias("n_short"),
        F.max(F.when(short, F.struct("c", F.col("value").alias("d")))).alias("top"),
    )
    return a.filter("pos < widest").select(
        *KEY,
        "pos",
        "n",
        "entropy",
        F.coalesce("change_rate", F.lit(0.0)).alias("change_rate"),
        F.coalesce(
            (F.col("n") > 8)
            & (F.col("n_short") > 4)
            & (F.col("top.d") != 0)
            & (F.col("top.c") > F.col("n_short") * 0.9),
            F.lit(False),
        ).alias("counts"),
    )


def fingerprint_rows(bytes_: DataFrame, period: DataFrame) -> DataFrame:
    """One row per id; the last byte that counts is the counter byte.

    A checksum byte is a later or earlier byte than the counter found so far,
    so the test only excludes the byte itself.
    """
    noisy = (F.col("n") > 8) & (F.col("entropy") > 7.0) & (F.col("change_rate") > 0.6) & ~F.col("counts")
    a = bytes_.groupBy(*KEY).agg(
        F.max("n").alias("n_frames"),
        F.coalesce(F.max(F.when(F.col("counts"), F.col("pos"))), F.lit(-1)).alias("counter_byte"),
        F.coalesce(F.max(F.when(noisy, F.col("pos"))), F.lit(-1)).alias("checksum_byte"),
        F.sort_array(F.collect_list(F.struct("pos", "entropy", "change_rate"))).alias("_b"),
    )
    return a.join(period.select(*KEY, "period_s"), KEY).select(
        *KEY,
        "period_s",
        "n_frames",
        F.col("_b.entropy").alias("byte_entropy"),
        F.col("_b.change_rate").alias("byte_change"),
        "counter_byte",
        "checksum_byte",
    )


def fingerprint_vector(rows: DataFrame, width: int = 8) -> DataFrame:
    """Four scalars, then entropy and change rate padded to ``width`` bytes."""
    def fit(c: str) -> Column:
        return F.slice(F.concat(F.col(c), F.array_repeat(F.lit(0.0), width)), 1, width)

    head = F.array(
        F.col("period_s"),
        F.log1p(F.col("n_frames")),
        (F.col("counter_byte") >= 0).cast("double"),
        (F.col("checksum_byte") >= 0).cast("double"),
    )
    return rows.select(*KEY, F.concat(head, fit("byte_entropy"), fit("byte_change")).alias("vector"))
