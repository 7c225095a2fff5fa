"""Series on a shared time grid: resampling, lag search, regression, information.

Series tables are long: keys, ``t``, ``v``.  Grids are described by one row per
grid key with ``t0`` and ``n`` points; a grid point is ``t0 + gi / hz`` and all
later joins are equi-joins on the integer ``gi``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from signalspark.functions import stats
from signalspark.operators.slices import with_next, with_previous

ORDER = "_seq"
#: Grid points of a run in which lags are searched.
LAG_RUN = 4096


def spans(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    return series.groupBy(*keys).agg(
        F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count(F.lit(1)).alias("n_samples")
    )


def common_grid(series_spans: DataFrame, keys: Sequence[str], hz: float) -> DataFrame:
    """Overlap of all series of a key; no row where they do not overlap."""
    g = series_spans.groupBy(*keys).agg(F.max("t_start").alias("t0"), F.min("t_end").alias("t1"))
    return g.filter(F.col("t1") > F.col("t0")).select(
        *keys, "t0", "t1", (F.floor((F.col("t1") - F.col("t0")) * F.lit(float(hz))) + 1).alias("n_grid")
    )


def grid_points(hz: float, after: Column, upto: Column, closed: Column) -> Column:
    """Grid indexes in ``(after, upto]``, or ``[after, upto]`` where ``closed``."""
    h = F.lit(float(hz))
    lo = F.greatest(F.floor((after - F.col("t0")) * h) - 1, F.lit(0))
    hi = F.least(F.floor((upto - F.col("t0")) * h) + 1, F.col("n_grid") - 1)
    idx = F.when(lo <= hi, F.sequence(lo, hi))
    at = lambda i: F.col("t0") + i / h
    return F.filter(idx, lambda i: (at(i) <= upto) & ((at(i) > after) | (closed & (at(i) >= after))))


def bracket(
    series: DataFrame,
    grid: DataFrame,
    keys: Sequence[str],
    grid_keys: Sequence[str],
    cols: Sequence[str],
    order: Sequence[str],
    hz: float,
    max_gap: float | None,
    slice_by: Column,
) -> DataFrame:
    """For every grid point the samples on both sides of it and the position between.

    Each pair of neighbouring samples emits the grid points it covers, so a
    series is shuffled once and a gap longer than ``max_gap`` emits none.  The
    first pair also covers a point at its left end.
    """
    x = with_previous(series, keys, order, ["t", *cols], slice_by, 2, grid.select(*grid_keys, "t0", "n_grid"), grid_keys)
    x = x.filter(F.col("t_p1").isNotNull())
    if max_gap is not None:
        x = x.filter(F.col("t") - F.col("t_p1") <= F.lit(float(max_gap)))
    x = x.withColumn(
        "gi", F.explode(grid_points(hz, F.col("t_p1"), F.col("t"), F.col("t_p2").isNull()))
    )
    frac = (F.col("t0") + F.col("gi") / F.lit(float(hz)) - F.col("t_p1")) / (F.col("t") - F.col("t_p1"))
    return x.select(
        *keys, "gi", frac.alias("frac"), *[F.col(f"{c}_p1").alias(f"{c}_lo") for c in cols],
        *[F.col(c).alias(f"{c}_hi") for c in cols],
    )


def resample(
    series: DataFrame,
    grid: DataFrame,
    keys: Sequence[str],
    grid_keys: Sequence[str],
    hz: float,
    max_gap: float | None = None,
    slice_s: float = 60.0,
    order: Sequence[str] = ("t",),
) -> DataFrame:
    """Linear interpolation onto the grid; points in long gaps or outside are absent."""
    b = bracket(
        series, grid, keys, grid_keys, ["v"], list(order), hz, max_gap, F.floor(F.col("t") / F.lit(float(slice_s)))
    )
    v = F.col("v_lo") + F.col("frac") * (F.col("v_hi") - F.col("v_lo"))
    return b.select(*keys, "gi", v.alias("v")).filter("v IS NOT NULL")


def _lag_moments(s: np.ndarray, m: np.ndarray, y: np.ndarray, my: np.ndarray) -> list[np.ndarray]:
    """n, means, squared deviations and co-deviation at every lag of one run.

    ``s`` and ``m`` are values and presence on the run, ``y`` and ``my`` those of
    the other series, longer at both ends by the largest lag; absent values are 0.
    """
    at = lambda x: sliding_window_view(x, len(s))
    n, sum_s, sum_ss = at(my) @ m, at(my) @ s, at(my) @ (s * s)
    sum_y, sum_sy, sum_yy = at(y) @ m, at(y) @ s, at(y * y) @ m
    d = np.maximum(n, 1.0)
    # what is left of equal values after rounding is no deviation
    flat = lambda q, total: np.where(q > 1e-11 * total, q, 0.0)
    return [
        n, sum_s / d, sum_y / d, flat(sum_ss - sum_s * sum_s / d, sum_ss), flat(sum_yy - sum_y * sum_y / d, sum_yy), sum_sy - sum_s * sum_y / d,
    ]


def lag_scores(
    ref: DataFrame, sig: DataFrame, pair: Sequence[str], hz: float, max_lag_s: float
) -> DataFrame:
    """Pearson r of every lag: ``sig(t)`` against ``ref(t + lag)``, both (pair, gi, v).

    A task holds one run of ``LAG_RUN`` grid points of a pair, and of the reference
    as many more at both ends as the largest lag has; all lags of a run come out of
    six masked products.  So a row is sent once, or twice near a border, whatever
    the number of lags.  Runs give moments, whose merge needs no large sums.
    """
    k = round(max_lag_s * hz)
    run = max(LAG_RUN, 2 * k + 1)
    names = ["k", "n", "ms", "my", "qs", "qy", "c"]
    place = lambda gi: F.floor(gi / F.lit(run)).cast("long")
    known = F.col("v").isNotNull()
    left = sig.filter(known).select(*pair, place(F.col("gi")).alias("run"), "gi", F.col("v").cast("double").alias("v"))
    halo = F.explode(F.sequence(place(F.col("gi") - k), place(F.col("gi") + k))).alias("run")
    right = ref.filter(known).select(*pair, halo, "gi", F.col("v").cast("double").alias("v"))
    both = left.withColumn("mine", F.lit(True)).unionByName(right.withColumn("mine", F.lit(False)))

    fields = [sig.schema[c] for c in pair]
    numbers = ", ".join(["k int", *(f"{c} double" for c in names[1:])])
    out = T.StructType(fields + T._parse_datatype_string(numbers).fields)
    arrow = to_arrow_schema(out)

    def score(gi: np.ndarray, v: np.ndarray, at: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        first = gi.min() if len(gi) else 0
        size = int(gi.max() - first) + 1 if len(gi) else 0
        near = (at >= first - k) & (at < first + size + k)
        at, w = at[near], w[near]
        if not size or not len(at):
            return [np.zeros(0)] * len(names)
        s, m, y, my = np.zeros(size), np.zeros(size), np.zeros(size + 2 * k), np.zeros(size + 2 * k)
        mid_s, mid_y = v.mean(), w.mean()
        s[gi - first], m[gi - first] = v - mid_s, 1.0
        y[at - first + k], my[at - first + k] = w - mid_y, 1.0
        n, ms, means_y, *rest = _lag_moments(s, m, y, my)
        ok = np.flatnonzero(n > 0)
        return [x[ok] for x in (np.arange(-k, k + 1, dtype=np.int32), n, ms + mid_s, means_y + mid_y, *rest)]

    def borders(t: pa.Table) -> np.ndarray:
        """Where the runs of a table begin."""
        new = np.zeros(len(t), bool)
        new[0] = True
        for c in (*pair, "run"):
            code = t[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def scored(t: pa.Table, start: np.ndarray) -> pa.RecordBatch:
        mine, gi, v = (t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("mine", "gi", "v"))
        out = []
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(t)], strict=True):
            own = mine[a:b]
            out.append(score(gi[a:b][own], v[a:b][own], gi[a:b][~own], v[a:b][~own]))
        of = pa.array(np.repeat(start, [len(x[0]) for x in out]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        keys = [t[c].combine_chunks().take(of) for c in pair]
        columns[0] = columns[0].astype(np.int32)
        return pa.RecordBatch.from_arrays([*keys, *map(pa.array, columns)], names=arrow.names)

    def scan(batches):
        held = None  # rows of a run that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            start = borders(t)
            last = int(start[-1])
            if last:
                yield scored(t.slice(0, last), start[:-1])
            held = t.slice(last)
        if held is not None:
            yield scored(held, np.zeros(1, np.int64))

    # as many tasks as the session shuffles to, however few bytes the runs have; many short runs come in one batch
    n, key = int(sig.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*pair, "run"]
    parts = both.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(scan, out)
    w = Window.partitionBy(*pair, "k")
    mean = lambda c: F.sum(F.col("n") * F.col(c)).over(w) / F.sum("n").over(w)
    x = parts.withColumn("ds", F.col("ms") - mean("ms")).withColumn("dy", F.col("my") - mean("my"))
    x = x.groupBy(*pair, "k").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("qs") + F.col("n") * F.col("ds") * F.col("ds")).alias("qs"),
        F.sum(F.col("qy") + F.col("n") * F.col("dy") * F.col("dy")).alias("qy"),
        F.sum(F.col("c") + F.col("n") * F.col("ds") * F.col("dy")).alias("c"),
    )
    spread = lambda q: F.sqrt(F.col(q) / F.col("n")) >= stats.STD_EPS
    r = F.when((F.col("n") >= 3) & spread("qs") & spread("qy"), F.col("c") / F.sqrt(F.col("qs") * F.col("qy"))).otherwise(F.lit(0.0))
    return x.select(*pair, "k", r.alias("r"), F.col("n").cast("long").alias("n"))


def best_lag(ref: DataFrame, sig: DataFrame, pair: Sequence[str], hz: float, max_lag_s: float) -> DataFrame:
    """Lag with the largest |r|; the smallest lag wins ties (r compared at 9 decimals)."""
    s = lag_scores(ref, sig, pair, hz, max_lag_s)
    best = F.max_by(F.struct("k", "r"), F.struct(F.round(F.abs("r"), 9), -F.col("k")))
    return s.groupBy(*pair).agg(best.alias("b")).select(
        *pair, (F.col("b.k") / F.lit(float(hz))).alias("lag"), F.col("b.r").alias("r")
    )


def linear_fit(joined: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    cx, cy = F.col(x), F.col(y)
    return joined.groupBy(*keys).agg(
        F.count(F.when(cx.isNotNull() & cy.isNotNull(), 1)).alias("n"),
        stats.slope(cx, cy).alias("scale"),
        stats.intercept(cx, cy).alias("offset"),
        stats.pearson(cx, cy).alias("r"),
    )


def mutual_information(joined: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", bins: int = 16) -> DataFrame:
    """Mutual information in nats from a square histogram over each side's range.

    ``I = log N + (sum c log c - sum a log a - sum b log b) / N`` with cell,
    row and column counts, so three small aggregates replace marginal joins.
    """
    d = joined.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rng = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"),
        F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy"),
    ).filter(
        (F.col("_n") >= bins * 2) & (F.col("_sx") >= stats.STD_EPS) & (F.col("_sy") >= stats.STD_EPS)
    )

    def cell(v: str, lo: str, hi: str) -> Column:
        pos = F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins)
        return F.least(pos, F.lit(bins - 1)).cast("int")

    # keys already hash the pairs, so the ranges join without another exchange of them
    c = (
        d.join(rng, list(keys))
        .select(*keys, cell(x, "_x0", "_x1").alias("bx"), cell(y, "_y0", "_y1").alias("by"))
        .groupBy(*keys, "bx", "by")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    per = c.groupBy(*keys).agg(
        F.sum("c").alias("N"),
        F.sum(F.col("c") * F.ln("c")).alias("_cells"),
        *[F.sum(F.when(F.col("bx") == i, F.col("c"))).alias(f"_a{i}") for i in range(bins)],
        *[F.sum(F.when(F.col("by") == i, F.col("c"))).alias(f"_b{i}") for i in range(bins)],
    )
    margin = sum(
        (F.coalesce(F.col(f"_{s}{i}") * F.ln(f"_{s}{i}"), F.lit(0.0)) for s in "ab" for i in range(bins)), F.lit(0.0)
    )
    return per.select(*keys, (F.ln("N") + (F.col("_cells") - margin) / F.col("N")).alias("mi"))


def _over(a: Column, b: Column) -> Column:
    """``a / b`` for ``b`` of 0 or more, infinite or NaN where it is 0."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def derivative(series: DataFrame, keys: Sequence[str], slice_s: float = 60.0, order: Sequence[str] = ("t",)) -> DataFrame:
    """dv/dt on an irregular grid: weighted central difference, one-sided at the ends.

    Between samples of equal time it is infinite or NaN, as floats divide.
    """
    by = F.floor(F.col("t") / F.lit(float(slice_s)))
    x = with_previous(series, keys, list(order), ["t", "v"], by)
    x = with_next(x.drop("slice_no", "slice_row"), keys, list(order), ["t", "v"], by).drop("slice_no")
    hs, hd = F.col("t") - F.col("t_p1"), F.col("t_n1") - F.col("t")
    inner = (
        hs * hs * F.col("v_n1") + (hd * hd - hs * hs) * F.col("v") - hd * hd * F.col("v_p1")
    )
    d = (
        F.when(F.col("t_p1").isNull() & F.col("t_n1").isNull(), 0.0)
        .when(F.col("t_p1").isNull(), _over(F.col("v_n1") - F.col("v"), hd))
        .when(F.col("t_n1").isNull(), _over(F.col("v") - F.col("v_p1"), hs))
        .otherwise(_over(inner, hs * hd * (hd + hs)))
    )
    return x.withColumn("dv", d).drop("t_p1", "v_p1", "t_n1", "v_n1")


def series_pairs(a: DataFrame, b: DataFrame, pair: Sequence[str]) -> DataFrame:
    """Two resampled sides of a pair joined on the grid index."""
    return a.select(*pair, "gi", F.col("v").alias("x")).join(b.select(*pair, "gi", F.col("v").alias("y")), [*pair, "gi"])


def top_pairs(scored: DataFrame, by: Sequence[str], r: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(F.round(F.abs(r), 9)))
    return scored.withColumn("_rk", F.rank().over(w)).filter(F.col("_rk") <= k).drop("_rk")
