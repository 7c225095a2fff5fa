"""Which signal leads which: lag search between causes and effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from signalspark.context import cut_lineage
from signalspark.functions.payload import all_fields, word_count
from signalspark.operators import scoring
from signalspark.operators import tseries as ts
from signalspark.operators.align import on_companion_clock
from signalspark.operators.fields import payload_bytes_of
from signalspark.operators.frames import KEY, attach

MIN_GRID = 16


def causality_lead(
    cause: DataFrame, effect: DataFrame, pair: list[str], hz: float = 20.0, max_lead_s: float = 1.5, max_gap: float = 1.0,
    alignment: DataFrame | None = None,
) -> DataFrame:
    """Seconds by which ``cause`` leads ``effect``; (0, 0) when they barely overlap.

    Given ``alignment`` (session_id, delta), both have a column ``clock``, and
    samples on the edge clock are moved to the companion's first.
    """
    if alignment is not None:
        cause, effect = (on_companion_clock(x, alignment).select(*pair, "t", "v") for x in (cause, effect))
    both = ts.spans(cause, pair).unionByName(ts.spans(effect, pair))
    grid = ts.common_grid(both, pair, hz).filter(F.col("n_grid") >= MIN_GRID)
    c = ts.resample(cause, grid, pair, pair, hz, max_gap)
    e = ts.resample(effect, grid, pair, pair, hz, max_gap)
    found = ts.best_lag(e, c, pair, hz, max_lead_s)
    return both.select(*pair).distinct().join(found, pair, "left").select(
        *pair, F.coalesce("lag", F.lit(0.0)).alias("lead_s"), F.coalesce("r", F.lit(0.0)).alias("r")
    )


def command_candidates(
    history: DataFrame,
    candidates: DataFrame,
    effects: DataFrame,
    hz: float = 20.0,
    max_lead_s: float = 1.5,
    max_gap: float = 1.0,
    min_lead_s: float = 0.08,
    min_r: float = 0.6,
    top_k: int = 3,
    payload_bytes: int | None = None,
    alignment: DataFrame | None = None,
) -> DataFrame:
    """Candidates that lead an effect, the strongest ``top_k`` per effect.

    Every (id, effect) pair has its own grid; ids whose grids with an effect are the
    same share them, so an effect is resampled once per grid and not once per id.  An
    effect moved by a lag is a reference of its own, so all lags of all candidates of
    an id come out of the same matrix products as plain matching; it is moved inside the task.  Given
    ``alignment`` (session_id, delta), frames are moved from the edge clock to the
    companion's, on which the effects are.
    """
    k = round(max_lead_s * hz)
    if alignment is not None:
        moved = attach(history, alignment.select("session_id", "delta"), ["session_id"], "t_mono", how="left")
        at = [c for c in ("t_mono", "t_mono_p1", "t_mono_p2") if c in history.columns]
        history = moved.withColumns({c: F.col(c) + F.coalesce("delta", F.lit(0.0)) for c in at}).drop("delta")
    ids = history.groupBy(*KEY).agg(F.min("t_mono").alias("c0"), F.max("t_mono").alias("c1"))
    eff = effects.groupBy("session_id", "name").agg(
        F.min("t").alias("e0"), F.max("t").alias("e1"), F.min("v").alias("base")
    )
    number = Window.partitionBy("session_id").orderBy("name")
    pairs = (
        ids.join(candidates.select(*KEY).distinct(), KEY)
        .join(eff.withColumn("effect_no", F.row_number().over(number)), "session_id")
        .withColumn("t0", F.greatest("c0", "e0"))
        .withColumn("t1", F.least("c1", "e1"))
        .filter("t1 > t0")
        .withColumn("n_grid", F.floor((F.col("t1") - F.col("t0")) * F.lit(float(hz))) + 1)
        .filter(F.col("n_grid") >= MIN_GRID)
        .withColumn("group_id", F.concat_ws("|", "session_id", "effect_no", "t0", "n_grid"))
    )
    pairs = cut_lineage(pairs.select(*KEY, "name", "base", "t0", "n_grid", "group_id"), "pairs")
    shared = pairs.select("session_id", "name", "base", "t0", "n_grid", "group_id").distinct()
    # every id of a session meets every effect, on the grid of that pair
    grids = pairs.groupBy(*KEY).agg(F.collect_list(F.struct("group_id", "t0", "n_grid")).alias("g"))
    x = attach(
        history.filter(F.col("t_mono") - F.col("t_mono_p1") <= F.lit(float(max_gap))), grids, KEY, "t_mono"
    ).withColumn("g", F.explode("g"))
    x = x.withColumn("t0", F.col("g.t0")).withColumn("n_grid", F.col("g.n_grid"))
    x = x.withColumn(
        "gi", F.explode(ts.grid_points(hz, F.col("t_mono_p1"), F.col("t_mono"), F.col("t_mono_p2").isNull()))
    )
    payload_bytes = payload_bytes or payload_bytes_of(history)
    words = word_count(payload_bytes)
    frac = (F.col("t0") + F.col("gi") / F.lit(float(hz)) - F.col("t_mono_p1")) / (F.col("t_mono") - F.col("t_mono_p1"))
    fields = all_fields(payload_bytes)
    keep = candidates.select(*KEY, F.col("f.seq").alias("seq")).groupBy(*KEY).agg(*scoring.kept("seq", len(fields)))
    anchor = history.groupBy(*KEY).agg(*[F.min_by(f"big_{j}", "t_mono").alias(f"big_{j}_at") for j in range(words)])
    facts = keep.join(anchor, KEY)
    run = F.floor(F.col("gi") / F.lit(scoring.RUN_POINTS))
    left = scoring.packed_ids(
        x.select(
            *KEY, F.col("g.group_id").alias("group_id"), "n_grid", "gi", frac.alias("frac"), run.alias("run"),
            *[F.col(f"big_{j}_p1").alias(f"big_{j}_lo") for j in range(words)],
            *[F.col(f"big_{j}").alias(f"big_{j}_hi") for j in range(words)],
        )
    ).join(facts, KEY).drop("session_id")
    on_grid = attach(
        effects.select("session_id", "name", "t", "v"),
        shared.groupBy("session_id", "name").agg(F.collect_list("group_id").alias("groups")),
        ["session_id", "name"], "t",
    ).select(F.explode("groups").alias("group_id"), "t", "v")
    e = ts.resample(on_grid, shared.select("group_id", "t0", "n_grid"), ["group_id"], ["group_id"], hz, max_gap)
    ends = [F.floor((F.col("gi") + d) / F.lit(scoring.RUN_POINTS)) for d in (-k, k)]
    refs = e.join(shared.select("group_id", "base"), "group_id").select(
        "group_id", F.lit(0).alias("ref_no"), "gi", F.explode(F.sequence(*ends)).alias("run"),
        (F.col("v") - F.col("base")).alias("v"), F.lit(0.0).alias("slack"),
    )
    # each is read by several plans
    left, refs = cut_lineage(left, "id-points"), cut_lineage(scoring.packed_refs(refs), "ref-points")
    # below min_r no lag can be a result, so dropping those pairs early is exact
    scored = scoring.pair_scores(left, refs, fields, words, 3, min_r * 0.999, None, lags=k)
    best = F.max_by(F.struct("ref_no", "r"), F.struct(F.round(F.abs("r"), 9), -F.col("ref_no")))
    lead = scored.groupBy("group_id", "arb_id", "seq").agg(best.alias("b")).select(
        "group_id", "arb_id", "seq", ((F.col("b.ref_no") - k) / F.lit(float(hz))).alias("lead_s"), F.col("b.r").alias("r")
    ).filter((F.col("lead_s") > min_lead_s) & (F.abs("r") >= min_r))
    named = lead.join(pairs.select("group_id", *KEY, "name"), ["group_id", "arb_id"]).join(
        candidates.select(*KEY, F.col("f.seq").alias("seq"), "label"), [*KEY, "seq"]
    )
    w = Window.partitionBy("session_id", "name").orderBy(
        F.desc(F.round(F.abs("r"), 9)), F.desc("lead_s"), "arb_id", "seq"
    )
    return named.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k).select(
        "session_id", F.col("name").alias("effect"), "rank", "arb_id", "label", "lead_s", "r"
    )
