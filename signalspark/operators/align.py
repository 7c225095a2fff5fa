"""Clock alignment between the edge recorder and the companion device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from signalspark.operators import tseries as ts
from signalspark.operators.frames import attach

SESSION = ["session_id"]
# How an alignment was found, as the result format names it.
METHOD_PRIOR = "manifest_prior"
METHOD_XCORR = "xcorr(obd_speed,gps_speed)"


def manifest_prior(devices: DataFrame) -> DataFrame:
    """Companion minus edge clock offset; the last device of a role counts."""
    def last(role: str) -> Column:
        return F.coalesce(
            F.max_by("utc_offset_s", F.when(F.col("role") == role, F.col("pos"))), F.lit(0.0)
        )

    return devices.groupBy(*SESSION).agg((last("companion") - last("edge")).alias("prior"))


def edge_obd_speed(samples: DataFrame, minimum: int = 8) -> DataFrame:
    """Numeric vehicle-speed samples of sessions that have enough of them."""
    s = samples.filter(F.col("name") == "vehicle_speed").select(
        *SESSION, "t", F.expr("try_cast(value AS DOUBLE)").alias("v")
    ).filter("v IS NOT NULL")
    enough = s.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum)
    return attach(s, enough, SESSION, "t").drop("_n")


def gps_speed_kmh(location: DataFrame) -> DataFrame:
    """GPS speed in km/h, NULL where unknown; sessions without any valid speed are left out."""
    valid = location.filter("speed >= 0").select(*SESSION).distinct()
    s = location.select(*SESSION, "t", F.when(F.col("speed") >= 0, F.col("speed") * F.lit(3.6)).alias("v"))
    return attach(s, valid, SESSION, "t")


def align_by_markers(markers: DataFrame, edge_motion: DataFrame, max_lag_s: float = 5.0) -> DataFrame:
    """Offset from the first sync marker to the hardest deceleration near it.

    The window is an equi-join on time buckets as wide as the window, so only
    samples near a marker meet it.
    """
    width = F.lit(2.0 * max_lag_s)
    first = markers.groupBy(*SESSION).agg(F.min_by(F.struct("t", "kind"), "pos").alias("m"))
    first = first.select(*SESSION, F.col("m.t").alias("marker_t"), F.col("m.kind").alias("kind"))
    first = first.withColumn(
        "bucket",
        F.explode(
            F.sequence(
                F.floor((F.col("marker_t") - max_lag_s) / width), F.floor((F.col("marker_t") + max_lag_s) / width)
            )
        ),
    )
    near = (
        edge_motion.select(*SESSION, "t", "acc_x", F.floor(F.col("t") / width).alias("bucket"))
        .join(first, [*SESSION, "bucket"])
        .filter(F.abs(F.col("t") - F.col("marker_t")) <= max_lag_s)
    )
    hit = near.groupBy(*SESSION, "marker_t", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("acc_x", "t")).alias("hit")
    ).filter("n >= 3")
    decel = -F.col("hit.acc_x")
    return hit.select(
        *SESSION,
        (F.col("marker_t") - F.col("hit.t")).alias("delta"),
        F.least(F.greatest(decel / F.lit(0.2), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.lit("sync_marker").alias("method"),
        "kind",
    )


def estimate_alignment(
    priors: DataFrame,
    edge_speed: DataFrame,
    gps_speed: DataFrame,
    hz: float = 10.0,
    max_lag_s: float = 5.0,
    min_grid: int = 16,
    max_gap: float = 2.0,
) -> DataFrame:
    """Clock delta per session from speed cross-correlation, else the manifest prior."""
    edge = attach(edge_speed, priors, SESSION, "t").withColumn("t", F.col("t") + F.col("prior")).drop("prior")
    both = ts.spans(edge, SESSION).unionByName(ts.spans(gps_speed, SESSION))
    grid = (
        both.groupBy(*SESSION)
        .agg(F.count(F.lit(1)).alias("_sides"), F.max("t_start").alias("t_start"), F.min("t_end").alias("t_end"))
        .filter("_sides = 2")
    )
    grid = ts.common_grid(grid, SESSION, hz).filter(F.col("n_grid") >= min_grid)
    ref = ts.resample(gps_speed, grid, SESSION, SESSION, hz, max_gap)
    sig = ts.resample(edge, grid, SESSION, SESSION, hz, max_gap)
    found = ts.best_lag(ref, sig, SESSION, hz, max_lag_s)
    return priors.join(found, SESSION, "left").select(
        *SESSION,
        (F.col("prior") + F.coalesce("lag", F.lit(0.0))).alias("delta"),
        F.coalesce(F.abs("r"), F.lit(0.0)).alias("confidence"),
        F.when(F.col("lag").isNull(), METHOD_PRIOR).otherwise(METHOD_XCORR).alias("method"),
    )


def on_companion_clock(series: DataFrame, alignment: DataFrame) -> DataFrame:
    """Edge-clock samples moved to the companion clock."""
    j = attach(series, alignment.select(*SESSION, "delta"), SESSION, "t", how="left")
    shift = F.when(F.col("clock") == "edge", F.coalesce("delta", F.lit(0.0))).otherwise(0.0)
    return j.withColumn("t", F.col("t") + shift).drop("delta")


def ping_offset(pings: DataFrame) -> DataFrame:
    """Offset from the ping with the shortest round trip: server time + rtt/2 - t1."""
    rtt = F.col("t1") - F.col("t0")
    p = pings.select(*SESSION, rtt.alias("rtt"), (F.col("t_server") + rtt / 2 - F.col("t1")).alias("offset"), "seq")
    return p.groupBy(*SESSION).agg(
        F.min_by(F.struct("offset", "rtt"), F.struct("rtt", "seq")).alias("b")
    ).select(*SESSION, F.col("b.offset").alias("offset"), F.col("b.rtt").alias("rtt"))


def utc_from_uptime(samples: DataFrame) -> DataFrame:
    """UTC from monotonic nanoseconds with one anchor per device (first wall - uptime)."""
    key = ["session_id", "device"]
    anchor = samples.groupBy(*key).agg(
        F.min_by(F.col("wall_s") - F.col("uptime_ns") / F.lit(1e9), "uptime_ns").alias("anchor")
    )
    return attach(samples, anchor, key, "uptime_ns").withColumn(
        "t_utc", F.col("anchor") + F.col("uptime_ns") / F.lit(1e9)
    )
