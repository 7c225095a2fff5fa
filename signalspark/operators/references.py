"""Reference series built from sensor, diagnostic and label streams.

Every builder returns ``session_id, name, t, v, unit, kind, clock``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from signalspark.context import cut_lineage
from signalspark.operators import tseries as ts
from signalspark.operators.frames import attach

MIN_SAMPLES = 8
SERIES = ["session_id", "name"]

# Sample names that mean the same battery quantity.
EV_ALIASES = {
    "hybrid_battery_remaining": "hv_battery_soc",
    "ev_battery_soc": "hv_battery_soc",
    "soc": "hv_battery_soc",
    "hv_battery_current": "hv_battery_current",
    "hv_battery_voltage": "hv_battery_voltage",
}


def enough_samples(counted: DataFrame, minimum: int = MIN_SAMPLES) -> DataFrame:
    """Series with at least ``minimum`` samples."""
    return counted.filter(F.col("n") >= minimum)


def numeric(value: str = "value") -> Column:
    """A text or number as DOUBLE, NULL when it is no number."""
    return F.expr(f"try_cast({value} AS DOUBLE)")


def _series(df: DataFrame, parts: list[tuple[str, Column, str]], clock: str, kind: str = "continuous") -> DataFrame:
    """One row per sample and (name, expression, unit)."""
    cells = F.array(*[F.struct(F.lit(n).alias("name"), e.alias("v"), F.lit(u).alias("unit")) for n, e, u in parts])
    return df.select("session_id", "t", F.explode(cells).alias("s")).select(
        "session_id", F.col("s.name").alias("name"), "t", F.col("s.v").alias("v"), F.col("s.unit").alias("unit"),
        F.lit(kind).alias("kind"), F.lit(clock).alias("clock"),
    )


def _with_valid_speed(location: DataFrame) -> DataFrame:
    valid = location.filter("speed >= 0").select("session_id").distinct()
    return attach(location, valid, ["session_id"], "t").withColumn(
        "speed", F.when(F.col("speed") >= 0, F.col("speed"))
    )


def gps_references(location: DataFrame, slice_s: float = 60.0, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """Speed in m/s and km/h and its derivative; unknown speed stays NULL."""
    loc = _with_valid_speed(location)
    plain = _series(
        loc, [("gps_speed", F.col("speed"), "m/s"), ("gps_speed_kmh", F.col("speed") * 3.6, "km/h")], "companion"
    )
    d = ts.derivative(loc.withColumn("v", F.col("speed")), ["session_id"], slice_s, order)
    return plain.unionByName(_series(d, [("gps_accel_long", F.col("dv"), "m/s^2")], "companion"))


def edge_gps_references(location: DataFrame) -> DataFrame:
    loc = _with_valid_speed(location)
    return _series(
        loc, [("edge_gps_speed", F.col("speed"), "m/s"), ("edge_gps_speed_kmh", F.col("speed") * 3.6, "km/h")], "edge"
    )


def imu_references(motion: DataFrame, clock: str = "companion") -> DataFrame:
    """Acceleration magnitude, longitudinal acceleration, yaw rate."""
    p = "edge_" if clock == "edge" else ""
    mag = F.sqrt(sum((F.col(c) * F.col(c) for c in ("acc_y", "acc_z")), F.col("acc_x") * F.col("acc_x")))
    return _series(
        motion,
        [
            (f"{p}imu_accel_mag", mag, "g"),
            (f"{p}imu_accel_long", F.col("acc_x"), "g"),
            (f"{p}imu_yaw_rate", F.col("rot_z"), "rad/s"),
        ],
        clock,
    )


def regen_references(motion: DataFrame, clock: str = "companion") -> DataFrame:
    """Deceleration only: what braking could feed back."""
    name = "edge_regen_brake" if clock == "edge" else "regen_brake"
    return _series(motion, [(name, F.greatest(-F.col("acc_x"), F.lit(0.0)), "g")], clock)


def obd_references(samples: DataFrame) -> DataFrame:
    """One series per sample name; nameless samples are named after their PID."""
    named = samples.withColumn(
        "ref", F.coalesce(F.expr("nullif(name, '')"), F.concat(F.lit("pid_"), F.coalesce("pid", F.lit("?"))))
    ).withColumn("v", numeric()).filter("v IS NOT NULL")
    units = first_unit(samples)
    s = attach(
        named.select("session_id", "ref", "t", "v"), units.withColumnRenamed("name", "ref"), ["session_id", "ref"], "t", how="left"
    )
    return s.select(
        "session_id", F.concat(F.lit("obd_"), "ref").alias("name"), "t", "v",
        F.coalesce("unit", F.lit("")).alias("unit"), F.lit("continuous").alias("kind"), F.lit("edge").alias("clock"),
    )


def first_unit(samples: DataFrame) -> DataFrame:
    """Unit of the first sample carrying each name."""
    return (
        samples.filter(F.coalesce(F.col("name"), F.lit("")) != "")
        .groupBy(*SERIES)
        .agg(F.coalesce(F.min_by("unit", "pos"), F.lit("")).alias("unit"))
    )


def dashboard_references(labels: DataFrame) -> DataFrame:
    return labels.withColumn("v", numeric()).filter("v IS NOT NULL").select(
        "session_id", F.concat(F.lit("dash_"), F.coalesce("field", F.lit("?"))).alias("name"), "t", "v",
        F.lit("").alias("unit"), F.lit("continuous").alias("kind"), F.lit("companion").alias("clock"),
    )


def telltale_references(labels: DataFrame) -> DataFrame:
    return labels.select(
        "session_id", F.concat(F.lit("telltale_"), F.coalesce("name", F.lit("?"))).alias("name"), "t",
        F.coalesce("state", F.lit(0)).cast("double").alias("v"),
        F.lit("").alias("unit"), F.lit("event").alias("kind"), F.lit("companion").alias("clock"),
    )


def gear_references(labels: DataFrame) -> DataFrame:
    g = labels.filter("gear IS NOT NULL").withColumn("gear", F.col("gear").cast("double"))
    return _series(g, [("dash_gear", F.col("gear"), "gear")], "companion")


def ev_obd_references(samples: DataFrame) -> DataFrame:
    """Battery samples under their canonical names."""
    alias = F.create_map(*[F.lit(x) for kv in EV_ALIASES.items() for x in kv])
    s = samples.withColumn("canon", F.try_element_at(alias, F.lower("name"))).withColumn("v", numeric())
    return s.filter("canon IS NOT NULL AND v IS NOT NULL").select(
        "session_id", F.concat(F.lit("ev_"), "canon").alias("name"), "t", "v",
        F.lit("").alias("unit"), F.lit("continuous").alias("kind"), F.lit("edge").alias("clock"),
    )


def head_unit_references(car_hw: DataFrame) -> DataFrame:
    """Charge, fuel, odometer and speeds from successful head-unit answers."""
    ok = car_hw.filter("status = 'success'")
    # Kind and key of the answer, name and unit of the reference.
    fields = [
        ("energy", "battery_percent", "car_soc", "%"),
        ("energy", "fuel_percent", "car_fuel", "%"),
        ("mileage", "odometer_meters", "car_odometer_m", "m"),
        ("speed", "raw_mps", "car_speed_ms", "m/s"),
        ("speed", "display_mps", "car_display_speed_ms", "m/s"),
    ]
    out = []
    for kind, field, name, unit in fields:
        v = F.get_json_object("data", f"$.{field}").cast("double")
        out.append(_series(ok.filter(F.col("kind") == kind).withColumn("_v", v).filter("_v IS NOT NULL"),
                           [(name, F.col("_v"), unit)], "companion"))
    return reduce(DataFrame.unionByName, out)


def build_references(families: list[DataFrame], minimum: int = MIN_SAMPLES) -> DataFrame:
    """All families together, series with too few samples left out.

    Where families have a series of the same name in a session, that of the last one counts, if it has
    enough samples; the samples of the others do not mix with it.
    """
    s = reduce(DataFrame.unionByName, [f.withColumn("_family", F.lit(i)) for i, f in enumerate(families)])
    enough = enough_samples(s.groupBy(*SERIES, "_family").agg(F.count(F.lit(1)).alias("n")), minimum)
    # one row per series; stored, its size is known, and samples need no shuffle to meet a small table
    last = cut_lineage(enough.groupBy(*SERIES).agg(F.max("_family").alias("_last")), "families")
    return attach(s, last, SERIES, "t").filter("_family = _last").drop("_family", "_last")
