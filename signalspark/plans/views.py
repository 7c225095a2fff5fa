"""Test views: the driver's tables in the shape of recordings.

Each view has a twin in ``sqlviews.py``.  Row numbers and rolling sums over one
supplier or user go through the sliced operators, so the views themselves stay
whole when one key owns a third of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalspark.context import cut_lineage
from signalspark.operators.slices import trailing_sums, with_row_number

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
CLOCK_SHIFT = -0.7
STEP_S = 0.02


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _bus_rows(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem in bus order: row number per supplier and 32-row rolling sums."""
    li = table(spark, sf, "lineitem").select(
        "l_suppkey",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        F.col("l_quantity").cast("int").alias("q"),
        F.round(F.col("l_discount") * 100).cast("int").alias("d"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("b4"),
    )
    numbered = with_row_number(
        li,
        ["l_suppkey"],
        ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
        F.floor(F.col("l_orderkey") / 4096),
    )
    return trailing_sums(
        numbered, ["l_suppkey"], "rn", {"raw": F.col("q") * 10, "sg": F.col("d") - 5}, 32
    )


def _pack(*cols: str):
    """Eight byte columns to an 8-byte BINARY, first byte most significant."""
    word = " | ".join(f"shiftleft(CAST({c} AS BIGINT), {8 * (7 - i)})" for i, c in enumerate(cols))
    return F.expr(f"unhex(lpad(hex({word}), 16, '0'))")


def frames_l(spark: SparkSession, sf: str) -> DataFrame:
    """A periodic 50 Hz bus: one arbitration id per supplier, five sessions."""
    w = _bus_rows(spark, sf)
    b = w.select(
        (F.col("l_suppkey") % 5).cast("string").alias("session_id"),
        (F.col("l_suppkey") + 256).alias("arb_id"),
        "rn",
        F.col("raw").cast("long").alias("raw"),
        F.expr("CAST((rn - 1) % 256 AS INT)").alias("b0"),
        F.expr("CAST(raw DIV 256 AS INT)").alias("b1"),
        F.expr("CAST(raw % 256 AS INT)").alias("b2"),
        F.lit(85).alias("b3"),
        "b4",
        F.expr("CAST((sg + 65536) % 256 AS INT)").alias("b5"),
        F.expr("CAST(((sg + 65536) % 65536) DIV 256 AS INT)").alias("b6"),
    ).withColumn("b7", F.expr("(b0 + b1 + b2 + b3 + b4 + b5 + b6) % 256"))
    t = (F.col("rn") - 1) * F.lit(STEP_S)
    return b.select(
        "session_id",
        t.alias("t_mono"),
        t.alias("t_utc"),
        F.lit("can0").alias("channel"),
        "arb_id",
        F.lit(False).alias("is_extended"),
        F.lit(8).cast("short").alias("dlc"),
        _pack("b0", "b1", "b2", "b3", "b4", "b5", "b6", "b7").alias("data"),
        F.lit("rx").alias("direction"),
        F.lit(None).cast("string").alias("probe_id"),
        F.col("rn").alias("row_seq"),
        "raw",
    )


def stored_frames(spark: SparkSession, sf: str) -> DataFrame:
    """``frames_l`` written once, for plans that read the recording several times."""
    return cut_lineage(frames_l(spark, sf), "frames")


def _frames(spark: SparkSession, sf: str, frames: DataFrame | None) -> DataFrame:
    return frames_l(spark, sf) if frames is None else frames


def refs_l(spark: SparkSession, sf: str, frames: DataFrame | None = None) -> DataFrame:
    """One reference per id of ``frames_l``, a sample per frame, on the companion clock."""
    return _frames(spark, sf, frames).select(
        "session_id",
        F.concat(F.lit("ref_"), F.col("arb_id")).alias("name"),
        (F.col("t_utc") + CLOCK_SHIFT).alias("t"),
        (F.col("raw") * 0.01).alias("v"),
        F.lit("").alias("unit"),
        F.lit("continuous").alias("kind"),
        F.lit("companion").alias("clock"),
    )


def frames_mux(spark: SparkSession, sf: str) -> DataFrame:
    """Multiplexed ids: byte 0 selects one of three bands carried in byte 1."""
    w = _bus_rows(spark, sf)
    b = w.select(
        (F.col("l_suppkey") % 5).cast("string").alias("session_id"),
        (F.col("l_suppkey") + 256).alias("arb_id"),
        "rn",
        F.expr("CAST(rn % 3 AS INT)").alias("b0"),
        F.expr("CAST((rn % 3) * 80 + q AS INT)").alias("b1"),
        F.expr("q").alias("b2"),
        F.expr("d").alias("b3"),
    )
    t = (F.col("rn") - 1) * F.lit(STEP_S)
    zero = "0"
    return b.select(
        "session_id",
        t.alias("t_mono"),
        t.alias("t_utc"),
        "arb_id",
        F.expr("substring(unhex(lpad(hex(shiftleft(CAST(b0 AS BIGINT),24) | shiftleft(CAST(b1 AS BIGINT),16)"
               f" | shiftleft(CAST(b2 AS BIGINT),8) | b3), 8, '{zero}')), 1, 4)").alias("data"),
        F.lit("rx").alias("direction"),
        F.col("rn").alias("row_seq"),
    )


def series_e(spark: SparkSession, sf: str) -> DataFrame:
    """Irregular series with large gaps: one per user and event type."""
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_type").alias("name"),
        (F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)") / F.lit(1e6)).alias("t"),
        F.col("value").alias("v"),
        "event_id",
    )


def frames_e(spark: SparkSession, sf: str) -> DataFrame:
    """Sporadic frames: one id per user, payload from event id, value and props."""
    e = table(spark, sf, "events").select(
        "user_id",
        "event_id",
        (F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)") / F.lit(1e6)).alias("t"),
        F.expr("CAST(round(value * 100) AS INT)").alias("vi"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    data = F.expr(
        "unhex(lpad(hex(shiftleft(CAST(event_id % 256 AS BIGINT), 24)"
        " | shiftleft(CAST((vi DIV 256) % 256 AS BIGINT), 16)"
        " | shiftleft(CAST(vi % 256 AS BIGINT), 8) | CAST(k AS BIGINT)), 8, '0'))"
    )
    return e.select(
        (F.col("user_id") % 7).cast("string").alias("session_id"),
        (F.col("user_id") + 256).alias("arb_id"),
        F.col("t").alias("t_mono"),
        F.col("t").alias("t_utc"),
        data.alias("data"),
        F.lit(4).cast("short").alias("dlc"),
        F.when(F.col("event_id") % 10 == 0, "tx").otherwise("rx").alias("direction"),
        F.col("event_id").alias("row_seq"),
        (F.col("user_id") % 2 == 1).alias("is_extended"),
    )


def signals_l(spark: SparkSession, sf: str, frames: DataFrame | None = None) -> DataFrame:
    """The planted signal of every ``frames_l`` id as a series on the edge clock."""
    return _frames(spark, sf, frames).select(
        "session_id", "arb_id", F.col("t_mono").alias("t"), F.col("raw").cast("double").alias("v")
    )


def refs_by_id(spark: SparkSession, sf: str, frames: DataFrame | None = None) -> DataFrame:
    """``refs_l`` keyed by the id each reference was made from."""
    return refs_l(spark, sf, frames).select(
        "session_id", F.substring_index("name", "_", -1).cast("long").alias("arb_id"), "t", "v"
    )


def sensors_e(spark: SparkSession, sf: str) -> DataFrame:
    """Motion and location samples from events, seven sessions."""
    e = table(spark, sf, "events").select(
        "user_id", "event_id", "event_type",
        (F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)") / F.lit(1e6)).alias("t"),
        F.expr("CAST(round(value * 100) AS INT)").alias("vi"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    return e.select(
        (F.col("user_id") % 7).cast("string").alias("session_id"), "event_id", "event_type", "t", "k",
        F.expr("((vi % 71) - 35) / 100.0D").alias("acc_x"),
        F.expr("((vi % 53) - 26) / 100.0D").alias("acc_y"),
        F.expr("((vi % 37) - 18) / 100.0D").alias("acc_z"),
        F.expr("((k % 41) - 20) / 50.0D").alias("rot_z"),
        F.expr("CASE WHEN event_id % 20 = 0 THEN -1.0D ELSE (vi % 4000) / 100.0D END").alias("speed"),
    )


def samples_l(spark: SparkSession, sf: str) -> DataFrame:
    """Named diagnostic samples: every frame's signal, some values no number."""
    return frames_l(spark, sf).select(
        "session_id",
        (F.col("arb_id") * 10000000 + F.col("row_seq")).alias("pos"),
        F.expr("CASE arb_id % 4 WHEN 0 THEN 'vehicle_speed' WHEN 1 THEN 'engine_rpm' WHEN 2 THEN '' ELSE 'SOC' END").alias("name"),
        F.format_string("0x%02X", F.col("arb_id") % 256).alias("pid"),
        F.col("t_utc").alias("t"),
        F.expr("CASE WHEN (row_seq - 1) % 50 = 0 THEN 'n/a' ELSE CAST(raw AS STRING) END").alias("value"),
        F.expr("CASE arb_id % 4 WHEN 0 THEN 'km/h' WHEN 1 THEN 'rpm' ELSE NULL END").alias("unit"),
        "arb_id",
        "raw",
    )


def labels_e(spark: SparkSession, sf: str) -> DataFrame:
    """Dashboard, telltale and gear labels in one frame."""
    return sensors_e(spark, sf).select(
        "session_id", "event_id", "t",
        F.col("event_type").alias("field"), F.col("event_type").alias("name"),
        F.expr("CASE WHEN event_id % 17 = 0 THEN NULL ELSE speed END").alias("value"),
        F.expr("CAST(event_id % 2 AS INT)").alias("state"),
        F.expr("CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(k % 7 AS DOUBLE) END").alias("gear"),
    )


def car_hw_e(spark: SparkSession, sf: str) -> DataFrame:
    """Head-unit answers: kind and status by event number, payload as JSON text."""
    return sensors_e(spark, sf).select(
        "session_id", "event_id", "t",
        F.expr("element_at(array('energy','mileage','speed','model','compass'), CAST(event_id % 5 + 1 AS INT))").alias("kind"),
        F.expr("element_at(array('success','unavailable','unimplemented','error'), CAST((event_id DIV 5) % 4 + 1 AS INT))").alias("status"),
        F.expr("""CASE event_id % 5 WHEN 0 THEN concat('{"battery_percent":', k, ',"fuel_percent":', if(event_id % 2 = 0, 'null', CAST(k + 2 AS STRING)), ',"energy_low":false}')
            WHEN 1 THEN concat('{"odometer_meters":', event_id, '}') WHEN 2 THEN concat('{"raw_mps":', k + 1, ',"display_mps":', k + 2, '.5}')
            WHEN 3 THEN '{"make":null,"year":2020}' ELSE concat('{"x":', k, '}') END""").alias("data"),
    )


def _motion_l(spark: SparkSession, sf: str, frames: DataFrame | None) -> DataFrame:
    """A session's speed at 10 Hz: the mean of all its ids' frames of a step."""
    step = F.floor((F.col("row_seq") - 1) / 5)
    x = _frames(spark, sf, frames).groupBy("session_id", step.alias("step"))
    return x.agg(F.min("t_utc").alias("t"), (F.avg("raw") * 0.01).alias("v"))


def edge_speed_l(spark: SparkSession, sf: str, frames: DataFrame | None = None) -> DataFrame:
    """Vehicle-speed samples of each session (edge clock), some without a number."""
    return _motion_l(spark, sf, frames).select(
        "session_id", F.lit("vehicle_speed").alias("name"), "t",
        F.expr("CASE WHEN step % 10 = 0 THEN 'n/a' ELSE CAST(v AS STRING) END").alias("value"),
    )


def location_l(spark: SparkSession, sf: str, frames: DataFrame | None = None) -> DataFrame:
    """GPS speed of the same motion (companion clock), unknown on some rows."""
    return _motion_l(spark, sf, frames).select(
        "session_id", (F.col("t") + CLOCK_SHIFT).alias("t"),
        F.expr("CASE WHEN step % 20 = 0 THEN -1.0D ELSE v / 3.6D END").alias("speed"),
    )


def devices_n(spark: SparkSession, sf: str) -> DataFrame:
    """Devices of the five bus sessions with small clock offsets."""
    return table(spark, sf, "nation").select(
        F.expr("CAST(n_nationkey % 5 AS STRING)").alias("session_id"),
        F.col("n_nationkey").alias("pos"),
        F.expr("CASE WHEN n_nationkey % 2 = 0 THEN 'edge' ELSE 'companion' END").alias("role"),
        F.expr("(n_nationkey % 3) * 0.1D").alias("utc_offset_s"),
    )


def manifest_c(spark: SparkSession, sf: str) -> DataFrame:
    """One manifest per customer: vehicle, devices, streams, clock offsets."""
    c = table(spark, sf, "customer")
    off = "round(c_acctbal) * 0.001D"
    return c.select(
        F.expr("concat('s', CAST(c_custkey AS STRING))").alias("session_id"),
        F.expr("element_at(array('1.0.0','1.2','2.0.0','x'), CAST(CASE WHEN c_custkey % 50 = 7 THEN 3 WHEN c_custkey % 50 = 9 THEN 4 ELSE c_custkey % 2 + 1 END AS INT))").alias("schema_version"),
        (F.lit(1.7e9) + F.col("c_custkey")).alias("created_utc"),
        F.expr("map('make', c_mktsegment, 'model', CAST(c_nationkey AS STRING), 'year', CASE WHEN c_custkey % 3 = 0 THEN CAST(2000 + c_custkey % 20 AS STRING) END)").alias("vehicle"),
        F.expr(
            "array(named_struct('role','edge','utc_offset_s',c_nationkey * 0.001D),"
            f"named_struct('role','companion','utc_offset_s',{off}))"
        ).alias("devices"),
        F.expr(
            "array(named_struct('path','can/frames.parquet','kind','can_frames','rows',c_custkey * 10),"
            "named_struct('path','phone/motion.jsonl','kind','motion','rows',c_custkey * 3))"
        ).alias("streams"),
    )
