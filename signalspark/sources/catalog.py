"""Session catalogue, stream index, head-unit availability, unit normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GRAVITY = 9.80665
STATUS_ORDER = ["success", "unavailable", "unimplemented", "error"]


def stream_index(rows: DataFrame, t: str = "t_utc") -> DataFrame:
    """Rows and time span of every stream file."""
    return rows.groupBy("session_id", "path").agg(
        F.count(F.lit(1)).alias("rows"), F.min(t).alias("t_start_utc"), F.max(t).alias("t_end_utc")
    )


def manifest_json(index: DataFrame) -> DataFrame:
    """A session's stream entries as one JSON text."""
    entry = F.struct("path", "rows", "t_start_utc", "t_end_utc")
    return index.groupBy("session_id").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("streams"))


def vehicle_label(vehicle: str = "vehicle") -> Column:
    parts = [F.expr(f"nullif({vehicle}['{k}'], '')") for k in ("make", "model", "year")]
    label = F.concat_ws(" ", *parts)
    return F.when(label != "", label).otherwise("unknown")


def session_catalog(manifests: DataFrame) -> DataFrame:
    """One line per session; frames are the rows of its first frame stream."""
    first = F.get(F.filter("streams", lambda s: s["kind"] == "can_frames"), F.lit(0))["rows"]
    return manifests.select(
        "session_id", vehicle_label().alias("vehicle"), "created_utc", first.alias("frames"),
        F.size("streams").alias("streams"), F.size("devices").alias("devices"),
    )


def session_detail(manifests: DataFrame) -> DataFrame:
    return manifests.select("session_id", vehicle_label().alias("vehicle"), F.explode("streams").alias("s")).select(
        "session_id", "vehicle", "s.path", "s.kind", "s.rows"
    )


def hash_vin(vin: Column) -> Column:
    """Pseudonym of a vehicle number."""
    return F.concat(F.lit("sha256:"), F.sha2(F.upper(F.trim(vin)), 256))


def availability(car_hw: DataFrame) -> DataFrame:
    """Answers per kind and status."""
    return car_hw.groupBy("session_id", "kind").pivot("status", STATUS_ORDER).agg(F.count(F.lit(1)))


def overall_status(car_hw: DataFrame) -> DataFrame:
    """Best status an item ever had."""
    place = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))
    return car_hw.groupBy("session_id", "kind").agg(F.min_by("status", place).alias("status"))


def to_g(v: Column) -> Column:
    return v / F.lit(GRAVITY)


def vector_to_g(v: Column) -> Column:
    return F.transform(v, lambda x: x / F.lit(GRAVITY))


def counts_to_si(raw: Column, scale: float) -> Column:
    return raw * F.lit(float(scale))


def millis_to_utc(ms: Column) -> Column:
    return ms / F.lit(1000.0)
