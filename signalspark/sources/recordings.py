"""Readers and writers of recorded streams, many sessions at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signalspark import schemas


def frame_defaults(df: DataFrame) -> DataFrame:
    """Optional columns: UTC falls back to the monotonic time, 11-bit ids, received."""
    return df.select(
        "session_id", "t_mono", F.coalesce("t_utc", "t_mono").alias("t_utc"), "channel", "arb_id",
        F.coalesce("is_extended", F.lit(False)).alias("is_extended"),
        F.coalesce("dlc", F.octet_length("data").cast("smallint")).alias("dlc"), "data",
        F.coalesce("direction", F.lit("rx")).alias("direction"), "probe_id",
    )


def read_frames_parquet(spark: SparkSession, path: str) -> DataFrame:
    return frame_defaults(spark.read.schema(schemas.FRAMES).parquet(path))


def read_frames_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with hexadecimal payloads; blank lines carry no id and are skipped."""
    raw = spark.read.schema(schemas.FRAMES_JSON).json(path).filter("arb_id IS NOT NULL")
    return frame_defaults(raw.withColumn("data", F.unhex("data")))


def read_frames(spark: SparkSession, parquet: str, jsonl: str) -> DataFrame:
    """Parquet where a session has it, JSON lines for the other sessions."""
    p, j = read_frames_parquet(spark, parquet), read_frames_jsonl(spark, jsonl)
    return p.unionByName(j.join(p.select("session_id").distinct(), "session_id", "left_anti"))


def write_frames(frames: DataFrame, path: str) -> None:
    """Append frames, one folder per session."""
    frames.write.mode("append").partitionBy("session_id").parquet(path)


def write_frames_jsonl(frames: DataFrame, path: str) -> None:
    frames.withColumn("data", F.lower(F.hex("data"))).write.mode("append").json(path)


def import_frames(df: DataFrame, t: Column, arb_id: Column, data: Column, extended: Column, session_id: Column) -> DataFrame:
    """Any table with a time, an id and a payload as received frames."""
    return df.select(
        session_id.alias("session_id"), t.cast("double").alias("t_mono"), t.cast("double").alias("t_utc"),
        F.lit("can0").alias("channel"), arb_id.cast("long").alias("arb_id"), extended.alias("is_extended"),
        F.octet_length(data).cast("smallint").alias("dlc"), data.alias("data"), F.lit("rx").alias("direction"),
        F.lit(None).cast("string").alias("probe_id"),
    )


def import_motion(df: DataFrame, t: Column, acc: list[Column], rot: list[Column], session_id: Column) -> DataFrame:
    return df.select(
        session_id.alias("session_id"), t.cast("double").alias("t_utc"), F.array(*acc).alias("acc"), F.array(*rot).alias("rot")
    )


def flatten_motion(motion: DataFrame) -> DataFrame:
    """Vector columns to one column per axis, NULL where a vector is missing."""
    axes = [F.get(v, F.lit(i)).alias(f"{v}_{a}") for v in ("acc", "rot") for i, a in enumerate("xyz")]
    return motion.select("session_id", F.col("t_utc").alias("t"), *axes)


def read_motion(spark: SparkSession, path: str) -> DataFrame:
    return flatten_motion(spark.read.schema(schemas.MOTION).json(path))


def read_location(spark: SparkSession, path: str) -> DataFrame:
    return known_location(spark.read.schema(schemas.LOCATION).json(path))


def known_location(loc: DataFrame) -> DataFrame:
    """Speed and course use -1 for unknown in the files, NULL here."""
    known = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    return loc.select("session_id", F.col("t_utc").alias("t"), "lat", "lon", "alt", known("speed"), known("course"))


def major_version(version: str = "schema_version") -> Column:
    return F.expr(f"try_cast(split({version}, '[.]')[0] AS INT)")


def read_manifests(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Manifests; without a session id the folder's name is the id."""
    m = spark.read.schema(schemas.MANIFEST).option("multiLine", multi_line).json(path)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return m.withColumn("session_id", F.coalesce("session_id", folder))


def gate_version(manifests: DataFrame, major: int = 1, strict: bool = False) -> DataFrame:
    """Mark manifests of another or malformed major version; ``strict`` raises instead."""
    ok = F.coalesce(major_version() == major, F.lit(False))
    if strict:
        reason = F.concat(F.lit("unsupported schema_version "), F.coalesce("schema_version", F.lit("none")))
        return manifests.withColumn("accepted", F.when(ok, F.lit(True)).otherwise(F.raise_error(reason).cast("boolean")))
    return manifests.withColumn("accepted", ok)


def read_discovery(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DISCOVERY).json(path)


def discovery_samples(discovery: DataFrame) -> DataFrame:
    s = discovery.select("session_id", F.posexplode("obd.samples").alias("pos", "s"))
    return s.select("session_id", "pos", "s.mode", "s.pid", "s.name", F.col("s.t_utc").alias("t"), "s.raw", "s.value", "s.unit")


def discovery_ecus(discovery: DataFrame) -> DataFrame:
    return discovery.select("session_id", F.explode("uds.ecus").alias("e")).select("session_id", "e.tx_id", "e.rx_id", "e.dids")


def discovery_ids(discovery: DataFrame) -> DataFrame:
    return discovery.select("session_id", F.explode("plain_can.arb_ids").alias("a")).select("session_id", "a.arb_id", "a.count", "a.dlc")


def read_labels(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The label streams below one root: dashboard, telltale, gear."""
    parts = {"dashboard": schemas.LABEL_DASHBOARD, "telltale": schemas.LABEL_TELLTALE, "gear": schemas.LABEL_GEAR}
    return {
        k: spark.read.schema(s).json(f"{path}/{k}").withColumnRenamed("t_utc", "t") for k, s in parts.items()
    }


def read_car_hw(spark: SparkSession, path: str) -> DataFrame:
    """Head-unit answers with their payload as VARIANT; failures are kept."""
    raw = spark.read.schema(schemas.CAR_HW).json(path)
    return raw.withColumn("data", F.try_parse_json("data")).withColumnRenamed("t_utc", "t")


def assemble_sessions(manifests: DataFrame, streams: dict[str, DataFrame]) -> DataFrame:
    """One row per session with the rows and time span of each stream, 0 where absent."""
    out = manifests.select("session_id").distinct()
    for name, df in streams.items():
        t = "t_mono" if "t_mono" in df.columns else "t"
        part = df.groupBy("session_id").agg(
            F.count(F.lit(1)).alias(f"{name}_rows"), F.min(t).alias(f"{name}_start"), F.max(t).alias(f"{name}_end")
        )
        out = out.join(part, "session_id", "left").withColumn(f"{name}_rows", F.coalesce(f"{name}_rows", F.lit(0)))
    return out
