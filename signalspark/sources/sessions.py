"""Recorded session folders, many at a time.

Only a manifest names its session; the record files beside it do not.  Each
file's folder is taken from its path, and the manifests say which session a
folder is.  A session has any of these streams:

    <session>/manifest.json
    <session>/can/frames.parquet, frames.jsonl, discovery.json
    <session>/phone/motion.jsonl, location.jsonl
    <session>/edge/motion.jsonl, location.jsonl
    <session>/labels/annotations.json, dashboard_ocr.jsonl, telltales.jsonl, gear.jsonl
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signalspark import schemas
from signalspark.sources import recordings as rec


def _files(spark: SparkSession, root: str, inside: str, glob: str, schema: str, kind: str = "json", **options) -> DataFrame:
    """Records of all files ``<folder>/<inside>`` below ``root`` with their session's ``folder``; none is fine."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).options(**options)
    raw = reader.text(root, wholetext=True) if kind == "text" else getattr(reader.schema(schema), kind)(root)
    path = F.col("_metadata.file_path")
    mark = rf"^(.*)/{inside}(?:/[^/]*)?$"
    return raw.select("*", F.regexp_extract(path, mark, 1).alias("folder")).filter("folder <> ''")


def folders(spark: SparkSession, root: str) -> DataFrame:
    """Manifests with their ``folder``; one without a session id is named by its folder."""
    m = _files(spark, root, r"manifest\.json", "manifest.json", schemas.MANIFEST, multiLine=True)
    return m.withColumn("session_id", F.coalesce("session_id", last_part(F.col("folder"))))


def last_part(folder: Column) -> Column:
    return F.regexp_extract(folder, "([^/]+)$", 1)


def _of_session(records: DataFrame, names: DataFrame) -> DataFrame:
    """Give each record its session's id; a folder without a manifest is its own session."""
    named = records.drop("session_id").join(names, "folder", "left")
    return named.withColumn("session_id", F.coalesce("session_id", last_part(F.col("folder")))).drop("folder")


def read_sessions(spark: SparkSession, root: str, major: int = 1) -> dict[str, DataFrame]:
    """All streams of all sessions below ``root``, absent ones empty.

    Keys: manifests, frames, motion, location, edge_motion, edge_location,
    discovery, annotations (one JSON value per session), dashboard, telltales,
    gear.  Sessions whose manifest has another major version are left out of
    every stream.  Frames come from Parquet where a folder has it.
    """
    everything = rec.gate_version(folders(spark, root), major)
    manifests = everything.filter("accepted").drop("accepted")
    # one row per session, small beside its records; Spark broadcasts it if it measures it to be
    names = manifests.select("folder", "session_id")
    refused = everything.filter("not accepted").select("folder")

    def stream(inside: str, glob: str, schema: str, kind: str = "json", **options) -> DataFrame:
        x = _files(spark, root, inside, glob, schema, kind, **options)
        return _of_session(x.join(refused, "folder", "left_anti"), names)

    def motion(part: str) -> DataFrame:
        return rec.flatten_motion(stream(rf"{part}/motion\.jsonl", "motion.jsonl", schemas.MOTION))

    def location(part: str) -> DataFrame:
        return rec.known_location(stream(rf"{part}/location\.jsonl", "location.jsonl", schemas.LOCATION))

    def labels(name: str, schema: str) -> DataFrame:
        return stream(rf"labels/{name}\.jsonl", f"{name}.jsonl", schema).withColumnRenamed("t_utc", "t")

    packed = rec.frame_defaults(stream(r"can/frames\.parquet", "*.parquet", schemas.FRAMES, "parquet"))
    text = stream(r"can/frames\.jsonl", "frames.jsonl", schemas.FRAMES_JSON).filter("arb_id IS NOT NULL")
    text = rec.frame_defaults(text.withColumn("data", F.unhex("data")))
    notes = stream(r"labels/annotations\.json", "annotations.json", "value STRING", "text")
    return {
        "manifests": manifests,
        "frames": packed.unionByName(text.join(packed.select("session_id").distinct(), "session_id", "left_anti")),
        "motion": motion("phone"),
        "location": location("phone"),
        "edge_motion": motion("edge"),
        "edge_location": location("edge"),
        "discovery": stream(r"can/discovery\.json", "discovery.json", schemas.DISCOVERY, multiLine=True),
        "annotations": notes.select("session_id", F.try_parse_json("value").alias("annotations")),
        "dashboard": labels("dashboard_ocr", schemas.LABEL_DASHBOARD),
        "telltales": labels("telltales", schemas.LABEL_TELLTALE),
        "gear": labels("gear", schemas.LABEL_GEAR),
    }


def sync_markers(manifests: DataFrame) -> DataFrame:
    """The manifests' markers as ``align_by_markers`` takes them: pos, t, kind per session."""
    m = manifests.select("session_id", F.posexplode("sync_markers").alias("pos", "m"))
    return m.select("session_id", "pos", F.col("m.t_utc").alias("t"), F.col("m.kind").alias("kind"))
