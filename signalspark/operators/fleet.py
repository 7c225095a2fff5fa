"""Session merging and the knowledge base across vehicles.

Merged sessions and knowledge entries are tables with one row per device,
stream, list item or vehicle, so nothing about a session or a platform is
gathered into one value that grows with the fleet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROLES = ["edge", "companion"]


def scan_parts(parts: DataFrame) -> DataFrame:
    """One row per part and device; ``parts`` has session_id, folder, part_seq, devices."""
    sid = F.coalesce("session_id", "folder")
    return parts.filter("devices IS NOT NULL").select(
        sid.alias("session_id"), "folder", "part_seq", F.posexplode_outer("devices").alias("pos", "device")
    ).select(
        "session_id", "folder", "part_seq", "pos",
        F.when(F.col("device").isNotNull(), F.coalesce("device.role", F.lit("unknown"))).alias("role"), "device",
    )


def merge_status(scanned: DataFrame) -> DataFrame:
    """Roles present and missing per session; complete with edge and companion.

    Parts are counted exactly after partial distinct per (session, folder).
    """
    parts = scanned.select("session_id", "folder").distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("parts"))
    roles = scanned.groupBy("session_id").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    missing = F.array_except(F.array(*[F.lit(r) for r in ROLES]), "roles")
    return parts.join(roles, "session_id").select(
        "session_id", "parts", "roles", missing.alias("missing"), (F.size(missing) == 0).alias("complete"),
        F.when(F.size(missing) == 0, "merged").otherwise("awaiting").alias("status"),
    )


def complete_sessions(status: DataFrame) -> DataFrame:
    return status.filter("complete").select("session_id")


def merged_header(parts: DataFrame) -> DataFrame:
    """First known vehicle and creation time of each session, in part order."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("part_seq")))
    return parts.groupBy("session_id").agg(
        first("vehicle").alias("vehicle"), F.coalesce(first("created_utc"), F.lit(0.0)).alias("created_utc"),
        F.count(F.lit(1)).alias("parts"),
    )


def merged_streams(streams: DataFrame) -> DataFrame:
    """Streams of all parts; of two files with one path the later part's stays."""
    return streams.filter("path IS NOT NULL").groupBy("session_id", "path").agg(
        F.max_by(F.struct("kind", "rows", "part_seq"), F.struct("part_seq", "pos")).alias("s")
    ).select("session_id", "path", "s.kind", "s.rows", "s.part_seq")


def merge_discovery(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """List items in part order, and scalars where the last part wins.

    ``items``: session_id, section, key, part_seq, pos (NULL for scalars), value.
    """
    lists = items.filter("pos IS NOT NULL").select("session_id", "section", "key", "part_seq", "pos", "value")
    scalars = items.filter("pos IS NULL").groupBy("session_id", "section", "key").agg(
        F.max_by("value", "part_seq").alias("value")
    )
    return lists, scalars


def platform_key(make: Column, model: Column) -> Column:
    label = F.concat_ws(" ", F.when(make != "", make), F.when(model != "", model))
    return F.when(label != "", label).otherwise("unknown")


def confirmed(log: DataFrame) -> DataFrame:
    """Latest confirmed candidate per (platform, reference) and how many vehicles agree."""
    c = log.filter("action = 'confirm'")
    last = c.groupBy("platform", "reference").agg(F.max_by(F.struct("label", "r"), "seq").alias("e"))
    n = confirming_vehicles(log).groupBy("platform", "reference").agg(F.count(F.lit(1)).alias("vehicles"))
    return last.join(n, ["platform", "reference"], "left").select(
        "platform", "reference", "e.label", "e.r", F.coalesce("vehicles", F.lit(0)).alias("vehicles")
    )


def confirming_vehicles(log: DataFrame) -> DataFrame:
    """The vehicles behind every confirmed reference, one row each."""
    return log.filter("action = 'confirm' AND vehicle IS NOT NULL AND vehicle <> ''").select(
        "platform", "reference", "vehicle"
    ).distinct()


def rejected(log: DataFrame) -> DataFrame:
    return log.filter("action = 'reject'").select("platform", "reference", "label").distinct()


def fleet_summary(log: DataFrame) -> DataFrame:
    """Signals, distinct vehicles and rejections per platform."""
    sig = confirmed(log).groupBy("platform").agg(F.count(F.lit(1)).alias("signals"))
    veh = confirming_vehicles(log).select("platform", "vehicle").distinct().groupBy("platform").agg(F.count(F.lit(1)).alias("vehicles"))
    rej = rejected(log).groupBy("platform").agg(F.count(F.lit(1)).alias("rejected"))
    j = sig.join(rej, "platform", "full_outer").join(veh, "platform", "left")
    return j.select("platform", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("signals", "vehicles", "rejected")])
