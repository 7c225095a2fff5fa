"""Registered queries: session merging and knowledge base (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalspark.operators import fleet
from signalspark.plans import views
from signalspark.plans.registry import Family
from signalspark.plans.sqlviews import cte, with_views

FAMILY = Family()
q = FAMILY.query

cte("part_", """
SELECT CASE WHEN o_orderkey%97=0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS sid, 'd' || o_orderkey AS folder, o_orderkey AS part_seq, o_orderstatus AS st, o_totalprice FROM orders""")
cte("scan", """
SELECT COALESCE(sid, folder) AS session_id, folder, part_seq, CAST(i AS INT) AS pos, CASE WHEN st='P' THEN ['edge','companion'][i+1] WHEN st='F' THEN 'edge' ELSE 'companion' END AS role
FROM part_, range(0,2) r(i) WHERE i=0 OR st='P'""", "part_")


def parts_o(spark: SparkSession, sf: str) -> DataFrame:
    o = views.table(spark, sf, "orders")
    return o.select(
        F.expr("CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END").alias("session_id"),
        F.concat(F.lit("d"), "o_orderkey").alias("folder"), F.col("o_orderkey").alias("part_seq"),
        F.expr(
            "CASE o_orderstatus WHEN 'P' THEN array(named_struct('role','edge'), named_struct('role','companion'))"
            " WHEN 'F' THEN array(named_struct('role','edge')) ELSE array(named_struct('role','companion')) END"
        ).alias("devices"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END").alias("vehicle"),
        F.expr("CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END").alias("created_utc"),
        "o_custkey", "o_orderkey", "o_totalprice",
    )


def _scanned(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.scan_parts(parts_o(spark, sf))


@q("j01_session_parts", with_views("SELECT session_id, folder, pos, role FROM scan", "scan"))
def session_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _scanned(spark, sf).select("session_id", "folder", "pos", "role")


STATUS = """
, stt AS (SELECT session_id, COUNT(DISTINCT folder) AS parts, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, COUNT(DISTINCT role)=2 AS complete FROM scan GROUP BY ALL)"""


@q("j02_merge_status", with_views(STATUS + """
SELECT session_id, parts, roles, CASE WHEN roles='edge' THEN 'companion' WHEN roles='companion' THEN 'edge' ELSE '' END AS missing, complete, CASE WHEN complete THEN 'merged' ELSE 'awaiting' END AS status FROM stt""", "scan"))
def merge_status(spark: SparkSession, sf: str) -> DataFrame:
    s = fleet.merge_status(_scanned(spark, sf))
    return s.withColumn("roles", F.array_join("roles", ",")).withColumn("missing", F.array_join("missing", ","))


@q("j03_merged_sessions", """
WITH p AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, o_orderkey AS seq, CASE WHEN o_orderkey%3=0 THEN o_orderpriority END AS vehicle, CASE WHEN o_orderkey%4=0 THEN o_totalprice END AS created FROM orders),
h AS (SELECT session_id, MIN_BY(vehicle, seq) FILTER (vehicle IS NOT NULL) AS vehicle, COALESCE(MIN_BY(created, seq) FILTER (created IS NOT NULL),0) AS created_utc, COUNT(*) AS parts FROM p GROUP BY ALL),
s AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, 'can/' || o_orderstatus AS path, MAX_BY(CAST(FLOOR(o_totalprice) AS BIGINT), o_orderkey) AS rows FROM orders GROUP BY ALL)
SELECT h.session_id, vehicle, created_utc, parts, path, rows FROM h JOIN s USING (session_id)""")
def merged_sessions(spark: SparkSession, sf: str) -> DataFrame:
    p = parts_o(spark, sf).withColumn("session_id", F.col("o_custkey").cast("string"))
    o = views.table(spark, sf, "orders")
    streams = o.select(
        F.col("o_custkey").cast("string").alias("session_id"), F.concat(F.lit("can/"), "o_orderstatus").alias("path"),
        F.lit("can_frames").alias("kind"), F.floor("o_totalprice").alias("rows"),
        F.col("o_orderkey").alias("part_seq"), F.lit(0).alias("pos"),
    )
    return fleet.merged_header(p).join(fleet.merged_streams(streams), "session_id").select(
        "session_id", "vehicle", "created_utc", "parts", "path", "rows"
    )


@q("j04_merged_discovery", """
SELECT CAST(o_custkey AS VARCHAR) AS session_id, 'obd' AS section, 'samples' AS key, o_orderkey AS part_seq, o_orderpriority AS value, 'item' AS kind FROM orders
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'bus', 'bitrate', NULL, MAX_BY(o_orderstatus, o_orderkey), 'scalar' FROM orders GROUP BY 1""")
def merged_discovery(spark: SparkSession, sf: str) -> DataFrame:
    o = views.table(spark, sf, "orders").withColumn("session_id", F.col("o_custkey").cast("string"))
    lists = o.select("session_id", F.lit("obd").alias("section"), F.lit("samples").alias("key"), F.col("o_orderkey").alias("part_seq"), F.lit(0).alias("pos"), F.col("o_orderpriority").alias("value"))
    scalars = o.select("session_id", F.lit("bus").alias("section"), F.lit("bitrate").alias("key"), F.col("o_orderkey").alias("part_seq"), F.lit(None).cast("int").alias("pos"), F.col("o_orderstatus").alias("value"))
    items, last = fleet.merge_discovery(lists.unionByName(scalars))
    return items.drop("pos").withColumn("kind", F.lit("item")).unionByName(
        last.withColumn("part_seq", F.lit(None).cast("long")).withColumn("kind", F.lit("scalar"))
    )


@q("j05_complete_sessions", with_views(STATUS + " SELECT session_id, folder, role FROM scan WHERE session_id IN (SELECT session_id FROM stt WHERE complete)", "scan"))
def complete_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = _scanned(spark, sf)
    return s.join(fleet.complete_sessions(fleet.merge_status(s)), "session_id", "left_semi").select("session_id", "folder", "role")


@q("j06_platform_key", """
SELECT c_custkey, CASE WHEN c_custkey%5=0 AND c_custkey%7=0 THEN 'unknown' WHEN c_custkey%5=0 THEN CAST(c_nationkey AS VARCHAR) WHEN c_custkey%7=0 THEN c_mktsegment ELSE c_mktsegment || ' ' || c_nationkey END AS platform FROM customer""")
def platform_key(spark: SparkSession, sf: str) -> DataFrame:
    c = views.table(spark, sf, "customer")
    make = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    model = F.when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(F.col("c_nationkey").cast("string"))
    return c.select("c_custkey", fleet.platform_key(make, model).alias("platform"))


cte("kb", """
SELECT c_mktsegment AS platform, 'ref_' || (o_orderkey%20) AS reference, printf('0x%X[1:3]BEu', 256+o_custkey%50) AS label, CASE WHEN o_orderstatus='O' THEN 'reject' ELSE 'confirm' END AS action,
  ROUND(o_totalprice/1000000.0::DOUBLE,6) AS r, CASE WHEN o_orderkey%11=0 THEN NULL ELSE 'v' || (o_custkey%30) END AS vehicle, o_orderkey AS seq FROM orders JOIN customer ON o_custkey=c_custkey""")
KBC = """
, conf AS (SELECT platform, reference, MAX_BY(label, seq) AS label, MAX_BY(r, seq) AS r, COUNT(DISTINCT vehicle) AS vehicles FROM kb WHERE action='confirm' GROUP BY ALL),
rej AS (SELECT DISTINCT platform, reference, label FROM kb WHERE action='reject')"""


def kb_o(spark: SparkSession, sf: str) -> DataFrame:
    o = views.table(spark, sf, "orders").join(
        views.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey"
    )
    return o.select(
        F.col("c_mktsegment").alias("platform"), F.concat(F.lit("ref_"), F.col("o_orderkey") % 20).alias("reference"),
        F.format_string("0x%X[1:3]BEu", F.col("o_custkey") % 50 + 256).alias("label"),
        F.when(F.col("o_orderstatus") == "O", "reject").otherwise("confirm").alias("action"),
        F.round(F.col("o_totalprice") / F.lit(1e6), 6).alias("r"),
        F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("v"), F.col("o_custkey") % 30)).alias("vehicle"), F.col("o_orderkey").alias("seq"),
    )


@q("j07_confirmed", with_views(KBC + " SELECT * FROM conf", "kb"))
def confirmed(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.confirmed(kb_o(spark, sf))


@q("j08_rejected", with_views(KBC + " SELECT kb.platform, kb.seq, EXISTS (SELECT 1 FROM rej WHERE rej.platform=kb.platform AND rej.reference=kb.reference AND rej.label=kb.label) AS rejected FROM kb WHERE action='confirm'", "kb"))
def rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Which confirmations contradict an earlier or later rejection."""
    log = kb_o(spark, sf)
    known = fleet.rejected(log).withColumn("hit", F.lit(True))
    j = log.filter("action = 'confirm'").join(known, ["platform", "reference", "label"], "left")
    return j.select("platform", "seq", F.coalesce("hit", F.lit(False)).alias("rejected"))


@q("j09_fleet_summary", with_views(KBC + """
SELECT platform, COALESCE(s,0) AS signals, COALESCE(v,0) AS vehicles, COALESCE(x,0) AS rejected FROM (SELECT platform, COUNT(*) AS s FROM conf GROUP BY ALL)
FULL JOIN (SELECT platform, COUNT(*) AS x FROM rej GROUP BY ALL) USING (platform) LEFT JOIN (SELECT platform, COUNT(DISTINCT vehicle) AS v FROM kb WHERE action='confirm' GROUP BY ALL) USING (platform)""", "kb"))
def fleet_summary(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.fleet_summary(kb_o(spark, sf))
