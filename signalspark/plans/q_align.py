"""Registered queries: clock alignment (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalspark.operators import align as al
from signalspark.plans import views
from signalspark.plans.registry import Family
from signalspark.plans.sqlviews import cte, pearson_sql, resample_sql, with_views

FAMILY = Family()
q = FAMILY.query

cte("espd_p", "SELECT session_id, t+prior AS t, v FROM espd JOIN prior_n USING (session_id)", "espd", "prior_n")
cte("agrid", """
SELECT session_id, MAX(s) AS t0, CAST(FLOOR((MIN(e)-MAX(s))*10.0::DOUBLE) AS BIGINT)+1 AS n_grid FROM (
  SELECT session_id, MIN(t) AS s, MAX(t) AS e FROM espd_p GROUP BY ALL UNION ALL SELECT session_id, MIN(t), MAX(t) FROM gspd GROUP BY ALL)
GROUP BY ALL HAVING MIN(e)>MAX(s) AND FLOOR((MIN(e)-MAX(s))*10.0::DOUBLE)+1>=16""", "espd_p", "gspd")
cte("aref", resample_sql("gspd", "agrid", "session_id", "session_id", "10.0::DOUBLE", "2.0"), "gspd", "agrid")
cte("asig", resample_sql("espd_p", "agrid", "session_id", "session_id", "10.0::DOUBLE", "2.0"), "espd_p", "agrid")
cte("ascore", f"""SELECT s.session_id, k, {pearson_sql('r.v', 's.v')} AS r FROM asig s, range(-50,51) kk(k) JOIN aref r ON r.session_id=s.session_id AND r.gi=s.gi+k GROUP BY ALL""", "asig", "aref")
cte("align_l", """
SELECT p.session_id, prior + COALESCE(k/10.0::DOUBLE,0) AS delta, COALESCE(ABS(r),0) AS confidence,
  CASE WHEN k IS NULL THEN 'manifest_prior' ELSE 'xcorr(obd_speed,gps_speed)' END AS method
FROM prior_n p LEFT JOIN (SELECT * FROM ascore QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY ROUND(ABS(r),9) DESC, k)=1) b USING (session_id)""", "prior_n", "ascore")


def alignment_l(spark: SparkSession, sf: str, frames: DataFrame | None = None) -> DataFrame:
    """Alignment of the five bus sessions from their speed series."""
    if frames is None:
        frames = views.stored_frames(spark, sf)
    return al.estimate_alignment(
        al.manifest_prior(views.devices_n(spark, sf)),
        al.edge_obd_speed(views.edge_speed_l(spark, sf, frames)),
        al.gps_speed_kmh(views.location_l(spark, sf, frames)),
    )


@q("e01_manifest_prior", """
SELECT 's' || c_custkey AS session_id, ROUND(ROUND(c_acctbal)*CAST(0.001 AS DOUBLE) - c_nationkey*CAST(0.001 AS DOUBLE),6) AS prior FROM customer""")
def manifest_prior(spark: SparkSession, sf: str) -> DataFrame:
    d = views.manifest_c(spark, sf).select("session_id", F.posexplode("devices").alias("pos", "d"))
    p = al.manifest_prior(d.select("session_id", "pos", "d.role", "d.utc_offset_s"))
    return p.withColumn("prior", F.round("prior", 6))


@q("e02_edge_obd_speed", with_views("""
SELECT session_id, COUNT(*) AS n, ROUND(SUM(TRY_CAST(value AS DOUBLE)),3) AS total, MIN(t) AS t_start, MAX(t) AS t_end FROM samp
WHERE name='vehicle_speed' AND TRY_CAST(value AS DOUBLE) IS NOT NULL GROUP BY ALL HAVING COUNT(*)>=8""", "samp"))
def edge_obd_speed(spark: SparkSession, sf: str) -> DataFrame:
    s = al.edge_obd_speed(views.samples_l(spark, sf))
    return s.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 3).alias("total"), F.min("t").alias("t_start"), F.max("t").alias("t_end")
    )


@q("e03_gps_speed_kmh", with_views("""
SELECT session_id, t, ROUND(CASE WHEN speed>=0 THEN speed*3.6::DOUBLE END,6) AS v FROM sens""", "sens"))
def gps_speed(spark: SparkSession, sf: str) -> DataFrame:
    return al.gps_speed_kmh(views.sensors_e(spark, sf)).withColumn("v", F.round("v", 6))


@q("e04_marker_alignment", with_views("""
, mk AS (SELECT session_id, MIN_BY(t, event_id) AS mt FROM sens WHERE event_type='signup' GROUP BY ALL),
w AS (SELECT m.session_id, mt, s.t, acc_x FROM mk m JOIN sens s ON s.session_id=m.session_id AND ABS(s.t-mt)<=7200),
b AS (SELECT *, COUNT(*) OVER (PARTITION BY session_id) AS n FROM w QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY acc_x, t)=1)
SELECT session_id, ROUND(mt-t,3) AS delta, ROUND(LEAST(GREATEST(-acc_x/0.2::DOUBLE,0),1),6) AS confidence, 'sync_marker' AS method, 'brake_pulse' AS kind FROM b WHERE n>=3""", "sens"))
def marker_alignment(spark: SparkSession, sf: str) -> DataFrame:
    s = views.sensors_e(spark, sf)
    markers = s.filter("event_type = 'signup'").select(
        "session_id", F.col("event_id").alias("pos"), "t", F.lit("brake_pulse").alias("kind")
    )
    a = al.align_by_markers(markers, s, max_lag_s=7200.0)
    return a.withColumn("delta", F.round("delta", 3)).withColumn("confidence", F.round("confidence", 6))


@q("e05_alignment", with_views("SELECT session_id, ROUND(delta,6) AS delta, ROUND(confidence,6) AS confidence, method FROM align_l", "align_l"))
def alignment(spark: SparkSession, sf: str) -> DataFrame:
    a = alignment_l(spark, sf)
    return a.withColumn("delta", F.round("delta", 6)).withColumn("confidence", F.round("confidence", 6))


@q("e06_companion_clock", with_views("""
SELECT session_id, arb_id, rn AS row_seq, ROUND(CASE WHEN arb_id%2=0 THEN t+delta ELSE t END,6) AS t FROM fl JOIN prior_n USING (session_id), LATERAL (SELECT prior AS delta)""", "fl", "prior_n"))
def companion_clock(spark: SparkSession, sf: str) -> DataFrame:
    s = views.frames_l(spark, sf).select(
        "session_id", "arb_id", "row_seq", F.col("t_mono").alias("t"),
        F.when(F.col("arb_id") % 2 == 0, "edge").otherwise("companion").alias("clock"),
    )
    delta = al.manifest_prior(views.devices_n(spark, sf)).withColumnRenamed("prior", "delta")
    return al.on_companion_clock(s, delta).drop("clock").withColumn("t", F.round("t", 6))


@q("e07_ping_offset", """
SELECT CAST(o_custkey%97 AS VARCHAR) AS session_id, ROUND(MIN_BY(o, {'a': rtt, 'b': o_orderkey}),6) AS "offset", ROUND(MIN(rtt),6) AS rtt FROM (
  SELECT *, t1-t0 AS rtt, ts+(t1-t0)/2-t1 AS o FROM (SELECT o_custkey, o_orderkey, o_orderkey*1.0::DOUBLE AS t0, o_orderkey+0.01::DOUBLE*(1+o_custkey%50) AS t1, o_orderkey+5+0.001::DOUBLE*(o_orderkey%100) AS ts FROM orders)) GROUP BY 1""")
def ping_offset(spark: SparkSession, sf: str) -> DataFrame:
    o = views.table(spark, sf, "orders")
    pings = o.select(
        F.expr("CAST(o_custkey % 97 AS STRING)").alias("session_id"), F.col("o_orderkey").alias("seq"),
        F.expr("o_orderkey * 1.0D").alias("t0"), F.expr("o_orderkey + 0.01D * (1 + o_custkey % 50)").alias("t1"),
        F.expr("o_orderkey + 5 + 0.001D * (o_orderkey % 100)").alias("t_server"),
    )
    p = al.ping_offset(pings)
    return p.select("session_id", F.round("offset", 6).alias("offset"), F.round("rtt", 6).alias("rtt"))


@q("e08_utc_from_uptime", with_views("""
, u AS (SELECT session_id, event_type AS device, event_id, t, CAST((event_id*1000003)%1000000000+event_id*1000 AS BIGINT) AS ns FROM sens)
SELECT session_id, device, event_id, ROUND(a+ns/1e9::DOUBLE,3) AS t_utc FROM u JOIN (SELECT session_id, device, MIN_BY(t-ns/1e9::DOUBLE, ns) AS a FROM u GROUP BY ALL) USING (session_id, device)""", "sens"))
def utc_from_uptime(spark: SparkSession, sf: str) -> DataFrame:
    u = views.sensors_e(spark, sf).select(
        "session_id", F.col("event_type").alias("device"), "event_id", F.col("t").alias("wall_s"),
        F.expr("(event_id * 1000003) % 1000000000 + event_id * 1000").alias("uptime_ns"),
    )
    return al.utc_from_uptime(u).select("session_id", "device", "event_id", F.round("t_utc", 3).alias("t_utc"))
