"""Registered queries: reference series (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalspark.context import cut_lineage
from signalspark.operators import references as rf
from signalspark.plans import views
from signalspark.plans.registry import Family
from signalspark.plans.sqlviews import cte, with_views

FAMILY = Family()
q = FAMILY.query
DAY = 86400.0


def _tidy(s: DataFrame) -> DataFrame:
    return s.select("session_id", "name", "t", F.round("v", 6).alias("v"), "unit", "kind", "clock")


def _rows(parts: list[tuple[str, str, str]], src: str, clock: str, kind: str = "continuous") -> str:
    return " UNION ALL ".join(
        f"SELECT session_id, '{n}' AS name, t, ROUND({e},6) AS v, '{u}' AS unit, '{kind}' AS kind, '{clock}' AS clock FROM {src}"
        for n, e, u in parts
    )


SPEED = "CASE WHEN speed>=0 THEN speed END"
KMH = "CASE WHEN speed>=0 THEN speed*3.6::DOUBLE END"
cte("gdv", """
SELECT session_id, t, CASE WHEN tp IS NULL AND tn IS NULL THEN 0 WHEN tp IS NULL THEN (vn-v)/(tn-t) WHEN tn IS NULL THEN (v-vp)/(t-tp)
  ELSE ((t-tp)*(t-tp)*vn + ((tn-t)*(tn-t)-(t-tp)*(t-tp))*v - (tn-t)*(tn-t)*vp)/((t-tp)*(tn-t)*((tn-t)+(t-tp))) END AS dv FROM (
SELECT session_id, t, v, LAG(t) OVER w AS tp, LAG(v) OVER w AS vp, LEAD(t) OVER w AS tn, LEAD(v) OVER w AS vn FROM (
 SELECT session_id, event_id, t, CASE WHEN speed>=0 THEN speed END AS v FROM sens) WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id))""", "sens")
GPS = _rows([("gps_speed", SPEED, "m/s"), ("gps_speed_kmh", KMH, "km/h")], "sens", "companion") + " UNION ALL " + _rows([("gps_accel_long", "dv", "m/s^2")], "gdv", "companion")
MAG = "SQRT(acc_x*acc_x+acc_y*acc_y+acc_z*acc_z)"
IMU = _rows([("imu_accel_mag", MAG, "g"), ("imu_accel_long", "acc_x", "g"), ("imu_yaw_rate", "rot_z", "rad/s")], "sens", "companion")
EIMU = _rows([("edge_imu_accel_mag", MAG, "g"), ("edge_imu_accel_long", "acc_x", "g"), ("edge_imu_yaw_rate", "rot_z", "rad/s")], "sens", "edge")
EGPS = _rows([("edge_gps_speed", SPEED, "m/s"), ("edge_gps_speed_kmh", KMH, "km/h")], "sens", "edge")
DASH = "SELECT session_id, 'dash_' || field AS name, t, ROUND(value,6) AS v, '' AS unit, 'continuous' AS kind, 'companion' AS clock FROM lab WHERE value IS NOT NULL"
TELL = "SELECT session_id, 'telltale_' || name AS name, t, state::DOUBLE AS v, '' AS unit, 'event' AS kind, 'companion' AS clock FROM lab"
GEAR = "SELECT session_id, 'dash_gear' AS name, t, gear AS v, 'gear' AS unit, 'continuous' AS kind, 'companion' AS clock FROM lab WHERE gear IS NOT NULL"
REGEN = " UNION ALL ".join(_rows([(n, "GREATEST(-acc_x,0)", "g")], "sens", c) for n, c in (("regen_brake", "companion"), ("edge_regen_brake", "edge")))
cte("obdref", """
SELECT s.session_id, 'obd_' || ref AS name, t, TRY_CAST(value AS DOUBLE) AS v, COALESCE(u.unit,'') AS unit, 'continuous' AS kind, 'edge' AS clock
FROM (SELECT *, COALESCE(NULLIF(name,''), 'pid_' || COALESCE(pid,'?')) AS ref FROM samp WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL) s
LEFT JOIN (SELECT session_id, name AS ref, (ARG_MIN({'u': unit}, pos)).u AS unit FROM samp WHERE name<>'' GROUP BY ALL) u USING (session_id, ref)""", "samp")
EVOBD = """SELECT session_id, CASE LOWER(name) WHEN 'soc' THEN 'ev_hv_battery_soc' WHEN 'ev_battery_soc' THEN 'ev_hv_battery_soc' WHEN 'hybrid_battery_remaining' THEN 'ev_hv_battery_soc'
  WHEN 'hv_battery_current' THEN 'ev_hv_battery_current' WHEN 'hv_battery_voltage' THEN 'ev_hv_battery_voltage' END AS name, t, TRY_CAST(value AS DOUBLE) AS v, '' AS unit, 'continuous' AS kind, 'edge' AS clock
FROM samp WHERE LOWER(name) IN ('soc','ev_battery_soc','hybrid_battery_remaining','hv_battery_current','hv_battery_voltage') AND TRY_CAST(value AS DOUBLE) IS NOT NULL"""


@q("f01_gps_references", with_views(GPS, "sens", "gdv"))
def gps(spark: SparkSession, sf: str) -> DataFrame:
    return _tidy(rf.gps_references(views.sensors_e(spark, sf), DAY, ("t", "event_id")))


@q("f02_imu_references", with_views(IMU, "sens"))
def imu(spark: SparkSession, sf: str) -> DataFrame:
    return _tidy(rf.imu_references(views.sensors_e(spark, sf)))


@q("f03_edge_imu_references", with_views(EIMU, "sens"))
def edge_imu(spark: SparkSession, sf: str) -> DataFrame:
    return _tidy(rf.imu_references(views.sensors_e(spark, sf), "edge"))


@q("f04_edge_gps_references", with_views(EGPS, "sens"))
def edge_gps(spark: SparkSession, sf: str) -> DataFrame:
    return _tidy(rf.edge_gps_references(views.sensors_e(spark, sf)))


@q("f05_obd_references", with_views("SELECT * FROM obdref", "obdref"))
def obd(spark: SparkSession, sf: str) -> DataFrame:
    return _tidy(rf.obd_references(views.samples_l(spark, sf)))


@q("f06_first_unit", with_views("SELECT session_id, name, COALESCE((ARG_MIN({'u': unit}, pos)).u,'') AS unit FROM samp WHERE name<>'' GROUP BY ALL", "samp"))
def first_unit(spark: SparkSession, sf: str) -> DataFrame:
    return rf.first_unit(views.samples_l(spark, sf))


@q("f07_dashboard_references", with_views(DASH, "lab"))
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return _tidy(rf.dashboard_references(views.labels_e(spark, sf)))


@q("f08_telltale_references", with_views(TELL, "lab"))
def telltale(spark: SparkSession, sf: str) -> DataFrame:
    return _tidy(rf.telltale_references(views.labels_e(spark, sf)))


@q("f09_gear_references", with_views(GEAR, "lab"))
def gear(spark: SparkSession, sf: str) -> DataFrame:
    return _tidy(rf.gear_references(views.labels_e(spark, sf)))


@q("f10_regen_references", with_views(REGEN, "sens"))
def regen(spark: SparkSession, sf: str) -> DataFrame:
    m = views.sensors_e(spark, sf)
    return _tidy(rf.regen_references(m).unionByName(rf.regen_references(m, "edge")))


@q("f11_ev_obd_references", with_views(EVOBD, "samp"))
def ev_obd(spark: SparkSession, sf: str) -> DataFrame:
    return _tidy(rf.ev_obd_references(views.samples_l(spark, sf)))


@q("f12_head_unit_references", with_views("""
SELECT session_id, 'car_soc' AS name, t, battery_percent AS v, '%' AS unit, 'continuous' AS kind, 'companion' AS clock FROM carhw WHERE status='success' AND kind='energy' AND battery_percent IS NOT NULL
UNION ALL SELECT session_id, 'car_fuel', t, fuel_percent, '%', 'continuous', 'companion' FROM carhw WHERE status='success' AND kind='energy' AND fuel_percent IS NOT NULL
UNION ALL SELECT session_id, 'car_odometer_m', t, odometer_meters, 'm', 'continuous', 'companion' FROM carhw WHERE status='success' AND kind='mileage' AND odometer_meters IS NOT NULL
UNION ALL SELECT session_id, 'car_speed_ms', t, raw_mps, 'm/s', 'continuous', 'companion' FROM carhw WHERE status='success' AND kind='speed' AND raw_mps IS NOT NULL
UNION ALL SELECT session_id, 'car_display_speed_ms', t, display_mps, 'm/s', 'continuous', 'companion' FROM carhw WHERE status='success' AND kind='speed' AND display_mps IS NOT NULL""", "carhw"))
def head_unit(spark: SparkSession, sf: str) -> DataFrame:
    return _tidy(rf.head_unit_references(views.car_hw_e(spark, sf)))


ALL_SQL = " UNION ALL ".join(f"(SELECT * FROM ({x}))" for x in (GPS, IMU, EIMU, EGPS, DASH, TELL, GEAR, REGEN, "SELECT * FROM obdref", EVOBD))


@q("f13_all_references", with_views(f"""
, u AS ({ALL_SQL})
SELECT session_id, name, unit, kind, clock, COUNT(*) AS n, MIN(t) AS t_start, MAX(t) AS t_end, ROUND(SUM(v),3) AS total FROM u
GROUP BY ALL HAVING COUNT(*)>=8""", "sens", "gdv", "lab", "obdref"))
def all_references(spark: SparkSession, sf: str) -> DataFrame:
    # every family reads its stream, and families are read to be counted first
    m, lab = cut_lineage(views.sensors_e(spark, sf), "sensors"), cut_lineage(views.labels_e(spark, sf), "labels")
    smp = cut_lineage(views.samples_l(spark, sf).select("session_id", "pos", "name", "pid", "t", "value", "unit"), "samples")
    gps = cut_lineage(rf.gps_references(m, DAY, ("t", "event_id")), "gps")
    s = rf.build_references(
        [
            gps, rf.imu_references(m), rf.obd_references(smp),
            rf.imu_references(m, "edge"), rf.edge_gps_references(m), rf.dashboard_references(lab),
            rf.telltale_references(lab), rf.gear_references(lab), rf.regen_references(m),
            rf.regen_references(m, "edge"), rf.ev_obd_references(smp),
        ]
    )
    return _tidy(s).groupBy("session_id", "name", "unit", "kind", "clock").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.round(F.sum("v"), 3).alias("total")
    )
