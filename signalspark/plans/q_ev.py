"""Registered queries: battery and charging (H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalspark.operators import ev, tseries as ts
from signalspark.operators.slices import with_row_number
from signalspark.plans import views
from signalspark.plans.registry import Family
from signalspark.plans.sqlviews import cte, pearson_sql, resample_sql, with_views

FAMILY = Family()
q = FAMILY.query
SUPP = ["session_id"]

cte("chg", """
SELECT CAST(l_suppkey AS VARCHAR) AS session_id, rn, rn*60.0::DOUBLE AS t, q-25.0::DOUBLE AS current, 300.0::DOUBLE+d*10 AS voltage, CAST(l_linenumber AS INT) AS phase FROM bus_o""", "bus_o")


def charging(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as one charging log per supplier, one sample a minute."""
    li = views.table(spark, sf, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount"
    )
    n = with_row_number(
        li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], F.floor(F.col("l_orderkey") / 4096)
    )
    return n.select(
        F.col("l_suppkey").cast("string").alias("session_id"), "rn", (F.col("rn") * F.lit(60.0)).alias("t"),
        (F.col("l_quantity").cast("int") - F.lit(25.0)).alias("current"),
        (F.lit(300.0) + F.round(F.col("l_discount") * 100).cast("int") * 10).alias("voltage"),
        F.col("l_linenumber").alias("phase"),
    )


@q("h01_soc_from_current", with_views("""
SELECT session_id, rn, ROUND(100.0::DOUBLE - SUM(COALESCE(pc*(t-pt)/3600.0::DOUBLE,0)) OVER (PARTITION BY session_id ORDER BY rn)*100.0::DOUBLE/50.0::DOUBLE,6) AS soc FROM (
  SELECT *, LAG(current) OVER (PARTITION BY session_id ORDER BY rn) AS pc, LAG(t) OVER (PARTITION BY session_id ORDER BY rn) AS pt FROM chg)""", "chg"))
def soc(spark: SparkSession, sf: str) -> DataFrame:
    s = ev.soc_from_current(charging(spark, sf), SUPP, 50.0)
    return s.select("session_id", "rn", F.round("soc", 6).alias("soc"))


cte("chv", "SELECT session_id, t, voltage AS v FROM chg", "chg")
cte("chi", "SELECT session_id, t+30.0::DOUBLE AS t, current AS v FROM chg", "chg")
cte("chgrid", """
SELECT session_id, MAX(s) AS t0, CAST(FLOOR((MIN(e)-MAX(s))*(CAST(1.0 AS DOUBLE)/CAST(60.0 AS DOUBLE))) AS BIGINT)+1 AS n_grid FROM (SELECT session_id, MIN(t) AS s, MAX(t) AS e FROM chv GROUP BY ALL UNION ALL SELECT session_id, MIN(t), MAX(t) FROM chi GROUP BY ALL) GROUP BY ALL HAVING MIN(e)>MAX(s)""", "chv", "chi")
HZ = "CAST(1.0 AS DOUBLE)/CAST(60.0 AS DOUBLE)"
cte("chvr", resample_sql("chv", "chgrid", "session_id", "session_id", HZ, "300.0"), "chv", "chgrid")
cte("chir", resample_sql("chi", "chgrid", "session_id", "session_id", HZ, "300.0"), "chi", "chgrid")


@q("h02_battery_power", with_views(f"""
SELECT session_id, COUNT(*) AS n, ROUND(SUM(v.v*i.v),3) AS total_power, ROUND({pearson_sql('v.v*i.v', 'i.v')},6) AS r FROM chvr v JOIN chir i USING (session_id, gi) GROUP BY ALL""", "chvr", "chir"))
def battery_power(spark: SparkSession, sf: str) -> DataFrame:
    """Power against current, which a constant voltage would make proportional."""
    c = charging(spark, sf)
    v = c.select("session_id", "t", F.col("voltage").alias("v"))
    i = c.select("session_id", (F.col("t") + 30.0).alias("t"), F.col("current").alias("v"))
    p = ev.battery_power(v, i, SUPP, 1.0 / 60.0, 300.0, 36000.0)
    both = ts.spans(v, SUPP).unionByName(ts.spans(i, SUPP))
    ig = ts.resample(i, ts.common_grid(both, SUPP, 1.0 / 60.0), SUPP, SUPP, 1.0 / 60.0, 300.0, 36000.0)
    fit = ev.power_consistency(p, ig.withColumnRenamed("v", "claimed"), SUPP)
    total = p.groupBy("session_id").agg(F.round(F.sum("power"), 3).alias("total_power"))
    return fit.join(total, "session_id").select("session_id", "n", "total_power", F.round("r", 6).alias("r"))


@q("h03_ac_power", with_views("SELECT session_id, rn, ROUND(3*voltage*current*0.95::DOUBLE,6) AS power FROM chg", "chg"))
def ac_power(spark: SparkSession, sf: str) -> DataFrame:
    c = charging(spark, sf)
    return c.select("session_id", "rn", F.round(ev.ac_power(F.col("voltage"), F.col("current"), 3, 0.95), 6).alias("power"))


@q("h04_charge_mode", with_views("""
SELECT session_id, phase, CASE WHEN MAX(ABS(CASE WHEN phase>3 THEN 0 ELSE current END))>1 THEN 'ac' WHEN MAX(ABS(current*3))>50 THEN 'dc' ELSE 'ac' END AS mode FROM chg GROUP BY ALL""", "chg"))
def charge_mode(spark: SparkSession, sf: str) -> DataFrame:
    c = charging(spark, sf).select(
        "session_id", "phase", F.when(F.col("phase") > 3, 0.0).otherwise(F.col("current")).alias("ac"), (F.col("current") * 3).alias("dc")
    )
    return ev.classify_mode(c, ["session_id", "phase"]).select("session_id", "phase", "mode")


@q("h05_phase_count", with_views("""
SELECT session_id, CAST(COUNT_IF(peak>24) AS BIGINT) AS phases FROM (SELECT session_id, phase, MAX(ABS(current)) AS peak FROM chg GROUP BY ALL) GROUP BY ALL""", "chg"))
def phase_count(spark: SparkSession, sf: str) -> DataFrame:
    return ev.phase_count(charging(spark, sf), SUPP, active_amps=24.0)


@q("h06_charge_state", """
SELECT event_id, CASE WHEN k%9-1 BETWEEN 0 AND 5 THEN ['idle','connected','locked','charging','complete','fault'][k%9] ELSE 'unknown' END AS state FROM (SELECT event_id, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events)""")
def charge_state(spark: SparkSession, sf: str) -> DataFrame:
    e = views.sensors_e(spark, sf)
    return e.select("event_id", ev.charge_state_name(F.col("k") % 9 - 1).alias("state"))
