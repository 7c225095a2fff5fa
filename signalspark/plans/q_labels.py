"""Registered queries: dashboard labels (M)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalspark.operators import labels as lb
from signalspark.plans import views
from signalspark.plans.registry import Family
from signalspark.plans.sqlviews import cte, with_views

FAMILY = Family()
q = FAMILY.query

cte("roi", """
SELECT r_name AS name, ['telltale','needle','digits','gear','telltale'][r_regionkey+1] AS kind, r_regionkey*15 AS bx, r_regionkey*10 AS by_, 60 AS bw, 40 AS bh FROM region""")
cte("pix", """
SELECT l_orderkey//64 AS frame, CAST(l_partkey%130 AS INT) AS x, CAST(l_suppkey%90 AS INT) AS y, CAST(l_quantity AS INT)*5 AS lum FROM lineitem""")
cte("crop", "SELECT frame, name, bx, by_, x, y, lum FROM pix JOIN roi ON x>=bx AND x<bx+bw AND y>=by_ AND y<by_+bh", "pix", "roi")
KEYS = ["frame", "name"]


def _rois(spark: SparkSession, sf: str) -> DataFrame:
    r = views.table(spark, sf, "region")
    return r.select(
        F.col("r_name").alias("name"),
        F.expr("element_at(array('telltale','needle','digits','gear','telltale'), r_regionkey + 1)").alias("kind"),
        (F.col("r_regionkey") * 15).alias("bx"), (F.col("r_regionkey") * 10).alias("by"), F.lit(60).alias("bw"), F.lit(40).alias("bh"),
    )


def _cropped(spark: SparkSession, sf: str) -> DataFrame:
    p = views.table(spark, sf, "lineitem").select(
        F.expr("l_orderkey DIV 64").alias("frame"), (F.col("l_partkey") % 130).cast("int").alias("x"),
        (F.col("l_suppkey") % 90).cast("int").alias("y"), (F.col("l_quantity").cast("int") * 5).alias("lum"),
    )
    return lb.crop(p, _rois(spark, sf))


@q("m01_roi_crop", with_views("SELECT frame, name, COUNT(*) AS n_pixels, CAST(SUM(x-bx) AS BIGINT) AS sum_x, CAST(SUM(y-by_) AS BIGINT) AS sum_y FROM crop GROUP BY ALL", "crop"))
def roi_crop(spark: SparkSession, sf: str) -> DataFrame:
    return _cropped(spark, sf).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_pixels"), F.sum((F.col("x") - F.col("bx")).cast("long")).alias("sum_x"), F.sum((F.col("y") - F.col("by")).cast("long")).alias("sum_y")
    )


@q("m02_telltale_state", with_views("""
SELECT frame, name, ROUND(b,6) AS brightness, b>0.5 AS "on" FROM (SELECT frame, name, AVG(lum)/CASE WHEN MAX(lum)>1 THEN 255.0::DOUBLE ELSE 1 END AS b FROM crop GROUP BY ALL)""", "crop"))
def telltale_state(spark: SparkSession, sf: str) -> DataFrame:
    return lb.telltale_state(_cropped(spark, sf), KEYS).withColumn("brightness", F.round("brightness", 6))


cte("needle", "SELECT frame, name, (MAX(lum)+MIN(lum))/2.0::DOUBLE AS mid, COUNT(*) AS size FROM crop GROUP BY ALL", "crop")
cte("ang", """
SELECT frame, name, COUNT(*) FILTER (lum<mid) AS n, CASE WHEN ANY_VALUE(size)>=9 AND COUNT(*) FILTER (lum<mid)>=5 THEN
  (DEGREES(ATAN2(2.0::DOUBLE*COVAR_POP(x-bx, y-by_) FILTER (lum<mid), VAR_POP(x-bx) FILTER (lum<mid) - VAR_POP(y-by_) FILTER (lum<mid))/2.0::DOUBLE) + 180.0::DOUBLE) % 180.0::DOUBLE END AS angle
FROM crop JOIN needle USING (frame, name) GROUP BY ALL""", "crop", "needle")


@q("m03_needle_angle", with_views("SELECT frame, name, n, ROUND(angle,6) AS angle FROM ang", "ang"))
def needle_angle(spark: SparkSession, sf: str) -> DataFrame:
    return lb.needle_angle(_cropped(spark, sf), KEYS).withColumn("angle", F.round("angle", 6))


@q("m04_angle_value", with_views("""
SELECT frame, name, ROUND(CASE WHEN name='ASIA' THEN 10.0::DOUBLE ELSE 10+(angle-20)/(160-20)*(240.0::DOUBLE-10) END,6) AS value FROM ang""", "ang"))
def angle_value(spark: SparkSession, sf: str) -> DataFrame:
    a = lb.needle_angle(_cropped(spark, sf), KEYS)
    top = F.when(F.col("name") == "ASIA", 20.0).otherwise(160.0)
    v = lb.angle_to_value(F.col("angle"), F.lit(20.0), top, F.lit(10.0), F.lit(240.0))
    return a.select(*KEYS, F.round(v, 6).alias("value"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    e = views.sensors_e(spark, sf)
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.format_string("%d km/h", "k")).when(kind == 1, F.format_string("-%d.5", "k"))
        .when(kind == 2, F.lit("--")).when(kind == 3, F.concat(F.lit(" "), F.get(F.array(*[F.lit(x) for x in ("P", "R", "n", "D3", "4", "x")]), (F.col("k") % 6))))
        .otherwise(F.lit(""))
    )
    return e.select("session_id", "event_id", "t", "k", text.alias("text"))


cte("txt", """
SELECT session_id, event_id, t, k, CASE event_id%5 WHEN 0 THEN printf('%d km/h', k) WHEN 1 THEN printf('-%d.5', k) WHEN 2 THEN '--' WHEN 3 THEN ' ' || ['P','R','n','D3','4','x'][k%6+1] ELSE '' END AS text FROM sens""", "sens")


@q("m05_text_number", with_views("SELECT session_id, event_id, ROUND(TRY_CAST(regexp_replace(text, '[^0-9.\\-]', '', 'g') AS DOUBLE)*0.1::DOUBLE,6) AS value FROM txt", "txt"))
def text_number(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("session_id", "event_id", F.round(lb.text_number(F.col("text"), 0.1), 6).alias("value"))


@q("m06_gear_code", with_views("""
SELECT session_id, event_id, CASE c WHEN 'P' THEN 0 WHEN 'R' THEN -1 WHEN 'N' THEN 1 WHEN 'D' THEN 2 WHEN '' THEN NULL ELSE CAST(c AS INT) END::DOUBLE AS gear FROM (SELECT *, regexp_extract(upper(text), '[PRND0-9]') AS c FROM txt)""", "txt"))
def gear_code(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("session_id", "event_id", lb.gear_code(F.col("text")).alias("gear"))


@q("m07_every_nth_frame", with_views("SELECT session_id, event_id AS frame, t, text FROM txt WHERE event_id%3=0", "txt"))
def every_nth(spark: SparkSession, sf: str) -> DataFrame:
    x = _texts(spark, sf).withColumnRenamed("event_id", "frame")
    return lb.every_nth(x.select("session_id", "frame", "text"), x.select("session_id", "frame", "t"))


@q("m08_routed_labels", with_views("""
SELECT session_id, CASE kind WHEN 'telltale' THEN 'telltales' WHEN 'gear' THEN 'gear' ELSE 'dashboard_ocr' END AS stream,
  CASE WHEN session_id='0' THEN 'video' WHEN k%3=0 THEN 'photos' WHEN k%3=1 THEN 'video' WHEN kind IN ('digits','gear') THEN 'photos' ELSE 'video' END AS source, kind || '_1' AS name, COUNT(*) AS n
FROM (SELECT *, ['digits','telltale','needle','gear'][CAST(event_id%4 AS INT)+1] AS kind FROM txt WHERE regexp_matches(text, '[0-9]')) GROUP BY ALL""", "txt"))
def routed_labels(spark: SparkSession, sf: str) -> DataFrame:
    x = _texts(spark, sf)
    kind = F.get(F.array(*[F.lit(v) for v in ("digits", "telltale", "needle", "gear")]), (F.col("event_id") % 4).cast("int"))
    wanted = F.when(F.col("k") % 3 == 0, "photos").when(F.col("k") % 3 == 1, "video").otherwise("auto")
    value = F.when(F.col("text").rlike("[0-9]"), 1.0)
    rows = x.select(
        "session_id", kind.alias("kind"), wanted.alias("wanted"), F.concat(kind, F.lit("_1")).alias("name"), value.alias("value"),
        (F.col("session_id") != "0").alias("have_photos"),
    )
    return lb.roi_counts(lb.route(rows))
