"""Registered queries: time-series core (D) and value filters (B4, B6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalspark.context import cut_lineage
from signalspark.functions import stats
from signalspark.operators import tseries as ts
from signalspark.operators.references import numeric
from signalspark.operators.warping import dtw_similarity
from signalspark.plans import views
from signalspark.plans.registry import Family
from signalspark.plans.sqlviews import cte, pearson_sql, resample_sql, with_views

FAMILY = Family()
q = FAMILY.query

HOURLY = 1.0 / 7200.0
HZ = "CAST(1.0 AS DOUBLE)/CAST(7200.0 AS DOUBLE)"
GAP_S = 3 * 86400.0
DAY = 86400.0
HALF_DAY = 43200.0
EVENT_ORDER = ("t", "event_id")

cte("egrid", f"""
SELECT session_id, MAX(s) AS t0, MIN(e) AS t1, CAST(FLOOR((MIN(e)-MAX(s))*({HZ})) AS BIGINT)+1 AS n_grid FROM (
  SELECT session_id, name, MIN(t) AS s, MAX(t) AS e FROM series_e GROUP BY ALL) GROUP BY ALL HAVING MIN(e)>MAX(s)""", "series_e")
cte("eres", resample_sql("series_e", "egrid", "session_id, name", "session_id", HZ, "259200", "t, event_id"), "series_e", "egrid")

cte("sigl", "SELECT session_id, arb_id, t, raw::DOUBLE AS v FROM fl", "fl")
cte("refid", "SELECT session_id, CAST(SUBSTR(name,5) AS BIGINT) AS arb_id, t, v FROM refs_l", "refs_l")
cte("pgrid", """
SELECT session_id, arb_id, MAX(s) AS t0, CAST(FLOOR((MIN(e)-MAX(s))*10.0::DOUBLE) AS BIGINT)+1 AS n_grid FROM (
  SELECT session_id, arb_id, MIN(t) AS s, MAX(t) AS e FROM sigl GROUP BY ALL UNION ALL
  SELECT session_id, arb_id, MIN(t) AS s, MAX(t) AS e FROM refid GROUP BY ALL) GROUP BY ALL HAVING MIN(e)>MAX(s)""", "sigl", "refid")
cte("psig", resample_sql("sigl", "pgrid", "session_id, arb_id", "session_id, arb_id", "10.0::DOUBLE", "2.0"), "sigl", "pgrid")
cte("pref", resample_sql("refid", "pgrid", "session_id, arb_id", "session_id, arb_id", "10.0::DOUBLE", "2.0"), "refid", "pgrid")

PAIR = ["session_id", "arb_id"]
USER = ["session_id"]


def _event_grid(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = views.series_e(spark, sf)
    return s, ts.common_grid(ts.spans(s, ["session_id", "name"]), USER, HOURLY)


def _event_resampled(spark: SparkSession, sf: str) -> DataFrame:
    s, grid = _event_grid(spark, sf)
    return ts.resample(s, grid, ["session_id", "name"], USER, HOURLY, GAP_S, HALF_DAY * 10, EVENT_ORDER)


def pair_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every id's signal and its own reference on their pair grid."""
    # payloads are neither packed nor stored: both sides come from the planted signal
    frames = cut_lineage(views.frames_l(spark, sf).select(*PAIR, "t_mono", "t_utc", "raw"), "frames")
    sig, ref = views.signals_l(spark, sf, frames), views.refs_by_id(spark, sf, frames)
    both = ts.spans(sig, PAIR).unionByName(ts.spans(ref, PAIR))
    grid = ts.common_grid(both, PAIR, 10.0)
    return ts.resample(sig, grid, PAIR, PAIR, 10.0, 2.0), ts.resample(ref, grid, PAIR, PAIR, 10.0, 2.0)


@q("b04_numeric_samples", with_views("""
SELECT session_id, name, COUNT(*) AS n, COUNT(TRY_CAST(value AS DOUBLE)) AS n_numeric, SUM(TRY_CAST(value AS DOUBLE)) AS total FROM samp GROUP BY ALL""", "samp"))
def numeric_samples(spark: SparkSession, sf: str) -> DataFrame:
    v = views.samples_l(spark, sf).withColumn("v", numeric())
    return v.groupBy("session_id", "name").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_numeric"), F.sum("v").alias("total")
    )


@q("b06_joint_finite", with_views("""
SELECT a.session_id, a.name AS x_name, b.name AS y_name, COUNT(*) AS n_joint, ROUND(SUM(a.v*b.v),4) AS dot
FROM eres a JOIN eres b ON a.session_id=b.session_id AND a.gi=b.gi AND a.name<b.name GROUP BY ALL""", "eres"))
def joint_finite(spark: SparkSession, sf: str) -> DataFrame:
    """Every two of a session's five series."""
    x, y = stats.both(F.col("x"), F.col("y"))
    return _name_pairs(_event_resampled(spark, sf)).groupBy("session_id", "x_name", "y_name").agg(
        F.count(x).alias("n_joint"), F.round(F.sum(x * y), 4).alias("dot")
    ).filter("n_joint > 0")


def _name_pairs(r: DataFrame) -> DataFrame:
    """Values of every two named series of a session at the grid points that both have."""
    at = r.groupBy("session_id", "gi").agg(F.sort_array(F.collect_list(F.struct("name", "v"))).alias("s"))
    at = at.select("session_id", "gi", "s", F.posexplode("s").alias("i", "a"))
    return at.select("session_id", "gi", "a", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("b")).select(
        "session_id", "gi", F.col("a.name").alias("x_name"), F.col("b.name").alias("y_name"),
        F.col("a.v").alias("x"), F.col("b.v").alias("y"),
    )


@q("d01_resample", with_views("SELECT session_id, name, gi, ROUND(v,6) AS v FROM eres", "eres"))
def resample(spark: SparkSession, sf: str) -> DataFrame:
    return _event_resampled(spark, sf).withColumn("v", F.round("v", 6))


@q("d02_common_grid", with_views("SELECT session_id, t0, t1, n_grid FROM egrid", "egrid"))
def common_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _event_grid(spark, sf)[1]


@q("d03_pearson", with_views(f"""
SELECT a.session_id, a.name AS x_name, b.name AS y_name, COUNT(*) AS n, ROUND({pearson_sql('a.v', 'b.v')},6) AS r
FROM eres a JOIN eres b ON a.session_id=b.session_id AND a.gi=b.gi AND a.name<b.name GROUP BY ALL""", "eres"))
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    return _name_pairs(_event_resampled(spark, sf)).groupBy("session_id", "x_name", "y_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(stats.pearson(F.col("x"), F.col("y")), 6).alias("r")
    )


@q("d04_best_lag", with_views(f"""
, sc AS (SELECT s.session_id, s.arb_id, k, {pearson_sql('r.v', 's.v')} AS r FROM psig s, range(-50,51) kk(k)
  JOIN pref r ON r.session_id=s.session_id AND r.arb_id=s.arb_id AND r.gi=s.gi+k GROUP BY ALL)
SELECT session_id, arb_id, k/10.0::DOUBLE AS lag, ROUND(r,6) AS r FROM sc
QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id, arb_id ORDER BY ROUND(ABS(r),9) DESC, k)=1""", "psig", "pref"))
def best_lag(spark: SparkSession, sf: str) -> DataFrame:
    sig, ref = pair_sides(spark, sf)
    return ts.best_lag(ref, sig, PAIR, 10.0, 5.0).withColumn("r", F.round("r", 6))


@q("d05_linear_fit", with_views(f"""
SELECT s.session_id, s.arb_id, COUNT(*) AS n, ROUND(REGR_SLOPE(r.v, s.v),6) AS scale, ROUND(REGR_INTERCEPT(r.v, s.v),6) AS "offset", ROUND({pearson_sql('s.v', 'r.v')},6) AS r
FROM psig s JOIN pref r ON r.session_id=s.session_id AND r.arb_id=s.arb_id AND r.gi=s.gi-7 GROUP BY ALL""", "psig", "pref"))
def linear_fit(spark: SparkSession, sf: str) -> DataFrame:
    sig, ref = pair_sides(spark, sf)
    j = ts.series_pairs(sig, ref.withColumn("gi", F.col("gi") + 7), PAIR)
    return ts.linear_fit(j, PAIR).select(*PAIR, "n", *[F.round(c, 6).alias(c) for c in ("scale", "offset", "r")])


MI_SQL = """
, {p}j AS ({src}),
{p}r AS (SELECT {k}, COUNT(*)::DOUBLE AS n, MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1 FROM {p}j GROUP BY ALL HAVING COUNT(*)>=32 AND STDDEV_POP(x)>=1e-12 AND STDDEV_POP(y)>=1e-12),
{p}c AS (SELECT {k}, LEAST(FLOOR((x-x0)/(x1-x0)*16),15) AS bx, LEAST(FLOOR((y-y0)/(y1-y0)*16),15) AS by_, n, COUNT(*)::DOUBLE AS c FROM {p}j JOIN {p}r USING ({k}) GROUP BY ALL),
{p}m AS (SELECT *, SUM(c) OVER (PARTITION BY {k}, bx) AS a, SUM(c) OVER (PARTITION BY {k}, by_) AS b FROM {p}c),
{p}mi AS (SELECT {k}, SUM(c/n*LN(c*n/(a*b))) AS mi FROM {p}m GROUP BY ALL)"""


@q("d06_mutual_information", with_views(MI_SQL.format(p="d6", k="session_id, arb_id", src="SELECT s.session_id, s.arb_id, s.v AS x, r.v AS y FROM psig s JOIN pref r USING (session_id, arb_id, gi)") + """
SELECT session_id, arb_id, ROUND(mi,6) AS mi FROM d6mi""", "psig", "pref"))
def mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    sig, ref = pair_sides(spark, sf)
    return ts.mutual_information(ts.series_pairs(sig, ref, PAIR), PAIR).withColumn("mi", F.round("mi", 6))


@q("d07_dtw_similarity")
def dtw(spark: SparkSession, sf: str) -> DataFrame:
    sig, ref = pair_sides(spark, sf)
    return dtw_similarity(ts.series_pairs(sig, ref, PAIR), PAIR).withColumn("similarity", F.round("similarity", 6))


@q("d08_derivative", with_views("""
, x AS (SELECT session_id, name, event_id, t, v, LAG(t) OVER w AS tp, LAG(v) OVER w AS vp, LEAD(t) OVER w AS tn, LEAD(v) OVER w AS vn FROM series_e WINDOW w AS (PARTITION BY session_id, name ORDER BY t, event_id))
SELECT session_id, name, event_id, ROUND(CASE WHEN tp IS NULL AND tn IS NULL THEN 0 WHEN tp IS NULL THEN (vn-v)/(tn-t) WHEN tn IS NULL THEN (v-vp)/(t-tp)
  ELSE ((t-tp)*(t-tp)*vn + ((tn-t)*(tn-t)-(t-tp)*(t-tp))*v - (tn-t)*(tn-t)*vp)/((t-tp)*(tn-t)*((tn-t)+(t-tp))) END, 6) AS dv FROM x""", "series_e"))
def derivative(spark: SparkSession, sf: str) -> DataFrame:
    d = ts.derivative(views.series_e(spark, sf), ["session_id", "name"], 10 * DAY, EVENT_ORDER)
    return d.select("session_id", "name", "event_id", F.round("dv", 6).alias("dv"))
