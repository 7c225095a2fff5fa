"""Registered queries: frame grouping, cadence, census (B, C17-C20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from signalspark.operators import frames as fr
from signalspark.context import cut_lineage
from signalspark.operators.fields import frame_history, frame_steps
from signalspark.operators.mux import detect_multiplexor
from signalspark.plans import views
from signalspark.plans.registry import Family
from signalspark.plans.sqlviews import with_views

FAMILY = Family()
q = FAMILY.query
DAY = 86400.0


@q("b01_organic_by_id", with_views("""
SELECT session_id, arb_id, COUNT(*) AS n, MIN(t) AS t_first, MAX(t) AS t_last
FROM fe WHERE direction='rx' GROUP BY ALL""", "fe"))
def organic_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return (
        fr.organic(views.frames_e(spark, sf))
        .groupBy(*fr.KEY)
        .agg(F.count(F.lit(1)).alias("n"), F.min("t_mono").alias("t_first"), F.max("t_mono").alias("t_last"))
    )


@q("b02_padded_payload", with_views("""
SELECT session_id, arb_id, rn AS row_seq, RPAD(h, CAST(MAX(LENGTH(h)) OVER (PARTITION BY session_id, arb_id) AS INT), '0') AS data_hex
FROM (SELECT *, CASE WHEN rn%3=0 THEN SUBSTR(hx,1,4) ELSE hx END AS h FROM fe)""", "fe"))
def padded_payload(spark: SparkSession, sf: str) -> DataFrame:
    f = views.frames_e(spark, sf)
    cut = f.withColumn("data", F.expr("CASE WHEN row_seq % 3 = 0 THEN substring(data, 1, 2) ELSE data END"))
    return fr.padded(cut).select(*fr.KEY, "row_seq", F.lower(F.hex("data")).alias("data_hex"))


@q("b03_period_estimate", with_views("""
SELECT session_id, arb_id, COUNT(*) AS n, ROUND(COALESCE(MEDIAN(g),0),6) AS period_s FROM (
  SELECT session_id, arb_id, t - LAG(t) OVER (PARTITION BY session_id, arb_id ORDER BY t, rn) AS g FROM fe) GROUP BY ALL""", "fe"))
def period_estimate(spark: SparkSession, sf: str) -> DataFrame:
    p = fr.period_estimate(views.frames_e(spark, sf), slice_s=DAY)
    return p.withColumn("period_s", F.round("period_s", 6))


@q("b05_min_samples", with_views("""
SELECT session_id, name, COUNT(*) AS n FROM series_e GROUP BY ALL HAVING COUNT(*) >= 8""", "series_e"))
def min_samples(spark: SparkSession, sf: str) -> DataFrame:
    from signalspark.operators.references import enough_samples

    return enough_samples(views.series_e(spark, sf).groupBy("session_id", "name").agg(F.count(F.lit(1)).alias("n")))


@q("c17_message_census", with_views("""
, x AS (SELECT *, FIRST_VALUE(p) OVER w AS p0, LAST_VALUE(p) OVER w AS pl, LAST_VALUE(hx) OVER w AS hl
  FROM fe WHERE direction='rx' WINDOW w AS (PARTITION BY session_id, arb_id ORDER BY t, rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
c AS (SELECT session_id, arb_id, string_agg(pos, ',' ORDER BY pos) AS changing FROM (
  SELECT DISTINCT session_id, arb_id, i AS pos FROM x, range(0,4) r(i) WHERE p[i+1] <> p0[i+1]) GROUP BY ALL),
b AS (SELECT session_id, arb_id, is_extended, COUNT(*) AS n, MAX(len(p)) AS dlc, MIN(t) AS t0, MAX(t) AS t1, ANY_VALUE(hl) AS hl, ANY_VALUE(pl) AS pl FROM x GROUP BY ALL)
SELECT session_id, CASE WHEN is_extended THEN printf('0x%08X', arb_id) ELSE printf('0x%03X', arb_id) END AS arb_hex, is_extended, n,
  CAST(dlc AS INT) AS dlc, CASE WHEN n>1 AND t1>t0 THEN ROUND((t1-t0)/(n-1)*1000.0::DOUBLE,3) END AS period_ms,
  COALESCE(changing,'') AS changing_bytes, hl AS sample_hex,
  array_to_string(list_transform(pl, lambda v: CASE WHEN v>=32 AND v<127 THEN chr(v) ELSE '.' END),'') AS sample_ascii
FROM b LEFT JOIN c USING (session_id, arb_id)""", "fe"))
def message_census(spark: SparkSession, sf: str) -> DataFrame:
    c = fr.message_census(views.frames_e(spark, sf))
    return c.drop("arb_id").withColumn("changing_bytes", F.array_join(F.col("changing_bytes").cast("array<string>"), ","))


ROLES = """
, g AS (SELECT session_id, arb_id, t - LAG(t) OVER (PARTITION BY session_id, arb_id ORDER BY t, rn) AS g FROM {src}),
a AS (SELECT session_id, arb_id, COUNT(*) AS n, AVG(g) AS m, STDDEV_POP(g) AS s FROM g GROUP BY ALL),
roles AS (SELECT session_id, arb_id, n, CASE WHEN n<3 THEN 0 ELSE m*1000 END AS period_ms,
  CASE WHEN n<3 THEN 0 WHEN m>0 THEN s/m ELSE 1 END AS jitter FROM a)"""


@q("c18_message_roles", with_views(ROLES.format(src="fe") + """
SELECT session_id, arb_id, n, ROUND(period_ms,3) AS period_ms, ROUND(jitter,6) AS jitter,
  CASE WHEN n<3 THEN 'on_demand' WHEN jitter<=0.25 THEN 'periodic' ELSE 'sporadic' END AS role FROM roles""", "fe"))
def message_roles(spark: SparkSession, sf: str) -> DataFrame:
    r = fr.message_roles(views.frames_e(spark, sf), slice_s=DAY)
    return r.withColumn("period_ms", F.round("period_ms", 3)).withColumn("jitter", F.round("jitter", 6))


MUX = """
, bc AS (SELECT session_id, arb_id, i AS pos, p[i+1] AS v FROM {src}, range(0,{w}) r(i)),
card AS (SELECT session_id, arb_id, pos, COUNT(DISTINCT v) AS nd, COUNT(*) AS m FROM bc GROUP BY ALL),
gg AS (SELECT f.session_id, f.arb_id, s.pos AS sel, o.pos AS oth, p[s.pos+1] AS sv, COUNT(*) AS n, AVG(p[o.pos+1]) AS mu,
    SUM(p[o.pos+1]::DOUBLE*p[o.pos+1]) AS q
  FROM {src} f JOIN card s ON f.session_id=s.session_id AND f.arb_id=s.arb_id AND s.nd BETWEEN 2 AND 16 AND s.m>=32
  JOIN card o ON f.session_id=o.session_id AND f.arb_id=o.arb_id AND o.nd>1 AND o.pos<>s.pos GROUP BY ALL),
gm AS (SELECT *, SUM(n*mu) OVER w / SUM(n) OVER w AS gmu FROM gg WINDOW w AS (PARTITION BY session_id, arb_id, sel, oth)),
eta AS (SELECT session_id, arb_id, sel, oth, CASE WHEN SUM(q)-SUM(n)*ANY_VALUE(gmu)*ANY_VALUE(gmu) < 1e-9 THEN 0
   ELSE SUM(n*(mu-gmu)*(mu-gmu))/(SUM(q)-SUM(n)*ANY_VALUE(gmu)*ANY_VALUE(gmu)) END AS eta2 FROM gm GROUP BY ALL),
sc AS (SELECT session_id, arb_id, sel, MAX(eta2) AS score FROM eta GROUP BY ALL HAVING MAX(eta2)>=0.5),
mux AS (SELECT session_id, arb_id, sel AS mux_byte, score FROM sc QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id, arb_id ORDER BY ROUND(score,12) DESC, sel)=1),
muxv AS (SELECT m.session_id, m.arb_id, m.mux_byte, m.score, list_sort(list(DISTINCT v)) AS vals FROM mux m JOIN bc ON bc.session_id=m.session_id AND bc.arb_id=m.arb_id AND bc.pos=m.mux_byte GROUP BY ALL)"""


@q("c19_bus_census", with_views(ROLES.format(src="fmux") + MUX.format(src="fmux", w=4) + """
SELECT r.session_id, r.arb_id, printf('0x%X', r.arb_id) AS arb_hex, r.n, ROUND(period_ms,3) AS period_ms, ROUND(jitter,6) AS jitter,
  CASE WHEN r.n<3 THEN 'on_demand' WHEN jitter<=0.25 THEN 'periodic' ELSE 'sporadic' END AS role, 4 AS width,
  CAST(mux_byte AS INT) AS mux_byte, array_to_string(vals, ',') AS mux_values, ROUND(score,6) AS mux_score
FROM roles r LEFT JOIN muxv USING (session_id, arb_id)""", "fmux"))
def bus_census(spark: SparkSession, sf: str) -> DataFrame:
    f = views.frames_mux(spark, sf)
    history = cut_lineage(frame_history(f, rx_only=False, payload_bytes=8), "history")
    roles = fr.message_roles(history)
    width = history.groupBy(*fr.KEY).agg(F.max("size").alias("width"))
    mux = detect_multiplexor(frame_steps(history))
    return (
        roles.join(width, fr.KEY)
        .join(mux, fr.KEY, "left")
        .select(
            *fr.KEY,
            F.format_string("0x%X", "arb_id").alias("arb_hex"),
            "n",
            F.round("period_ms", 3).alias("period_ms"),
            F.round("jitter", 6).alias("jitter"),
            "role",
            "width",
            "mux_byte",
            F.array_join(F.col("mux_values").cast("array<string>"), ",").alias("mux_values"),
            F.round("score", 6).alias("mux_score"),
        )
    )


@q("c20_census_top", with_views("""
SELECT session_id, arb_id, n, CAST(rk AS INT) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY n DESC, arb_id) AS rk
  FROM (SELECT session_id, arb_id, COUNT(*) AS n FROM fl GROUP BY ALL)) WHERE rk<=40""", "fl"))
def census_top(spark: SparkSession, sf: str) -> DataFrame:
    n = views.frames_l(spark, sf).groupBy(*fr.KEY).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("session_id").orderBy(F.desc("n"), "arb_id")
    return n.withColumn("rank", F.row_number().over(w)).filter("rank <= 40")
