"""Registered queries: field decoding, candidates, behaviour, multiplexing (C1-C16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalspark.context import cut_lineage
from signalspark.functions.payload import all_fields, decode_int, field_label
from signalspark.operators import fields as fd
from signalspark.operators import frames as fr
from signalspark.operators import mux as mx
from signalspark.plans import views
from signalspark.plans.registry import Family
from signalspark.plans.sqlviews import cte, with_views

FAMILY = Family()
q = FAMILY.query


def dec_sql(p: str) -> str:
    raw = " + ".join(f"COALESCE({p}[off+{k + 1}],0)*c{k}" for k in range(4))
    return (
        f"CASE WHEN {p} IS NULL THEN NULL WHEN bit>=0 THEN ({p}[off+1] >> (7-bit%8)) & 1 "
        f"WHEN s=1 AND ({raw}) >= 2**(8*w-1) THEN CAST(({raw}) - 2**(8*w) AS BIGINT) ELSE {raw} END"
    )


def _weights(k: int) -> str:
    return f"CAST(CASE WHEN {k}>=w THEN 0 WHEN e='LE' THEN 256**{k} ELSE 256**(w-1-{k}) END AS BIGINT) AS c{k}"


cte("fspec", f"""
SELECT w, off, e, s, -1 AS bit, ROW_NUMBER() OVER (ORDER BY w, off, e, s)-1 AS seq, {', '.join(_weights(k) for k in range(4))}
FROM range(1,5) a(w), range(0,8) b(off), (VALUES ('BE'),('LE')) c(e), (VALUES (0),(1)) d(s)
WHERE off+w<=8 AND (w>1 OR e='BE')
UNION ALL SELECT 0, i//8, '', 0, i, 88+i, 0, 0, 0, 0 FROM range(0,64) r(i)""")
cte("fspec_l", """
SELECT *, CASE WHEN w=0 THEN '#bit' || bit ELSE '[' || off || ':' || (off+w) || ']' || e || CASE WHEN s=1 THEN 's' ELSE 'u' END END AS lab FROM fspec""", "fspec")
cte("fl_lag", """
SELECT *, LAG(p) OVER (PARTITION BY session_id, arb_id ORDER BY t, rn) AS pp FROM fl""", "fl")
cte("fv", f"""
SELECT session_id, arb_id, rn, seq, w, off, e, s, bit, lab, {dec_sql('p')} AS v, {dec_sql('pp')} AS pv
FROM fl_lag, fspec_l""", "fl_lag", "fspec_l")
cte("fst", """
SELECT session_id, arb_id, seq, w, off, e, s, bit, lab, COUNT(*) AS n, MIN(v) AS vmin, MAX(v) AS vmax,
  COALESCE(AVG(CASE WHEN pv IS NOT NULL THEN CASE WHEN v<>pv THEN 1.0::DOUBLE ELSE 0 END END),0) AS flip,
  COVAR_POP(CASE WHEN pv IS NOT NULL THEN v END, pv) AS cov, STDDEV_POP(CASE WHEN pv IS NOT NULL THEN v END) AS s0, STDDEV_POP(pv) AS s1,
  VAR_POP(v) AS vr FROM fv GROUP BY ALL""", "fv")
cte("fcnt", """
SELECT x.session_id, x.arb_id, x.seq, MEDIAN(x.v-x.pv) AS step, COUNT(*) AS nf, ANY_VALUE(n) AS n
FROM fv x JOIN fst y USING (session_id, arb_id, seq) WHERE ABS(x.v-x.pv) < 0.5::DOUBLE*(vmax-vmin+1) GROUP BY 1,2,3""", "fv", "fst")
cte("fctr", """
SELECT c.session_id, c.arb_id, c.seq, c.step FROM fcnt c JOIN fst y USING (session_id, arb_id, seq)
JOIN fv x USING (session_id, arb_id, seq)
WHERE c.n>=8 AND nf>=4 AND step<>0 AND ABS(x.v-x.pv) < 0.5::DOUBLE*(vmax-vmin+1)
GROUP BY ALL HAVING AVG(CASE WHEN x.v-x.pv=c.step THEN 1.0::DOUBLE ELSE 0 END) > 0.9""", "fcnt", "fst", "fv")
cte("fspread", """
SELECT session_id, arb_id, off, w, COUNT(*) AS nd, -SUM(c/tot*LOG2(c/tot)) AS ent FROM (
  SELECT session_id, arb_id, off, w, v, COUNT(*)::DOUBLE AS c, SUM(COUNT(*)) OVER (PARTITION BY session_id, arb_id, off, w)::DOUBLE AS tot
  FROM fv WHERE w IN (1,2) AND e='BE' AND s=0 GROUP BY session_id, arb_id, off, w, v) GROUP BY ALL""", "fv")
cte("fcand", """
SELECT st.*, printf('0x%X', arb_id) || lab AS label FROM fst st LEFT JOIN fspread sp USING (session_id, arb_id, off, w)
WHERE n>=8 AND vmax>vmin AND (w>0 OR flip<=0.45)
AND NOT EXISTS (SELECT 1 FROM fctr c WHERE c.session_id=st.session_id AND c.arb_id=st.arb_id AND c.seq=st.seq AND st.w>0)
AND NOT COALESCE(w=1 AND n>=16 AND s0>=1e-9 AND s1>=1e-9 AND nd/n>0.6 AND ABS(cov/(s0*s1))<0.2, FALSE)""", "fst", "fspread", "fctr")
cte("fclass", """
SELECT st.session_id, st.arb_id, st.seq, st.w, st.off, st.e, st.s, lab, n, vr,
  CASE WHEN vmin=vmax THEN 'constant' WHEN c.seq IS NOT NULL THEN 'counter'
    WHEN flip>=0.99 AND ent>6 AND (CASE WHEN n>2 AND s0>1e-12 AND s1>1e-12 THEN ABS(cov/(s0*s1)) ELSE 0 END)<0.3 THEN 'checksum'
    WHEN nd<=8 THEN 'switch' ELSE 'dynamic' END AS behaviour,
  CASE WHEN vmin=vmax THEN 0 ELSE flip END AS flip, CASE WHEN vmin=vmax THEN 0 ELSE nd/n END AS dr, CASE WHEN vmin=vmax THEN 0 ELSE ent END AS ent
FROM fst st JOIN fspread sp USING (session_id, arb_id, off, w) LEFT JOIN fctr c ON c.session_id=st.session_id AND c.arb_id=st.arb_id AND c.seq=st.seq
WHERE st.w IN (1,2)""", "fst", "fspread", "fctr")


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """Steps for one pass over the frames."""
    return fd.frame_steps(fd.frame_history(views.frames_l(spark, sf), payload_bytes=8))


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """Steps without predecessors, for value counts."""
    return fd.frame_steps(fd.frame_words(views.frames_l(spark, sf), payload_bytes=8))


def _stored_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Steps for several passes: the history is written once and scanned by each."""
    return fd.frame_steps(cut_lineage(fd.frame_history(views.frames_l(spark, sf), payload_bytes=8), "history"))


@q("c01_decode_int", with_views("""
SELECT session_id, arb_id, rn AS row_seq, CAST(p[2]*256+p[3] AS BIGINT) AS be_u16,
  CAST(CASE WHEN p[6]+256*p[7]>=32768 THEN p[6]+256*p[7]-65536 ELSE p[6]+256*p[7] END AS BIGINT) AS le_s16,
  CAST(p[2]*65536+p[3]*256+p[4] AS BIGINT) AS be_u24,
  CAST(CASE WHEN p[8]>=128 THEN p[5]+256*p[6]+65536*p[7]+16777216*p[8]::BIGINT-4294967296 ELSE p[5]+256*p[6]+65536*p[7]+16777216*p[8]::BIGINT END AS BIGINT) AS le_s32
FROM fl""", "fl"))
def decode_fields(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("data")
    return views.frames_l(spark, sf).select(
        *fr.KEY,
        "row_seq",
        decode_int(d, 1, 2).alias("be_u16"),
        decode_int(d, 5, 2, "LE", True).alias("le_s16"),
        decode_int(d, 1, 3).alias("be_u24"),
        decode_int(d, 4, 4, "LE", True).alias("le_s32"),
    )


@q("c02_enumerate_fields", with_views("""
SELECT session_id, arb_id, CAST(seq AS INT) AS seq, printf('0x%X', arb_id) || lab AS label, n, CAST(vmin AS BIGINT) AS vmin, CAST(vmax AS BIGINT) AS vmax
FROM fst""", "fst"))
def enumerate_fields(spark: SparkSession, sf: str) -> DataFrame:
    st = fd.field_ranges(_steps(spark, sf), all_fields())
    return st.select(*fr.KEY, "seq", field_label(F.col("arb_id")).alias("label"), "n", "vmin", "vmax")


@q("c04_informative_fields", with_views("""
SELECT session_id, arb_id, COUNT(*) AS n_fields, CAST(COUNT_IF(vmax>vmin) AS BIGINT) AS n_informative FROM fst WHERE w>0 GROUP BY ALL""", "fst"))
def informative_fields(spark: SparkSession, sf: str) -> DataFrame:
    st = fd.field_ranges(_steps(spark, sf), all_fields(bits=False))
    return st.groupBy(*fr.KEY).agg(
        F.count(F.lit(1)).alias("n_fields"), F.count_if(F.col("vmax") > F.col("vmin")).alias("n_informative")
    )


@q("c05_counter_fields", with_views("""
SELECT c.session_id, c.arb_id, CAST(c.seq AS INT) AS seq, CAST(step AS BIGINT) AS step FROM fctr c JOIN fspec f USING (seq) WHERE f.w>0""", "fctr", "fspec"))
def counter_fields(spark: SparkSession, sf: str) -> DataFrame:
    steps = _stored_steps(spark, sf)
    fields = all_fields(bits=False)
    ranges = cut_lineage(fd.field_ranges(steps, fields).filter("vmax > vmin"), "ranges")
    return fd.counter_fields(steps, ranges, fields)


@q("c06_checksum_bytes", with_views("""
SELECT session_id, arb_id, CAST(off AS INT) AS off, nd AS distinct_values, ROUND(nd/n,6) AS distinct_ratio, ROUND(ABS(cov/(s0*s1)),6) AS lag_corr,
  COALESCE(n>=16 AND nd/n>0.6 AND ABS(cov/(s0*s1))<0.2, FALSE) AS checksum
FROM fst JOIN fspread USING (session_id, arb_id, off, w) WHERE w=1 AND s=0 AND s0>=1e-9 AND s1>=1e-9""", "fst", "fspread"))
def checksum_bytes(spark: SparkSession, sf: str) -> DataFrame:
    steps = _stored_steps(spark, sf)
    st = fd.field_stats(steps, [f for f in all_fields(8, 1, False) if not f.signed]).withColumn("off", F.col("f.off"))
    spread = fd.byte_spread(steps, 1).select(*fr.KEY, "off", "distinct")
    j = st.filter("lag_std >= 1e-9").join(spread, [*fr.KEY, "off"])
    return j.select(
        *fr.KEY,
        "off",
        F.col("distinct").alias("distinct_values"),
        F.round(F.col("distinct") / F.col("n"), 6).alias("distinct_ratio"),
        F.round(F.abs("lag_corr"), 6).alias("lag_corr"),
        F.coalesce(fd.checksum_rule(F.col("distinct")), F.lit(False)).alias("checksum"),
    )


@q("c07_bit_fields", with_views("""
SELECT session_id, arb_id, printf('0x%X', arb_id) || lab AS label, ROUND(flip,6) AS toggle_rate FROM fst WHERE w=0 AND vmax>vmin AND flip<=0.45""", "fst"))
def bit_candidates(spark: SparkSession, sf: str) -> DataFrame:
    st = fd.field_ranges(_steps(spark, sf), [f for f in all_fields() if f.bit >= 0])
    return st.filter("vmax > vmin AND flip_rate <= 0.45").select(
        *fr.KEY, field_label(F.col("arb_id")).alias("label"), F.round("flip_rate", 6).alias("toggle_rate")
    )


@q("c08_candidates", with_views("""
SELECT session_id, label, n, CAST(vmin AS BIGINT) AS vmin, CAST(vmax AS BIGINT) AS vmax, ROUND(flip,6) AS flip_rate FROM fcand""", "fcand"))
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = fd.candidates(_stored_steps(spark, sf))
    return c.select("session_id", "label", "n", "vmin", "vmax", F.round("flip_rate", 6).alias("flip_rate"))


@q("c09_taxonomy", with_views("""
SELECT session_id, arb_id, CAST(seq AS INT) AS seq, behaviour, ROUND(flip,6) AS flip_rate, ROUND(dr,6) AS distinct_ratio, ROUND(ent,6) AS entropy, ROUND(flip*dr,6) AS theta
FROM fclass""", "fclass"))
def taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    c = fd.classify(_stored_steps(spark, sf))
    return c.select(
        *fr.KEY, "seq", "behaviour", *[F.round(x, 6).alias(x) for x in ("flip_rate", "distinct_ratio", "entropy", "theta")]
    )


@q("c10_byte_entropy", with_views("""
SELECT session_id, arb_id, CAST(off AS INT) AS off, nd AS distinct_values, ROUND(ent+0.0,6) AS entropy FROM fspread WHERE w=1""", "fspread"))
def byte_entropy(spark: SparkSession, sf: str) -> DataFrame:
    s = fd.byte_spread(_words(spark, sf), 1)
    return s.select(*fr.KEY, "off", F.col("distinct").alias("distinct_values"), F.round("entropy", 6).alias("entropy"))


FP = """
, fb AS (SELECT session_id, arb_id, i AS pos, p[i+1] AS v, p[i+1]-pp[i+1] AS d FROM fl_lag, range(0,8) r(i)),
fe1 AS (SELECT session_id, arb_id, pos, -SUM(c/t*LOG2(c/t)) AS ent, SUM(c) AS n FROM (SELECT session_id, arb_id, pos, v, COUNT(*)::DOUBLE AS c,
   SUM(COUNT(*)) OVER (PARTITION BY session_id, arb_id, pos)::DOUBLE AS t FROM fb GROUP BY session_id, arb_id, pos, v) GROUP BY ALL),
fc1 AS (SELECT session_id, arb_id, pos, AVG(CASE WHEN d IS NOT NULL THEN CASE WHEN d<>0 THEN 1.0::DOUBLE ELSE 0 END END) AS chg,
   MEDIAN(CASE WHEN ABS(d)<128 THEN d END) AS med, COUNT_IF(ABS(d)<128) AS ns FROM fb GROUP BY ALL),
fc2 AS (SELECT fb.session_id, fb.arb_id, fb.pos, AVG(CASE WHEN fb.d=med THEN 1.0::DOUBLE ELSE 0 END) AS sh FROM fb JOIN fc1 USING (session_id, arb_id, pos) WHERE ABS(fb.d)<128 GROUP BY ALL),
fp1 AS (SELECT session_id, arb_id, pos, ent, n, chg, COALESCE(n>8 AND ns>4 AND med<>0 AND sh>0.9, FALSE) AS ctr FROM fe1 JOIN fc1 USING (session_id, arb_id, pos) LEFT JOIN fc2 USING (session_id, arb_id, pos)),
per AS (SELECT session_id, arb_id, MEDIAN(g) AS period_s FROM (SELECT session_id, arb_id, t-LAG(t) OVER (PARTITION BY session_id, arb_id ORDER BY t, rn) AS g FROM fl) GROUP BY ALL),
fp AS (SELECT session_id, arb_id, CAST(MAX(n) AS BIGINT) AS n_frames, ANY_VALUE(period_s) AS period_s, CAST(COALESCE(MAX(CASE WHEN ctr THEN pos END),-1) AS INT) AS counter_byte,
  CAST(COALESCE(MAX(CASE WHEN n>8 AND ent>7 AND chg>0.6 AND NOT ctr THEN pos END),-1) AS INT) AS checksum_byte,
  list(ent ORDER BY pos) AS ents, list(chg ORDER BY pos) AS chgs FROM fp1 JOIN per USING (session_id, arb_id) GROUP BY session_id, arb_id)"""


@q("c11_fingerprint", with_views(FP + """
SELECT session_id, arb_id, n_frames, ROUND(period_s,6) AS period_s, counter_byte, checksum_byte,
  ROUND(list_sum(ents),6) AS entropy_sum, ROUND(list_sum(chgs),6) AS change_sum FROM fp""", "fl_lag"))
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    rows = _fingerprint(spark, sf)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        *fr.KEY,
        "n_frames",
        F.round("period_s", 6).alias("period_s"),
        "counter_byte",
        "checksum_byte",
        F.round(total("byte_entropy"), 6).alias("entropy_sum"),
        F.round(total("byte_change"), 6).alias("change_sum"),
    )


def _fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    history = cut_lineage(fd.frame_history(views.frames_l(spark, sf), payload_bytes=8), "history")
    return fd.fingerprint_rows(fd.fingerprint_bytes(fd.frame_steps(history)), fr.period_estimate(history))


@q("c12_fingerprint_vector", with_views(FP + """
SELECT session_id, arb_id, CAST(i-1 AS INT) AS pos, ROUND(vec[i],6) AS x FROM (SELECT session_id, arb_id,
  list_concat([period_s, LN(1+n_frames), CASE WHEN counter_byte>=0 THEN 1 ELSE 0 END::DOUBLE, CASE WHEN checksum_byte>=0 THEN 1 ELSE 0 END::DOUBLE], list_concat(ents, chgs)) AS vec FROM fp), range(1,21) r(i)""", "fl_lag"))
def fingerprint_vector(spark: SparkSession, sf: str) -> DataFrame:
    v = fd.fingerprint_vector(_fingerprint(spark, sf))
    return v.select(*fr.KEY, F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 6))


from signalspark.plans.q_frames import MUX  # noqa: E402


@q("c13_multiplexor", with_views(MUX.format(src="fmux", w=4) + """
SELECT session_id, arb_id, CAST(mux_byte AS INT) AS mux_byte, array_to_string(vals, ',') AS mux_values, ROUND(score,6) AS score FROM muxv""", "fmux"))
def multiplexor(spark: SparkSession, sf: str) -> DataFrame:
    m = mx.detect_multiplexor(_mux_steps(spark, sf))
    return m.select(
        *fr.KEY, "mux_byte", F.array_join(F.col("mux_values").cast("array<string>"), ",").alias("mux_values"),
        F.round("score", 6).alias("score"),
    )


def _mux_steps(spark: SparkSession, sf: str) -> DataFrame:
    return fd.frame_steps(cut_lineage(fd.frame_words(views.frames_mux(spark, sf), payload_bytes=8), "words"))


@q("c14_correlation_ratio", with_views(MUX.format(src="fmux", w=4) + """
SELECT session_id, arb_id, CAST(sel AS INT) AS sel, CAST(oth AS INT) AS other, ROUND(eta2,6) AS eta2 FROM eta""", "fmux"))
def correlation_ratio(spark: SparkSession, sf: str) -> DataFrame:
    steps = _mux_steps(spark, sf)
    return mx.correlation_ratios(steps, mx.selector_bytes(steps), 16).withColumn("eta2", F.round("eta2", 6))


MUXF = MUX.format(src="fmux", w=4) + """
, mf AS (SELECT f.session_id, f.arb_id, m.mux_byte, p[m.mux_byte+1] AS mux_value, w, off, e, s, lab, -1 AS bit, """ + dec_sql("p").replace("bit>=0", "FALSE") + """ AS v
  FROM fmux f JOIN mux m USING (session_id, arb_id), fspec_l WHERE w BETWEEN 1 AND 2 AND off+w<=4 AND NOT (off<=m.mux_byte AND m.mux_byte<off+w)),
mc AS (SELECT session_id, arb_id, mux_byte, mux_value, lab, COUNT(*) AS n, MIN(v) AS vmin, MAX(v) AS vmax FROM mf GROUP BY ALL HAVING COUNT(*)>=8 AND MAX(v)>MIN(v))"""


@q("c15_multiplexed_fields", with_views(MUXF + """
SELECT session_id, arb_id, CAST(mux_byte AS INT) AS mux_byte, CAST(mux_value AS INT) AS mux_value, n, CAST(vmin AS BIGINT) AS vmin, CAST(vmax AS BIGINT) AS vmax,
  printf('0x%X', arb_id) || '[m' || mux_byte || '=' || mux_value || ']' || lab AS label FROM mc""", "fmux", "fspec_l"))
def multiplexed_fields(spark: SparkSession, sf: str) -> DataFrame:
    steps = _mux_steps(spark, sf)
    return mx.extract_multiplexed(steps, mx.detect_multiplexor(steps)).drop("f")


@q("c16_mux_plain_candidates", with_views(MUXF + """
SELECT session_id, printf('0x%X', arb_id) || lab AS plain_label, COUNT(*) AS n_selector_values FROM mc GROUP BY ALL""", "fmux", "fspec_l"))
def mux_plain(spark: SparkSession, sf: str) -> DataFrame:
    steps = _mux_steps(spark, sf)
    m = mx.plain_candidate(mx.extract_multiplexed(steps, mx.detect_multiplexor(steps)))
    return m.groupBy("session_id", "plain_label").agg(F.count(F.lit(1)).alias("n_selector_values"))
