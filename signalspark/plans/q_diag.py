"""Registered queries: recorded diagnostics (L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalspark.operators import diag
from signalspark.plans import views
from signalspark.plans.registry import Family
from signalspark.plans.sqlviews import cte, with_views

FAMILY = Family()
q = FAMILY.query

cte("dmsg", """
SELECT CAST(o%5 AS VARCHAR) AS session_id, 2024+o%8 AS arb_id, o*1.0::DOUBLE AS t, o,
  CASE o%4 WHEN 0 THEN '41' || ['04','0C','0D','2F','42','00','99'][CAST(o%7 AS INT)+1] || printf('%02X%02X1357', o%256, (o//256)%256)
    WHEN 1 THEN '5902FF' || codes WHEN 2 THEN '62' || ['F190','F18C','F1AA'][CAST(o%3 AS INT)+1] || texts || CASE WHEN o%5=0 THEN '01' ELSE '' END
    ELSE '7F22' || ['31','7F','22','F5','44'][CAST(o%5 AS INT)+1] END AS hx
FROM (SELECT l_orderkey AS o, string_agg(printf('%04X%02X%02X', l_partkey%65536, l_suppkey%256, CAST(l_quantity AS INT)), '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS codes,
  string_agg(hex(printf('P%05d', l_partkey)), '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS texts FROM lineitem GROUP BY 1)
UNION ALL SELECT DISTINCT CAST(l_orderkey%5 AS VARCHAR), 2024+l_orderkey%8, l_orderkey*1.0::DOUBLE+0.0005::DOUBLE, l_orderkey, '7F2278' FROM lineitem WHERE l_orderkey%10 IN (1,6)""")


def diag_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as one diagnostic response, cut into transport frames."""
    li = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"))
    line = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "q",
        F.format_string("%04X%02X%02X", F.col("l_partkey") % 65536, F.col("l_suppkey") % 256, "q").alias("code"),
        F.hex(F.format_string("P%05d", "l_partkey")).alias("text"),
    )
    o = li.groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    hx = F.expr(
        "CASE o % 4 WHEN 0 THEN concat('41', element_at(array('04','0C','0D','2F','42','00','99'), CAST(o % 7 AS INT) + 1),"
        " format_string('%02X%02X1357', o % 256, (o DIV 256) % 256))"
        " WHEN 1 THEN concat('5902FF', array_join(lines.code, ''))"
        " WHEN 2 THEN concat('62', element_at(array('F190','F18C','F1AA'), CAST(o % 3 AS INT) + 1), array_join(lines.text, ''), CASE WHEN o % 5 = 0 THEN '01' ELSE '' END)"
        " ELSE concat('7F22', element_at(array('31','7F','22','F5','44'), CAST(o % 5 AS INT) + 1)) END"
    )
    m = o.select("o", hx.alias("hx")).withColumn("n", F.expr("CAST(length(hx) DIV 2 AS INT)"))
    k = F.when(F.col("n") <= 7, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil((F.col("n") - 6) / 7).cast("int")))
    f = m.withColumn("k", F.explode(k))
    frame = F.expr(
        "CASE WHEN n <= 7 THEN concat(format_string('%02X', n), hx) WHEN k = 0 THEN concat(format_string('1%03X', n), substring(hx, 1, 12))"
        " ELSE concat(format_string('2%X', k % 16), substring(hx, 13 + (k - 1) * 14, 14)) END"
    )
    f = f.select("o", "k", F.lit(0.0).alias("late"), F.unhex(frame).alias("data"))
    # a single frame right behind the first frame of a message
    waits = o.filter("o % 10 IN (1, 6)").select("o", F.lit(0).alias("k"), F.lit(0.0005).alias("late"), F.unhex(F.lit("037F2278")).alias("data"))
    return f.unionByName(waits).select(
        (F.col("o") % 5).cast("string").alias("session_id"), (F.col("o") % 8 + 2024).alias("arb_id"),
        (F.col("o") * 1.0 + F.col("k") * 0.001 + F.col("late")).alias("t_mono"), F.col("k").cast("long").alias("row_seq"), "data",
    )


def _pdus(spark: SparkSession, sf: str) -> DataFrame:
    return diag.reassemble(diag_frames(spark, sf), slice_s=4096.0)


@q("l01_response_ids", with_views(f"""
SELECT arb, ext, CASE WHEN ext THEN arb//256 = {0x18DAF100 // 256} ELSE arb BETWEEN 2024 AND 2031 END AS is_response,
  CASE WHEN ext THEN {0x18DA0000} + (arb%256)*256 + 241 ELSE arb-8 END AS request_id, n FROM (
  SELECT CASE WHEN is_extended THEN {0x18DAF100 - 0x300} + (arb_id-256)*4 ELSE 2016+(arb_id-256)%32 END AS arb, is_extended AS ext, COUNT(*) AS n FROM fe GROUP BY ALL)""", "fe"))
def response_ids(spark: SparkSession, sf: str) -> DataFrame:
    e = views.frames_e(spark, sf)
    user = F.col("arb_id") - 256
    x = e.select(F.when(F.col("is_extended"), user * 4 + (0x18DAF100 - 0x300)).otherwise(user % 32 + 2016).alias("arb"), F.col("is_extended").alias("ext"))
    x = x.groupBy("arb", "ext").agg(F.count(F.lit(1)).alias("n"))
    return x.select("arb", "ext", diag.is_diag_response(F.col("arb"), F.col("ext")).alias("is_response"), diag.request_id(F.col("arb"), F.col("ext")).alias("request_id"), "n")


@q("l02_reassemble", with_views("SELECT session_id, arb_id, t, CAST(LENGTH(hx)//2 AS INT) AS length, LOWER(hx) AS pdu_hex FROM dmsg", "dmsg"))
def reassemble(spark: SparkSession, sf: str) -> DataFrame:
    return _pdus(spark, sf).select("session_id", "arb_id", "t", "length", F.lower(F.hex("pdu")).alias("pdu_hex"))


@q("l03_obd_responses", with_views("SELECT session_id, arb_id, t, CAST('0x' || SUBSTR(hx,3,2) AS INT) AS pid, LOWER(SUBSTR(hx,5)) AS raw_hex FROM dmsg WHERE hx LIKE '41%'", "dmsg"))
def obd_responses(spark: SparkSession, sf: str) -> DataFrame:
    r = diag.obd_responses(_pdus(spark, sf))
    return r.select("session_id", "arb_id", "t", "pid", F.lower(F.hex("raw")).alias("raw_hex"))


@q("l04_supported_pids", with_views("""
SELECT DISTINCT session_id, arb_id, CAST(1+i AS INT) AS pid FROM (SELECT session_id, arb_id, CAST('0x' || SUBSTR(hx,5,8) AS BIGINT) AS m FROM dmsg WHERE hx LIKE '4100%'), range(0,32) r(i)
WHERE (m >> CAST(31-i AS INT)) & 1 = 1 AND 1+i NOT IN (0,32,64,96,128,160,192,224)""", "dmsg"))
def supported_pids(spark: SparkSession, sf: str) -> DataFrame:
    return diag.supported_pids(diag.obd_responses(_pdus(spark, sf)))


cte("dpid", """
SELECT *, CASE pid WHEN '0x04' THEN 'engine_load' WHEN '0x0C' THEN 'engine_rpm' WHEN '0x0D' THEN 'vehicle_speed' WHEN '0x2F' THEN 'fuel_level' WHEN '0x42' THEN 'control_module_voltage' END AS name,
  ROUND(CASE pid WHEN '0x04' THEN a*100.0::DOUBLE/255 WHEN '0x0C' THEN (256*a+b)/4.0::DOUBLE WHEN '0x0D' THEN a*1.0::DOUBLE WHEN '0x2F' THEN a*100.0::DOUBLE/255 WHEN '0x42' THEN (256*a+b)/1000.0::DOUBLE END,4) AS value,
  CASE pid WHEN '0x04' THEN '%' WHEN '0x0C' THEN 'rpm' WHEN '0x0D' THEN 'km/h' WHEN '0x2F' THEN '%' WHEN '0x42' THEN 'V' END AS unit
FROM (SELECT session_id, arb_id, t, '0x' || SUBSTR(hx,3,2) AS pid, LOWER(SUBSTR(hx,5)) AS raw, CAST('0x' || SUBSTR(hx,5,2) AS INT) AS a, CAST('0x' || SUBSTR(hx,7,2) AS INT) AS b FROM dmsg WHERE hx LIKE '41%')""", "dmsg")


@q("l05_decode_pids", with_views("SELECT session_id, arb_id, t, pid, raw, name, value, unit FROM dpid", "dpid"))
def decode_pids(spark: SparkSession, sf: str) -> DataFrame:
    return diag.decode_pids(diag.obd_responses(_pdus(spark, sf)))


cte("ddid", """
SELECT session_id, arb_id, t, CAST('0x' || SUBSTR(hx,3,4) AS INT) AS did, CASE SUBSTR(hx,3,4) WHEN 'F190' THEN 'vin' WHEN 'F18C' THEN 'ecu_serial_number' END AS name,
  LOWER(SUBSTR(hx,7)) AS raw_hex, CASE WHEN o%5=0 THEN LOWER(SUBSTR(hx,7)) ELSE decode(unhex(SUBSTR(hx,7))) END AS text FROM dmsg WHERE hx LIKE '62%'""", "dmsg")


@q("l06_did_responses", with_views("SELECT session_id, arb_id, t, did, name, raw_hex FROM ddid", "ddid"))
def did_responses(spark: SparkSession, sf: str) -> DataFrame:
    return diag.did_responses(_pdus(spark, sf)).select("session_id", "arb_id", "t", "did", "name", F.lower(F.hex("raw")).alias("raw_hex"))


@q("l07_did_text", with_views("SELECT session_id, arb_id, t, text FROM ddid", "ddid"))
def did_text(spark: SparkSession, sf: str) -> DataFrame:
    return diag.did_responses(_pdus(spark, sf)).select("session_id", "arb_id", "t", "text")


cte("ddtc", """
SELECT session_id, arb_id, t, CAST(i AS INT) AS i, CAST('0x' || SUBSTR(hx, CAST(7+i*8 AS INT), 6) AS BIGINT) AS dtc, CAST('0x' || SUBSTR(hx, CAST(13+i*8 AS INT), 2) AS INT) AS status FROM dmsg, LATERAL (SELECT UNNEST(range(0, (LENGTH(hx)-6)//8)) AS i) WHERE hx LIKE '5902%'""", "dmsg")


@q("l08_trouble_codes", with_views("SELECT session_id, arb_id, t, i, dtc, status FROM ddtc", "ddtc"))
def trouble_codes(spark: SparkSession, sf: str) -> DataFrame:
    return diag.trouble_codes(_pdus(spark, sf)).drop("code").withColumn("i", F.col("i").cast("int"))


@q("l09_trouble_code_text", with_views("""
SELECT code, COUNT(*) AS n FROM (SELECT ['P','C','B','U'][CAST((dtc>>22)&3 AS INT)+1] || ((dtc>>20)&3) || printf('%X%02X', (dtc>>16)&15, (dtc>>8)&255) AS code FROM ddtc) GROUP BY ALL""", "ddtc"))
def trouble_code_text(spark: SparkSession, sf: str) -> DataFrame:
    return diag.trouble_codes(_pdus(spark, sf)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@q("l10_negative_responses", with_views("""
SELECT session_id, arb_id, t, 34 AS service, CASE SUBSTR(hx,5,2) WHEN '31' THEN 'requestOutOfRange' WHEN '7F' THEN 'serviceNotSupportedInActiveSession' WHEN '22' THEN 'conditionsNotCorrect' WHEN 'F5' THEN '0xF5(mfr-specific)' ELSE '0x' || SUBSTR(hx,5,2) END AS reason FROM dmsg WHERE hx LIKE '7F%'""", "dmsg"))
def negative_responses(spark: SparkSession, sf: str) -> DataFrame:
    return diag.negative_responses(_pdus(spark, sf))


@q("l11_inventory", with_views("""
SELECT session_id, arb_id, 'pid' AS kind, pid AS item, COUNT(*) AS n FROM dpid GROUP BY ALL UNION ALL SELECT session_id, arb_id, 'did', printf('0x%04X', did), COUNT(*) FROM ddid GROUP BY ALL""", "dpid", "ddid"))
def inventory(spark: SparkSession, sf: str) -> DataFrame:
    p = _pdus(spark, sf)
    return diag.inventory(diag.obd_responses(p), diag.did_responses(p))


@q("l12_latest_samples", with_views("SELECT session_id, pid, MAX(t) AS t, (ARG_MAX({'v': value}, t)).v AS value, ARG_MAX(raw, t) AS raw FROM dpid GROUP BY ALL", "dpid"))
def latest_samples(spark: SparkSession, sf: str) -> DataFrame:
    return diag.latest_samples(diag.decode_pids(diag.obd_responses(_pdus(spark, sf))))


BUS = """
WITH s AS (SELECT 'can' || (l_suppkey%3) AS interface, [125000,250000,500000][CAST(l_partkey%3 AS INT)+1] AS bitrate, COUNT(*) AS frames, CAST(COUNT_IF(l_discount=0) AS BIGINT) AS errors FROM lineitem GROUP BY ALL),
r AS (SELECT *, CASE WHEN frames=0 THEN 0 ELSE frames-5.0::DOUBLE*errors END AS score FROM s),
k AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY interface ORDER BY score DESC, bitrate) AS INT) AS rank FROM r)
"""


@q("l13_bus_ranking", BUS + "SELECT interface, bitrate, frames, errors, score, rank, interface=(SELECT interface FROM k WHERE rank=1 ORDER BY frames DESC, interface DESC LIMIT 1) AND rank=1 AS busiest FROM k")
def bus_ranking(spark: SparkSession, sf: str) -> DataFrame:
    li = views.table(spark, sf, "lineitem")
    s = li.groupBy(
        F.concat(F.lit("can"), F.col("l_suppkey") % 3).alias("interface"),
        F.expr("element_at(array(125000, 250000, 500000), CAST(l_partkey % 3 AS INT) + 1)").alias("bitrate"),
    ).agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("l_discount") == 0).alias("errors"))
    k = diag.rank_bus_candidates(s)
    best = diag.busiest_interface(k).select("interface", F.lit(True).alias("hit"))
    return k.join(best, "interface", "left").select(
        "interface", "bitrate", "frames", "errors", "score", "rank", (F.coalesce("hit", F.lit(False)) & (F.col("rank") == 1)).alias("busiest")
    )


@q("l14_folded_samples", with_views("""
SELECT session_id, name, pid, unit, COUNT(*) AS n, ROUND(SUM(TRY_CAST(value AS DOUBLE)),4) AS total FROM (
  SELECT session_id, name, pid, CAST(value AS VARCHAR) AS value, unit FROM dpid WHERE name IS NOT NULL UNION ALL SELECT session_id, name, pid, value, unit FROM samp) GROUP BY ALL""", "dpid", "samp"))
def folded_samples(spark: SparkSession, sf: str) -> DataFrame:
    polled = diag.decode_pids(diag.obd_responses(_pdus(spark, sf)))
    s = diag.fold_samples(polled, views.samples_l(spark, sf))
    return s.groupBy("session_id", "name", "pid", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.expr("try_cast(value AS DOUBLE)")), 4).alias("total")
    )
