"""Registered queries: Structured Streaming jobs (N), run to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalspark.context import cut_lineage, fresh_path
from signalspark.operators.fleet import scan_parts
from signalspark.plans import views
from signalspark.plans.q_fleet import STATUS, parts_o
from signalspark.plans.registry import Family
from signalspark.plans.sqlviews import with_views
from signalspark.streaming import jobs, stateful

FAMILY = Family()
q = FAMILY.query
#: A landing slice holds a quarter of the 30 days of data, and the files of a
#: slice arrive in any order, so clocks may be that far apart.
SLICES = 4
DELAY_S = 8 * 86400
DELAY = f"{DELAY_S} seconds"
#: No id is silent for longer than the data lasts.
SILENCE_MS = 90 * 86400 * 1000
FILES = 4
LANDED = ("session_id", "arb_id", "t_mono", "row_seq", "data", "direction", "is_extended")


def _land(frames: DataFrame, name: str, slices: int = SLICES) -> str:
    """Frames as a landing folder, filled by successive writes in time order.

    The file source takes files by modification time, which is random inside one
    write but ascends from one write to the next.
    """
    path = fresh_path(frames.sparkSession, name)
    frames = cut_lineage(frames.select(*LANDED), name)
    low, high = frames.agg(F.min("t_mono"), F.max("t_mono")).first()
    if low is None:
        frames.write.parquet(path)
        return path
    step = max((high - low) / slices, 1e-6)
    slice_no = F.least(F.floor((F.col("t_mono") - low) / step), F.lit(slices - 1))
    for i in range(slices):
        _drop(frames.filter(slice_no == i), path)
    return path


def _drop(frames: DataFrame, path: str) -> None:
    """One more write into a landing folder."""
    frames.select(*LANDED).write.mode("append").parquet(path)


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return jobs.frame_stream(spark, _land(views.frames_e(spark, sf), name))


def _marker(spark: SparkSession, landed: str) -> DataFrame:
    """A frame a year behind all others, which lets the watermark pass them."""
    return spark.read.schema(jobs.FRAME_STREAM).parquet(landed).agg(F.max("t_mono").alias("t")).select(
        F.lit("flush").alias("session_id"), F.lit(0).cast("long").alias("arb_id"), (F.col("t") + 366 * 86400.0).alias("t_mono"),
        F.lit(-1).cast("long").alias("row_seq"), F.unhex(F.lit("00")).alias("data"), F.lit("rx").alias("direction"), F.lit(False).alias("is_extended"),
    )


def _checkpoint(spark: SparkSession, name: str) -> str:
    return fresh_path(spark, f"{name}-checkpoint")


@q("n01_append_stream", with_views("SELECT session_id, arb_id, COUNT(*) AS n, CAST(SUM(rn) AS BIGINT) AS seq_sum FROM fe GROUP BY ALL", "fe"))
def append_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of the frames arrives twice; the sink keeps each once."""
    f = views.frames_e(spark, sf)
    landed = _land(f.unionByName(f.filter("row_seq % 10 = 3")), "n01")
    out = fresh_path(spark, "n01-bronze")
    jobs.append_frames(jobs.frame_stream(spark, landed), out, _checkpoint(spark, "n01"), DELAY)
    return spark.read.parquet(out).groupBy("session_id", "arb_id").agg(F.count(F.lit(1)).alias("n"), F.sum("row_seq").alias("seq_sum"))


COUNTS = "SELECT session_id, FLOOR(t/86400)*86400.0::DOUBLE AS window_start, COUNT(*) AS frames, CAST(SUM(4) AS BIGINT) AS payload_bytes FROM fe GROUP BY ALL"


@q("n02_live_counts", with_views(COUNTS, "fe"))
def live_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = jobs.live_counts(_stream(spark, sf, "n02"), DELAY, "1 day")
    return jobs.latest_updates(c, ["session_id", "window_start"], _checkpoint(spark, "n02"))


@q("n03_rolling_census", with_views("""
, x AS (SELECT *, FLOOR(t/86400)*86400.0::DOUBLE AS ws FROM fe WHERE direction='rx'),
y AS (SELECT *, FIRST_VALUE(p) OVER w AS p0, LAST_VALUE(p) OVER w AS pl, LAST_VALUE(hx) OVER w AS hl FROM x WINDOW w AS (PARTITION BY session_id, arb_id, ws ORDER BY t, rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
c AS (SELECT session_id, arb_id, ws, string_agg(pos, ',' ORDER BY pos) AS ch FROM (SELECT DISTINCT session_id, arb_id, ws, i AS pos FROM y, range(0,4) r(i) WHERE p[i+1]<>p0[i+1]) GROUP BY ALL),
b AS (SELECT session_id, arb_id, ws, COUNT(*) AS n, MIN(t) AS t0, MAX(t) AS t1, ANY_VALUE(pl) AS pl, ANY_VALUE(hl) AS hl FROM y GROUP BY ALL)
SELECT session_id, arb_id, ws AS window_start, n, 4 AS dlc, CASE WHEN n>1 AND t1>t0 THEN ROUND((t1-t0)/(n-1)*1000.0::DOUBLE,3) END AS period_ms, COALESCE(ch,'') AS changing_bytes, hl AS sample_hex,
  array_to_string(list_transform(pl, lambda v: CASE WHEN v>=32 AND v<127 THEN chr(v) ELSE '.' END),'') AS sample_ascii FROM b LEFT JOIN c USING (session_id, arb_id, ws)""", "fe"))
def rolling_census(spark: SparkSession, sf: str) -> DataFrame:
    c = jobs.rolling_census(_stream(spark, sf, "n03"), DELAY, "1 day")
    return jobs.latest_updates(c, ["session_id", "arb_id", "window_start"], _checkpoint(spark, "n03"))


@q("n04_payload_tracking", with_views("""
, x AS (SELECT *, FIRST_VALUE(p) OVER w AS p0, FIRST_VALUE(hx) OVER w AS h0, LAST_VALUE(hx) OVER w AS hl FROM fe WHERE direction='rx' WINDOW w AS (PARTITION BY session_id, arb_id ORDER BY t, rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
c AS (SELECT session_id, arb_id, string_agg(pos, ',' ORDER BY pos) AS ch FROM (SELECT DISTINCT session_id, arb_id, i AS pos FROM x, range(0,4) r(i) WHERE p[i+1]<>p0[i+1]) GROUP BY ALL)
SELECT session_id, arb_id, COUNT(*) AS n, ANY_VALUE(h0) AS first_hex, ANY_VALUE(hl) AS last_hex, COALESCE(ANY_VALUE(ch),'') AS changing_bytes, TRUE AS silent FROM x LEFT JOIN c USING (session_id, arb_id) GROUP BY ALL""", "fe"))
def payload_tracking(spark: SparkSession, sf: str) -> DataFrame:
    """Every id falls silent behind a marker a year later: its last row comes from its timer."""
    landed, checkpoint, out = _land(views.frames_e(spark, sf), "n04"), _checkpoint(spark, "n04"), fresh_path(spark, "n04-tracks")

    def run() -> DataFrame:
        tracks = stateful.track_payloads(jobs.frame_stream(spark, landed, 2 * FILES), DELAY, SILENCE_MS)
        with stateful.rocksdb_state(spark):
            return jobs.latest_updates(tracks, ["session_id", "arb_id"], checkpoint, out)

    run()
    _drop(_marker(spark, landed), landed)
    return run().filter("session_id <> 'flush'")


@q("n05_session_completeness", with_views(STATUS + """
, np AS (SELECT session_id, COUNT(DISTINCT folder) AS parts FROM scan GROUP BY ALL)
SELECT session_id, np.parts, CASE WHEN complete THEN 'merged' ELSE 'awaiting' END AS status, CASE WHEN roles='edge' THEN 'companion' WHEN roles='companion' THEN 'edge' ELSE '' END AS missing FROM stt JOIN np USING (session_id)""", "scan"))
def session_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Parts arrive a second of ``part_seq`` apart, from a day behind the first watermark on; who still waits behind the marker is told by a timer."""
    path, checkpoint, out = fresh_path(spark, "n05"), _checkpoint(spark, "n05"), fresh_path(spark, "n05-status")
    scanned = scan_parts(parts_o(spark, sf)).select("session_id", "folder", "role", F.timestamp_seconds(F.col("part_seq") + 86400).alias("ts"))
    # a file is a batch: a slice's parts of a session lie in one file, and files do not grow in number
    scanned = cut_lineage(scanned.repartition("session_id").coalesce(FILES), "n05-parts")
    low, high = scanned.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    step = max(1, -(-(high - low + 1) // SLICES)) if low is not None else 1

    def land(rows: DataFrame) -> None:
        rows.write.mode("append").parquet(path)

    def run() -> DataFrame:
        parts = spark.readStream.schema(scanned.schema).option("maxFilesPerTrigger", 1).parquet(path)
        status = stateful.session_completeness(parts, f"{step + 1} seconds", wait_ms=1000 * step, keep_ms=1000 * SLICES * step)
        with stateful.rocksdb_state(spark):
            return jobs.latest_updates(status, ["session_id"], checkpoint, out)

    # the file source takes files by modification time, which ascends from one write to the next
    for i in range(SLICES):
        land(scanned.filter(F.floor((F.unix_seconds("ts") - F.lit(low)) / step) == i))
    run()
    land(scanned.agg(F.max("ts").alias("ts")).select(
        F.lit("flush").alias("session_id"), F.lit("flush").alias("folder"), F.lit("edge").alias("role"), (F.col("ts") + F.expr("INTERVAL 100 YEARS")).alias("ts")
    ))
    return run().filter("session_id <> 'flush'")


@q("n06_recordings_by_gap", with_views("""
, g AS (SELECT session_id, t, SUM(CASE WHEN t-pt<3600 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY t, rn) AS no FROM (SELECT *, LAG(t) OVER (PARTITION BY session_id ORDER BY t, rn) AS pt FROM fe))
SELECT session_id, COUNT(*) AS frames, MIN(t) AS t_start, MAX(t) AS t_end FROM g GROUP BY session_id, no""", "fe"))
def recordings_by_gap(spark: SparkSession, sf: str) -> DataFrame:
    """A marker a year later, landed after the first run has ended, closes the last recordings."""
    f = views.frames_e(spark, sf)
    landed, checkpoint, out = _land(f, "n06"), _checkpoint(spark, "n06"), fresh_path(spark, "n06-recordings")
    run = lambda: jobs.recordings_by_gap(jobs.frame_stream(spark, landed), DELAY, "1 hour")
    jobs.appended(run(), checkpoint, out)
    _drop(_marker(spark, landed), landed)
    return jobs.appended(run(), checkpoint, out).filter("session_id <> 'flush'")


@q("n07_cadence_windows", with_views("""
, x AS (SELECT session_id, arb_id, t, rn, (FLOOR(t/43200)-o)*43200.0::DOUBLE AS window_start FROM fe, range(0,2) r(o)),
g AS (SELECT *, t-LAG(t) OVER (PARTITION BY session_id, arb_id, window_start ORDER BY t, rn) AS g FROM x),
a AS (SELECT session_id, arb_id, window_start, COUNT(*) AS n, CASE WHEN COUNT(*)<3 THEN 0 WHEN AVG(g)>0 THEN STDDEV_POP(g)/AVG(g) ELSE 1 END AS cv FROM g GROUP BY ALL)
SELECT session_id, arb_id, window_start, n, ROUND(cv,6) AS jitter, CASE WHEN n<3 THEN 'on_demand' WHEN cv<=0.25 THEN 'periodic' ELSE 'sporadic' END AS role FROM a""", "fe"))
def cadence_windows(spark: SparkSession, sf: str) -> DataFrame:
    c = jobs.cadence_windows(_stream(spark, sf, "n07"), DELAY, "24 hours", "12 hours")
    return jobs.latest_updates(c, ["session_id", "arb_id", "window_start"], _checkpoint(spark, "n07"))


@q("n08_late_repair", with_views("""
, m AS (SELECT MAX(t) AS t FROM fe WHERE rn % 50 <> 7),
w AS (SELECT session_id, rn, FLOOR(t/86400)*86400.0::DOUBLE AS window_start FROM fe)
SELECT session_id, window_start, COUNT(*) AS frames, CAST(SUM(4) AS BIGINT) AS payload_bytes,
  CAST(COUNT_IF(rn % 50 = 7 AND window_start + 86400 <= (SELECT t FROM m) - 8*86400) AS BIGINT) AS late_frames FROM w GROUP BY ALL""", "fe"))
def late_repair(spark: SparkSession, sf: str) -> DataFrame:
    """One frame in fifty lands after the others: the live job drops those behind its watermark, a batch job repairs their windows."""
    f = views.frames_e(spark, sf)
    late = F.col("row_seq") % 50 == 7
    landed, checkpoint, out = _land(f.filter(~late), "n08"), _checkpoint(spark, "n08"), fresh_path(spark, "n08-counts")
    keys = ["session_id", "window_start"]
    count = lambda frames: jobs.live_counts(frames, DELAY, "1 day")
    jobs.latest_updates(count(jobs.frame_stream(spark, landed)), keys, checkpoint, out)
    arrivals = cut_lineage(f.filter(late).select(*LANDED), "n08-late")
    _drop(arrivals, landed)
    live = jobs.latest_updates(count(jobs.frame_stream(spark, landed)), keys, checkpoint, out)
    return jobs.repair_windows(live, jobs.timed(spark.read.schema(jobs.FRAME_STREAM).parquet(landed)), jobs.timed(arrivals), count, keys, "1 day")
