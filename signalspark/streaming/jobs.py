"""Live logs as Structured Streaming jobs.

Sources are folders of Parquet files; ``ts`` is the event time.  Every job
takes its watermark delay from the caller: the clock error the recorders can
have, which also bounds the state that is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalspark.context import fresh_path
from signalspark.functions.payload import ascii_preview, to_bytes
from signalspark.operators.frames import KEY

#: Longest payload of the record format (fixed value).
MAX_PAYLOAD = 64
FRAME_STREAM = (
    "session_id STRING, arb_id BIGINT, t_mono DOUBLE, row_seq BIGINT, data BINARY, direction STRING, is_extended BOOLEAN"
)


def frame_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    raw = spark.readStream.schema(FRAME_STREAM).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return timed(raw)


def timed(frames: DataFrame) -> DataFrame:
    """Frames with their event time ``ts``."""
    return frames.withColumn("ts", F.timestamp_micros((F.col("t_mono") * 1e6).cast("long")))


def run_to_end(query_writer) -> None:
    """Process what is available now and stop."""
    query_writer.trigger(availableNow=True).start().awaitTermination()


def append_frames(stream: DataFrame, path: str, checkpoint: str, delay: str) -> None:
    """Append frames once each, replays within the delay dropped."""
    once = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([*KEY, "row_seq"])
    run_to_end(once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append"))


def latest_updates(updates: DataFrame, keys: list[str], checkpoint: str, path: str | None = None) -> DataFrame:
    """Run an updating aggregate and return the last state of every key.

    A later run on the same checkpoint and ``path`` goes on where this one ended.

    Each micro-batch is written with its number; a replayed batch overwrites its
    own folder, so a lost executor or driver changes nothing.
    """
    spark = updates.sparkSession
    path = path or fresh_path(spark, "updates")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_to_end(updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update"))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in updates.schema.fields)
    out = spark.read.schema(f"{ddl}, batch BIGINT").option("basePath", path).parquet(f"{path}/batch=*")
    cols = [c for c in updates.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("s")).select(*keys, "s.*")


def live_counts(frames: DataFrame, delay: str, width: str = "1 second") -> DataFrame:
    """Frames and distinct-free byte totals per session and tumbling window."""
    w = frames.withWatermark("ts", delay) if frames.isStreaming else frames
    return w.groupBy("session_id", F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("frames"), F.sum(F.octet_length("data").cast("long")).alias("payload_bytes")
    ).select("session_id", F.col("w.start").cast("double").alias("window_start"), "frames", "payload_bytes")


def _quad(j: int, pad: str):
    """Four bytes of a payload as a number; bytes past its end are ``pad``, which an OR or an AND passes over.

    NULL when the payload ends before them: an OR or an AND passes over that too, and nothing is converted.
    """
    value = f"CAST(conv(hex(rpad(substring(data, {4 * j + 1}, 4), 4, X'{pad}')), 16, 10) AS BIGINT)"
    return F.expr(f"CASE WHEN octet_length(data) > {4 * j} THEN {value} END")


def rolling_census(frames: DataFrame, delay: str, width: str = "10 seconds") -> DataFrame:
    """Message census per capture window in one aggregation.

    Bits that are not the same in all payloads of a window show up in OR xor
    AND, so changing bytes need neither a second pass nor state of their own.
    """
    w = frames.withWatermark("ts", delay) if frames.isStreaming else frames
    rx = w.filter("direction = 'rx'")
    quads = range(MAX_PAYLOAD // 4)
    order = F.struct("t_mono", "row_seq")
    a = rx.groupBy(*KEY, F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.min("t_mono").alias("t0"), F.max("t_mono").alias("t1"),
        F.max(F.octet_length("data")).alias("dlc"), F.max_by("data", order).alias("last"),
        F.min_by(F.octet_length("data"), order).alias("first_len"),
        F.array(*[F.bit_or(_quad(j, "00")).bitwiseXOR(F.bit_and(_quad(j, "FF"))) for j in quads]).alias("diff"),
    )
    span = F.col("t1") - F.col("t0")
    # a byte that no payload has differs in its padding only, and lies past the first one's end
    changing = F.filter(
        F.sequence(F.lit(0), F.lit(MAX_PAYLOAD - 1)),
        lambda i: (i < F.col("first_len"))
        & (F.call_function("shiftright", F.element_at("diff", F.floor(i / 4).cast("int") + 1), (3 - i % 4) * 8).bitwiseAND(F.lit(255)) != 0),
    )
    return a.select(
        *KEY, F.col("w.start").cast("double").alias("window_start"), "n", "dlc",
        F.when((F.col("n") > 1) & (span > 0), F.round(span / (F.col("n") - 1) * 1000.0, 3)).alias("period_ms"),
        F.array_join(changing.cast("array<string>"), ",").alias("changing_bytes"),
        F.lower(F.hex("last")).alias("sample_hex"), ascii_preview(to_bytes("last")).alias("sample_ascii"),
    )


def cadence_windows(frames: DataFrame, delay: str, width: str = "10 seconds", slide: str = "5 seconds", cv_periodic: float = 0.25) -> DataFrame:
    """Cadence class per id and sliding window; a window's times are bounded by the bus rate."""
    w = frames.withWatermark("ts", delay) if frames.isStreaming else frames
    a = w.groupBy(*KEY, F.window("ts", width, slide).alias("w")).agg(F.sort_array(F.collect_list("t_mono")).alias("t"))
    n = F.size("t")
    gaps = F.zip_with(F.slice("t", 2, F.greatest(n - 1, F.lit(1))), F.slice("t", 1, F.greatest(n - 1, F.lit(1))), lambda b, c: b - c)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    x = a.select(*KEY, F.col("w.start").cast("double").alias("window_start"), n.cast("long").alias("n"), gaps.alias("g"))
    m = x.withColumn("mean", F.when(F.col("n") >= 3, total("g") / (F.col("n") - 1)))
    var = total(F.transform("g", lambda d: (d - F.col("mean")) * (d - F.col("mean")))) / (F.col("n") - 1)
    cv = F.when(F.col("n") < 3, 0.0).when(F.col("mean") > 0, F.sqrt(var) / F.col("mean")).otherwise(1.0)
    return m.select(
        *KEY, "window_start", "n", F.round(cv, 6).alias("jitter"),
        F.when(F.col("n") < 3, "on_demand").when(cv <= cv_periodic, "periodic").otherwise("sporadic").alias("role"),
    )


def recordings_by_gap(frames: DataFrame, delay: str, gap: str) -> DataFrame:
    """Recordings of a session separated by silence longer than ``gap``."""
    w = frames.withWatermark("ts", delay) if frames.isStreaming else frames
    return w.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("frames"), F.min("t_mono").alias("t_start"), F.max("t_mono").alias("t_end")
    ).select("session_id", "frames", "t_start", "t_end")


def appended(stream: DataFrame, checkpoint: str, path: str | None = None) -> DataFrame:
    """Run an appending query into a table and return it; later runs on the same checkpoint and ``path`` go on."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, "appended")
    run_to_end(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append"))
    return spark.read.schema(stream.schema).parquet(path)


def repair_windows(
    live: DataFrame, bronze: DataFrame, arrivals: DataFrame, recompute: Callable[[DataFrame], DataFrame], keys: list[str], width: str
) -> DataFrame:
    """Live windows, those that ``arrivals`` touch computed again from all rows, and how many rows the live job had missed.

    Only the rows of touched windows are read again; ``keys`` are the session and
    the window's start, ``width`` the length of a window.
    """
    start = F.window("ts", width)["start"].cast("double").alias(keys[-1])
    touched = arrivals.select(*keys[:-1], start).distinct()
    rows = bronze.select("*", start).join(touched, keys, "left_semi").select(*bronze.columns)
    again = recompute(rows)
    seen = live.select(*keys, F.col("frames").alias("_live"))
    again = again.join(seen, keys, "left").withColumn("late_frames", F.col("frames") - F.coalesce("_live", F.lit(0))).drop("_live")
    return live.join(touched, keys, "left_anti").withColumn("late_frames", F.lit(0).cast("long")).unionByName(again)
