from __future__ import annotations

import random
from datetime import datetime, timezone

import pandas as pd
import pytest
from pyspark.sql import Row, functions as F

from signalspark.context import fresh_path
from signalspark.operators.frames import message_census
from signalspark.plans import q_fleet, q_streaming
from signalspark.streaming import jobs, stateful

LANDED = "session_id string, arb_id long, t_mono double, row_seq long, data binary, direction string, is_extended boolean"


def _rows(n=400, seed=3, step=7.0):
    rng = random.Random(seed)
    return [("s%d" % (i % 2), 100 + i % 3, i * step + rng.random(), i, bytes(rng.randrange(256) for _ in range(rng.choice([3, 8, 20, 64]))), "rx", False) for i in range(n)]


@pytest.fixture
def land(spark, tmp_path):
    """Write rows as small files in random order, each file a write of its own."""

    def write(rows, files=5, seed=1):
        rows = list(rows)
        random.Random(seed).shuffle(rows)
        for k in range(files):
            spark.createDataFrame(rows[k::files], LANDED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return f"{tmp_path}/in"

    return write


def _frames(spark, rows):
    return jobs.timed(spark.createDataFrame(rows, LANDED))


def _set(df):
    return sorted(map(str, (r.asDict(recursive=True) for r in df.select(*sorted(df.columns)).collect())))


def test_append_keeps_each_row_once(spark, land):
    rows = _rows()
    path, out = land(rows + rows[:50]), fresh_path(spark, "bronze")
    jobs.append_frames(jobs.frame_stream(spark, path), out, fresh_path(spark, "c"), "1 day")
    assert sorted(r.row_seq for r in spark.read.parquet(out).collect()) == list(range(400))


def test_counts_and_census_match_the_batch_job(spark, land):
    rows = _rows()
    path = land(rows)
    for job, keys in ((jobs.live_counts, ["session_id", "window_start"]), (jobs.rolling_census, ["session_id", "arb_id", "window_start"]), (jobs.cadence_windows, ["session_id", "arb_id", "window_start"])):
        make = lambda df: job(df, "1 day")  # noqa: E731, B023
        got = jobs.latest_updates(make(jobs.frame_stream(spark, path)), keys, fresh_path(spark, "c"))
        assert _set(got) == _set(make(_frames(spark, rows)))


def test_census_of_wide_payloads_agrees_with_the_batch_census(spark):
    rows = [("s", 1, float(i), i, bytes([0, i % 2] + [7] * 30 + [i]), "rx", False) for i in range(9)] + [("s", 2, 1.0, 20, b"\x01\x02", "rx", False), ("s", 2, 2.0, 21, b"\x01\x03" + b"\x09" * 62, "rx", False)]
    live = {r.arb_id: r.changing_bytes for r in jobs.rolling_census(_frames(spark, rows), "1 day", "1 hour").collect()}
    batch = {r.arb_id: ",".join(map(str, r.changing_bytes)) for r in message_census(_frames(spark, rows)).collect()}
    assert live == batch == {1: "1,32", 2: "1"}


def test_recordings_close_behind_a_marker(spark, land):
    rows = [r for r in _rows() if not 1000 < r[2] < 2000]
    path, checkpoint, out = land(rows), fresh_path(spark, "c"), fresh_path(spark, "o")
    run = lambda: jobs.appended(jobs.recordings_by_gap(jobs.frame_stream(spark, path), "1 day", "10 minutes"), checkpoint, out)
    run()
    land([("flush", 0, 1e7, -1, b"", "rx", False)], files=1)
    got = run().filter("session_id <> 'flush'")
    assert _set(got) == _set(jobs.recordings_by_gap(_frames(spark, rows), "1 day", "10 minutes"))
    assert got.count() == 4


def test_late_windows_are_repaired(spark, land):
    rows = _rows(step=900.0)
    late = [r for r in rows if r[3] % 40 == 7]
    early = [r for r in rows if r[3] % 40 != 7]
    keys, checkpoint, out = ["session_id", "window_start"], fresh_path(spark, "c"), fresh_path(spark, "o")
    count = lambda df: jobs.live_counts(df, "2 days", "1 hour")
    # the files of the first landing are in order, so nothing of it is late
    for k in range(4):
        path = land(early[k * 97 : (k + 1) * 97 if k < 3 else None], files=1)
    jobs.latest_updates(count(jobs.frame_stream(spark, path)), keys, checkpoint, out)
    land(late, files=1)
    live = jobs.latest_updates(count(jobs.frame_stream(spark, path)), keys, checkpoint, out)
    got = jobs.repair_windows(live, _frames(spark, rows), _frames(spark, late), count, keys, "1 hour")
    assert _set(got.drop("late_frames")) == _set(count(_frames(spark, rows)))
    limit = max(r[2] for r in early) - 2 * 86400
    missed = sum(r[2] // 3600 * 3600 + 3600 <= limit for r in late)
    assert got.agg(F.sum("late_frames")).first()[0] == missed > 0


def _run(spark, make, keys, checkpoint, out):
    """The last rows of a stateful job, and how many keys its state still holds."""
    with stateful.rocksdb_state(spark):
        got = jobs.latest_updates(make(), keys, checkpoint, out)
        state = spark.read.format("statestore").option("path", checkpoint)
    return got, state


def test_tracked_ids_fall_silent_and_come_back(spark, land):
    rows = _rows(300)
    checkpoint, out = fresh_path(spark, "c"), fresh_path(spark, "o")
    for k in range(3):
        path = land(rows[k * 100 : (k + 1) * 100], files=1)
    make = lambda: stateful.track_payloads(jobs.frame_stream(spark, path), "20 minutes", 3_600_000)
    keys = ["session_id", "arb_id"]
    got, state = _run(spark, make, keys, checkpoint, out)
    own = {}
    for r in rows:
        own.setdefault((r[0], r[1]), []).append(r[4])

    def changing(data):
        low = [d[i] for d in data for i in range(len(d)) if i < len(data[0])]
        assert low
        return ",".join(str(i) for i in range(len(data[0])) if len({d[i] for d in data if i < len(d)}) > 1)

    seen = {(r.session_id, r.arb_id): (r.n, r.first_hex, r.last_hex, r.changing_bytes, r.silent) for r in got.collect()}
    assert seen == {k: (len(d), d[0].hex(), d[-1].hex(), changing(d), False) for k, d in own.items()}
    assert state.option("stateVarName", "facts").load().count() == len(own)
    # one id goes on two hours later; the others are then silent and forgotten, and it starts anew
    again = [("s0", 100, 2100.0 + 7200 + i, 1000 + i, bytes([i, 1]), "rx", False) for i in range(3)]
    land(again[:1], files=1)
    land(again[1:], files=1)
    got, state = _run(spark, make, keys, checkpoint, out)
    seen = {(r.session_id, r.arb_id): r for r in got.collect()}
    assert {k for k, r in seen.items() if r.silent} == set(own) - {("s0", 100)}
    assert all(seen[k].n == len(own[k]) for k in set(own) - {("s0", 100)})
    assert [(r.key.session_id, r.key.arb_id) for r in state.option("stateVarName", "facts").load().collect()] == [("s0", 100)]


def test_incomplete_sessions_are_told_by_a_timer_and_forgotten(spark, tmp_path):
    checkpoint, out, path = fresh_path(spark, "c"), fresh_path(spark, "o"), f"{tmp_path}/parts"

    def land(*rows):
        df = spark.createDataFrame(list(rows), "session_id string, folder string, role string, t double")
        df.select("session_id", "folder", "role", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(path)

    def make():
        parts = spark.readStream.schema("session_id string, folder string, role string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
        return stateful.session_completeness(parts, "1 second", wait_ms=60_000, keep_ms=600_000)

    def run():
        got, state = _run(spark, make, ["session_id"], checkpoint, out)
        return {tuple(r) for r in got.collect()}, {r.key.session_id for r in state.option("stateVarName", "seen").load().collect()}

    land(("a", "a1", "edge", 1.0), ("b", "b1", "edge", 2.0), ("c", "c1", "companion", 3.0))
    land(("a", "a2", "companion", 10.0), ("a", "a1", "edge", 10.0))
    assert run() == ({("a", 2, "merged", "")}, {"a", "b", "c"})
    # the timers of all three run out: b and c are told, a is done and goes
    land(("x", "x1", "edge", 100.0))
    assert run() == ({("a", 2, "merged", ""), ("b", 1, "awaiting", "companion"), ("c", 1, "awaiting", "edge")}, {"b", "c", "x"})
    # a part that is late, but in time, completes c
    land(("c", "c2", "edge", 200.0))
    told = {("a", 2, "merged", ""), ("b", 1, "awaiting", "companion"), ("c", 2, "merged", "")}
    rows, state = run()
    assert rows - {("x", 1, "awaiting", "companion")} == told and {"b", "c"} <= state
    # later still, b is forgotten too
    land(("y", "y1", "edge", 5000.0))
    land(("y", "y1", "edge", 9000.0))
    rows, state = run()
    assert told <= rows and state == {"y"}


def test_late_parts_of_complete_sessions_are_counted_with_the_others(spark, tmp_path):
    checkpoint, out, path = fresh_path(spark, "c"), fresh_path(spark, "o"), f"{tmp_path}/parts"

    def make():
        parts = spark.readStream.schema("session_id string, folder string, role string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
        return stateful.session_completeness(parts, "1 second", wait_ms=60_000, keep_ms=600_000)

    for rows in (
        [("a", "a1", "edge", 1.0), ("a", "a2", "companion", 2.0)], [("x", "x1", "edge", 100.0)], [("x", "x1", "edge", 110.0)],
        [("a", "a3", "edge", 200.0), ("a", "a1", "edge", 200.0)],
    ):
        df = spark.createDataFrame(rows, "session_id string, folder string, role string, t double")
        df.select("session_id", "folder", "role", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    got, _ = _run(spark, make, ["session_id"], checkpoint, out)
    assert {tuple(r) for r in got.collect() if r.session_id == "a"} == {("a", 3, "merged", "")}


def test_census_converts_no_bytes_a_payload_lacks(spark):
    from signalspark.streaming.jobs import _quad

    df = spark.createDataFrame([(bytes([1, 2, 3, 4, 5]),)], "data binary")
    assert tuple(df.select(_quad(0, "00"), _quad(1, "00"), _quad(1, "FF"), _quad(2, "00")).first()) == (
        0x01020304, 0x05000000, 0x05FFFFFF, None
    )


class _Handle:
    """Stands for the state of one key and counts what is asked of it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


def test_a_batch_of_a_tracked_id_reads_and_writes_its_state_once():
    handle, tracker = _Handle(), stateful.PayloadTracker(1000)
    tracker.init(handle)

    def batch(*rows):
        pdf = pd.DataFrame([(float(t), i, d) for i, (t, d) in enumerate(rows)], columns=["t_mono", "row_seq", "data"])
        (out,) = tracker.handleInputRows(("s", 1), iter([pdf.assign(ts=pd.to_datetime(pdf["t_mono"], unit="s"))]), None)
        return out.iloc[0]

    batch((1, b"\x01\x02"), (0, b"\x01"))
    assert (handle.calls, handle.timers) == (3, [2000])
    last = batch((5, b"\x01\x03\x09"))
    assert (handle.calls, handle.timers) == (5, [2000])
    assert (last.n, last.first_hex, last.last_hex, last.changing_bytes) == (3, "01", "010309", "")
    at = lambda ms: type("Values", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    assert list(tracker.handleExpiredTimer(("s", 1), at(3000), None)) == [] and handle.timers == [2000, 6000]
    (out,) = tracker.handleExpiredTimer(("s", 1), at(6000), None)
    assert out.iloc[0].silent and out.iloc[0].n == 3 and handle.value is None


class _Named(_Handle):
    """State variables of one key by name, with their timers and calls together."""

    def __init__(self):
        super().__init__()
        self.states = {}

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _Part(self))

    def getListState(self, name, schema):
        return self.getValueState(name, schema)

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class _Part:
    def __init__(self, handle):
        self.handle, self.value = handle, None

    def get(self):
        self.handle.calls += 1
        return self.value

    def update(self, value):
        self.handle.calls += 1
        self.value = value

    def appendValue(self, value):
        self.update([*(self.value or []), value])

    def clear(self):
        self.update(None)


def test_a_batch_of_a_session_reads_and_writes_its_state_once(monkeypatch):
    monkeypatch.setattr(stateful.CompletenessWatch, "INLINE", 3)
    handle, watch = _Named(), stateful.CompletenessWatch(1000, 5000)
    watch.init(handle)
    at = lambda ms: type("Values", (), {"getCurrentWatermarkInMs": lambda self: ms})()

    def batch(*parts):
        before = handle.calls
        rows = [Row(session_id="s", folder=f, role=r, ts=datetime.fromtimestamp(t, timezone.utc)) for f, r, t in parts]
        return [tuple(r) for r in watch.handleInputRows(("s",), iter(rows), None)], handle.calls - before

    def timer(ms):
        handle.timers.remove(min(handle.timers))
        return [tuple(r) for r in watch.handleExpiredTimer(("s",), at(ms), None)]

    assert batch(("a", "edge", 1), ("b", "edge", 2), ("a", "edge", 1)) == ([], 4) and handle.timers == [3000]
    assert batch(("b", "edge", 3)) == ([], 2) and handle.timers == [3000]
    assert timer(3500) == [] and handle.timers == [4000]
    assert timer(4500) == [("s", 2, "awaiting", "companion")] and handle.timers == [9000]
    # names beyond the first three lie in a list, and parts that come again are not counted again
    assert batch(*((f, "edge", 4) for f in "abcdef"))[0] == [] and handle.timers == [5000]
    assert batch(("f", "companion", 4), ("c", "edge", 4), ("g", "edge", 4))[0] == [("s", 7, "merged", "")]
    assert timer(5000) == [] and handle.states["seen"].value is None and handle.timers == [10000]
    assert batch(("h", "edge", 6), ("g", "edge", 6))[0] == [("s", 8, "merged", "")] and handle.timers == [7000]
    # a timer behind all of the time a session is kept ends it at once
    assert timer(12000) == [] and handle.timers == []
    assert all(s.value is None for s in handle.states.values())


def test_a_slice_of_many_files_brings_a_session_in_one_batch(spark, tmp_path, monkeypatch):
    rows = [(k, 1 + k % 20, "FOP"[k % 3], "1-URGENT", 1.0) for k in range(400)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double")
    orders.repartition(8).write.parquet(f"{tmp_path}/orders.parquet")
    paths, path = [], fresh_path
    monkeypatch.setattr(q_streaming, "fresh_path", lambda *a: paths.append(path(*a)) or paths[-1])
    got = q_streaming.session_completeness(spark, str(tmp_path)).collect()
    want = q_fleet.merge_status(spark, str(tmp_path)).collect()
    assert {(r.session_id, r.parts, r.status, r.missing) for r in got} == {(r.session_id, r.parts, r.status, r.missing) for r in want}
    files = spark.read.parquet(paths[0]).withColumn("file", F.input_file_name())
    files = files.filter("session_id <> 'flush'").withColumn("slice", F.floor((F.unix_seconds("ts") - 86400) / 100))
    assert files.count() == 400 + len([k for k in range(400) if k % 3 == 2])
    assert files.groupBy("slice", "session_id").agg(F.countDistinct("file").alias("n")).filter("n > 1").count() == 0
