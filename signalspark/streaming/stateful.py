"""Jobs with state of their own: timers in event time, and state that ends.

State lives in the RocksDB store, beside the heap, and is written as changes.
A key's timer counts from its newest row, so it runs out when the watermark has
passed that by the given time; what it emits does not depend on batch bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from signalspark.operators.frames import KEY

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRACK_OUT = "session_id string, arb_id long, n long, first_hex string, last_hex string, changing_bytes string, silent boolean"
STATUS_OUT = "session_id string, parts long, status string, missing string"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which timers and map state need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _newest_ms(ts: pd.Series) -> int:
    return int(ts.max().value // 1_000_000)


def _ms(ts: datetime) -> int:
    return (ts - (_EPOCH if ts.tzinfo else _EPOCH.replace(tzinfo=None))) // timedelta(milliseconds=1)


class PayloadTracker(StatefulProcessor):
    """First and last payload of an id, and the least and greatest value of each of its bytes, as one value.

    Every call to the state costs more than a row, so a batch of an id reads and writes it once, and the
    timer is not moved with every batch: one that finds newer rows sets itself again behind those.
    """

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState(
            "facts", "n long, first_t double, first_seq long, first binary, last_t double, last_seq long, last binary, newest long, low binary, high binary"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        had = self.facts.get()
        n, ft, fs, first, lt, ls, last, newest, low, high = had or (0, np.inf, 0, b"", -np.inf, 0, b"", -(1 << 62), b"", b"")
        low, high = (np.frombuffer(bytes(x), np.uint8) for x in (low, high))
        for pdf in rows:
            t, seq, data = pdf["t_mono"].to_numpy(), pdf["row_seq"].to_numpy(), pdf["data"].to_list()
            order = np.lexsort((seq, t))
            a, z = order[0], order[-1]
            if (t[a], seq[a]) < (ft, fs):
                ft, fs, first = float(t[a]), int(seq[a]), bytes(data[a])
            if (t[z], seq[z]) > (lt, ls):
                lt, ls, last = float(t[z]), int(seq[z]), bytes(data[z])
            for size in set(map(len, data)):
                part = [d for d in data if len(d) == size]
                m = np.frombuffer(b"".join(part), np.uint8).reshape(len(part), size)
                low, high = _merged(np.minimum, low, m.min(0)), _merged(np.maximum, high, m.max(0))
            n += len(pdf)
            newest = max(newest, _newest_ms(pdf["ts"]))
        self.facts.update((n, ft, fs, first, lt, ls, last, newest, low.tobytes(), high.tobytes()))
        if not had:
            self.handle.registerTimer(newest + self.wait_ms)
        yield self.row(key, n, first, last, low, high, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, _, _, first, _, _, last, newest, low, high = self.facts.get()
        if newest + self.wait_ms > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(newest + self.wait_ms)
            return
        self.facts.clear()
        yield self.row(key, n, first, last, low, high, True)

    def close(self) -> None:
        pass

    @staticmethod
    def row(key, n, first, last, low, high, silent) -> pd.DataFrame:
        changing = [str(p) for p, (lo, hi) in enumerate(zip(low, high, strict=True)) if p < len(first) and lo != hi]
        return pd.DataFrame(
            {"session_id": [key[0]], "arb_id": [key[1]], "n": [n], "first_hex": [first.hex()], "last_hex": [last.hex()],
             "changing_bytes": [",".join(changing)], "silent": [silent]}
        )


def _merged(bound: np.ufunc, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bounds of two lists of bytes; the longer one's rest stays."""
    k = min(len(a), len(b))
    return np.concatenate([bound(a[:k], b[:k]), a[k:], b[k:]])


def track_payloads(stream: DataFrame, delay: str, silence_ms: int) -> DataFrame:
    """Counter and constant tracking of received ids, updated with every batch.

    An id without a frame for ``silence_ms`` (of event time, seen by the
    watermark) gets a last row with ``silent`` and its state goes; if it comes
    back, it starts anew.  State so holds the ids on the air, not all there ever were.
    """
    rows = stream.filter("direction = 'rx'").select(*KEY, "t_mono", "row_seq", "data", "ts").withWatermark("ts", delay)
    return rows.groupBy(*KEY).transformWithStateInPandas(PayloadTracker(silence_ms), TRACK_OUT, "update", "eventTime")


class CompletenessWatch(StatefulProcessor):
    """Which parts and roles of a session have come; parts by name, so a part that comes twice counts once.

    Rows come as rows and the state of a session is one value, as every call to the state and every frame
    made for a session costs more than its rows.  Of a session of many parts the names beyond ``INLINE`` are
    appended to a list, which only its own later batches read.  A timer is not moved with every batch: one that
    finds newer parts sets itself again behind those.
    """

    #: Names of parts that are written with a session's value.
    INLINE = 256

    def __init__(self, wait_ms: int, keep_ms: int) -> None:
        self.wait_ms, self.keep_ms = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "edge boolean, companion boolean, newest long, told boolean, n long, folders array<string>")
        self.done = handle.getValueState("done", "newest long, n long, folders array<string>")  # of a complete session that fell silent
        self.more = handle.getListState("more", "folders array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        had, over = self.seen.get(), None
        if had:
            edge, companion, newest, over, n, names = had  # the timer of a told session waits for its end
        elif over := self.done.get():
            edge, companion, (newest, n, names) = True, True, over
            self.done.clear()
        else:
            edge, companion, newest, n, names = False, False, -(1 << 62), 0, []
        names, latest, came = list(names), None, set()
        for r in rows:
            edge, companion = edge or r.role == "edge", companion or r.role == "companion"
            latest = r.ts if latest is None or r.ts > latest else latest
            came.add(r.folder)
        newest = max(newest, _ms(latest))
        came.difference_update(names)
        if n > len(names):
            for (stored,) in self.more.get():
                came.difference_update(stored)
        n += len(came)
        came = sorted(came, key=str)
        room = max(0, self.INLINE - len(names))
        if came[room:]:
            self.more.appendValue((came[room:],))
        self.seen.update((edge, companion, newest, False, n, names + came[:room]))
        if over:
            self.set_timer(newest + self.wait_ms)
        elif not had:
            self.handle.registerTimer(newest + self.wait_ms)
        if edge and companion:
            yield self.row(key, n, edge, companion)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, had = timerValues.getCurrentWatermarkInMs(), self.seen.get()
        state = self.seen if had else self.done
        edge, companion, newest, told, n, names = had or (True, True, *self._of_done())
        due = newest + self.wait_ms
        last = due + self.keep_ms
        if due > now or told and last > now:
            self.handle.registerTimer(last if told else due)
            return
        if not told and not (edge and companion):
            yield self.row(key, n, edge, companion)
        if last <= now:
            state.clear()
            if n > len(names):
                self.more.clear()
            return
        self.handle.registerTimer(last)
        if edge and companion:
            self.seen.clear()
            self.done.update((newest, n, names))
        else:
            self.seen.update((edge, companion, newest, True, n, names))

    def _of_done(self) -> tuple:
        newest, n, names = self.done.get()
        return newest, True, n, names

    def set_timer(self, at_ms: int) -> None:
        """Move the key's timer to ``at_ms``."""
        have = list(self.handle.listTimers())
        for t in have:
            if t != at_ms:
                self.handle.deleteTimer(t)
        if at_ms not in have:
            self.handle.registerTimer(at_ms)

    def close(self) -> None:
        pass

    @staticmethod
    def row(key, parts, edge, companion) -> Row:
        missing = ",".join(r for r, ok in (("edge", edge), ("companion", companion)) if not ok)
        return Row(session_id=key[0], parts=parts, status="awaiting" if missing else "merged", missing=missing)


def session_completeness(parts: DataFrame, delay: str, wait_ms: int, keep_ms: int) -> DataFrame:
    """``merged`` as soon as a session's edge and companion parts are there, ``awaiting`` when a timer finds one missing.

    ``parts`` has session_id, folder, role and ``ts``, a row per device.  The timer
    runs ``wait_ms`` after a session's newest part; what still waits then is told
    once and kept ``keep_ms`` more, so that a late part can complete it.  Of a complete
    one only the names of its parts are kept as long, so that a late part is counted
    with the others.  After that its state goes.
    """
    rows = parts.select("session_id", "folder", "role", "ts").withWatermark("ts", delay)
    return rows.groupBy("session_id").transformWithState(
        CompletenessWatch(wait_ms, keep_ms), STATUS_OUT, "update", "eventTime"
    )
