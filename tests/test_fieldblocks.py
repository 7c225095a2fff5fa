from __future__ import annotations

import math
import random
import statistics
from collections import Counter

import pytest

from helpers import frames, steps
from signalspark.functions.payload import all_fields, byte_fields
from signalspark.operators import fields as fd
from signalspark.operators import mux as mx
from test_fields import _value


@pytest.fixture
def small_batches(spark):
    """Batches that end inside every run of frames."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "7")
    yield
    spark.conf.unset(name)


def _recordings(spark):
    """Two ids over several slices of a minute, the second with a missing payload."""
    rng = random.Random(9)
    a = [bytes([i * 3 % 256, rng.randrange(256), 255, 255, 255, rng.randrange(3), i // 60, 7]) for i in range(150)]
    b = [bytes([i % 7, 250 if i < 120 else i % 250, 0, 1, rng.randrange(256), 9]) for i in range(130)]
    df = frames(spark, a, 0x100, step=1.1).unionByName(frames(spark, b, 0x101, step=0.9))
    return {0x100: a, 0x101: b}, df


def test_field_statistics_of_cut_runs(spark, small_batches):
    payloads, df = _recordings(spark)
    s = steps(df)
    fields = all_fields(8)
    got = {(r.arb_id, r.seq): r for r in fd.field_stats(s, fields).collect()}
    for arb, rows in payloads.items():
        width = len(rows[0])
        mine = [f for f in fields if f.off + max(f.width, 1) <= width]
        assert {q for a, q in got if a == arb} == {f.seq for f in mine}
        for f in mine:
            v, r = [_value(p, f) for p in rows], got[arb, f.seq]
            assert (r.n, r.vmin, r.vmax) == (len(v), min(v), max(v))
            assert r.flip_rate == pytest.approx(sum(x != y for x, y in zip(v, v[1:])) / (len(v) - 1))
            assert r.variance == pytest.approx(statistics.pvariance(v), rel=1e-12)
            spread = min(statistics.pstdev(v[1:]), statistics.pstdev(v[:-1]))
            assert r.lag_std == pytest.approx(spread, rel=1e-12)
            if spread:
                assert r.lag_corr == pytest.approx(statistics.correlation(v[1:], v[:-1]), abs=1e-9)


def test_counters_of_cut_runs(spark, small_batches):
    payloads, df = _recordings(spark)
    s = steps(df)
    fields = all_fields(8, 2, bits=False)
    got = {(r.arb_id, r.seq, r.step) for r in fd.counter_fields(s, fd.field_ranges(s, fields).filter("vmax > vmin"), fields).collect()}
    want = set()
    for arb, rows in payloads.items():
        for f in fields:
            if f.off + f.width > len(rows[0]):
                continue
            v = [_value(p, f) for p in rows]
            d = Counter(y - x for x, y in zip(v, v[1:]) if abs(y - x) < 0.5 * (max(v) - min(v) + 1))
            if max(v) > min(v) and d.total() >= 4 and d.most_common(1)[0][1] > 0.9 * d.total() and d.most_common(1)[0][0]:
                want.add((arb, f.seq, d.most_common(1)[0][0]))
    assert want and got == want


def test_value_counts_and_fingerprints_of_cut_runs(spark, small_batches):
    payloads, df = _recordings(spark)
    s = steps(df)
    got = {(r.arb_id, r.off, r.width, r.value): r.c for r in fd.value_counts(s, 2).collect()}
    want = Counter(
        (arb, o, w, int.from_bytes(p[o : o + w], "big")) for arb, rows in payloads.items() for p in rows for w in (1, 2) for o in range(len(p) - w + 1)
    )
    assert got == want
    for r in fd.fingerprint_bytes(s).collect():
        v = [p[r.pos] for p in payloads[r.arb_id]]
        share = [c / len(v) for c in Counter(v).values()]
        assert r.n == len(v) and r.entropy == pytest.approx(-sum(x * math.log2(x) for x in share), abs=1e-12)
        assert r.change_rate == pytest.approx(sum(x != y for x, y in zip(v, v[1:])) / (len(v) - 1))


def test_multiplexed_fields_of_cut_runs(spark, small_batches):
    rng = random.Random(4)
    rows = [bytes([i % 3, i % 3 * 80 + rng.randrange(40), rng.randrange(256), 5]) for i in range(200)]
    s = steps(frames(spark, rows, 0x200, step=0.7))
    m = mx.detect_multiplexor(s)
    got = {(r.mux_value, r.f.off, r.f.width, r.f.endian, r.f.signed): (r.n, r.vmin, r.vmax) for r in mx.extract_multiplexed(s, m).collect()}
    want = {}
    for f in byte_fields(4, 2):
        for k in range(3):
            v = [_value(p, f) for p in rows if p[0] == k]
            if f.off > 0 and max(v) > min(v):
                want[k, f.off, f.width, f.endian, f.signed] = (len(v), min(v), max(v))
    assert got == want


def test_frames_are_neither_copied_per_field_nor_shuffled_twice(spark):
    _, df = _recordings(spark)
    out = fd.field_ranges(steps(df), all_fields(8))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Generate" not in plan and "ReusedExchange" in plan
