from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from helpers import frames, steps
from signalspark.functions.payload import all_fields, byte_fields, decode_int
from signalspark.operators import clusters as cl
from signalspark.operators import fields as fd
from signalspark.operators import frames as fr
from signalspark.operators import mux as mx
from signalspark.operators.slices import trailing_sums, with_next, with_previous, with_row_number, with_running_sum
from signalspark.plans.q_identify import _reps


def _value(payload: bytes, f) -> int:
    if f.bit >= 0:
        return payload[f.bit // 8] >> (7 - f.bit % 8) & 1
    part = payload[f.off : f.off + f.width]
    return int.from_bytes(part, "big" if f.endian == "BE" else "little", signed=f.signed)


@pytest.mark.parametrize("size", [4, 8, 12])
def test_every_field_decodes_like_python(spark, size):
    rng = random.Random(size)
    payloads = [bytes(rng.randrange(256) for _ in range(size)) for _ in range(3)]
    fields = all_fields(size)
    s = steps(frames(spark, payloads), payload_bytes=size)
    got = {(r.row_seq, r.seq): r.v for r in fd.explode_fields(s, fields, ["row_seq"]).select("row_seq", "f.seq", "v").collect()}
    want = {(i, f.seq): _value(p, f) for i, p in enumerate(payloads) for f in fields}
    assert got == want


def test_fixed_decodes(spark):
    df = spark.createDataFrame([(bytes([0x01, 0x02, 0xFF, 0xFF, 0x00, 0x80]),)], "d binary")
    d = F.col("d")
    row = df.select(
        decode_int(d, 0, 2), decode_int(d, 2, 2), decode_int(d, 4, 2, "LE"), decode_int(d, 4, 2, "LE", True)
    ).first()
    assert tuple(row) == (258, 65535, 32768, -32768)


def test_field_count():
    assert len(byte_fields(8)) == 88 and len(all_fields(8)) == 152


def test_ramp_kept_counter_and_constant_dropped(spark):
    payloads = []
    for i in range(200):
        v = int(3000 + 2000 * ((i % 80) / 80.0) ** 2) + (i * 7919) % 13
        payloads.append([i % 256, v >> 8, v & 255, 0x55, 0, 0, 0, 0])
    labels = {r.label for r in fd.candidates(steps(frames(spark, payloads))).select("label").collect()}
    assert "0x3C0[1:3]BEu" in labels
    assert not labels & {"0x3C0[0:1]BEu", "0x3C0[3:4]BEu"}


def test_counter_bound_agrees_with_exact_median(spark):
    rng = random.Random(5)
    cols = {
        0: lambda i: i % 4, 1: lambda i: (i * 3) % 256, 2: lambda i: rng.randrange(256), 3: lambda i: i % 2,
        4: lambda i: (i + (i % 12 == 0)) % 256, 5: lambda i: (i + (i % 5 == 0) * 2) % 256, 6: lambda i: [0, 1, 100, 101][i % 4], 7: lambda i: 7,
    }
    payloads = [[cols[c](i) for c in range(8)] for i in range(120)]
    s = steps(frames(spark, payloads))
    fields = all_fields(8, 2, bits=False)
    got = {(r.seq, r.step) for r in fd.counter_fields(s, fd.field_ranges(s, fields).filter("vmax > vmin"), fields).collect()}
    want = set()
    for f in fields:
        v = [_value(bytes(p), f) for p in payloads]
        half = 0.5 * (max(v) - min(v) + 1)
        d = [b - a for a, b in zip(v, v[1:]) if abs(b - a) < half]
        if len(d) < 4 or max(v) == min(v):
            continue
        mid = sorted(d)[len(d) // 2]
        if mid != 0 and sum(x == mid for x in d) / len(d) > 0.9:
            want.add((f.seq, mid))
    assert got and {s for s, _ in got} == {s for s, _ in want}
    assert got == want


def test_checksum_byte_dropped(spark):
    rng = random.Random(5)
    payloads = [[rng.randrange(256), i // 4, 0, 0, 0, 0, 0, 0] for i in range(60)]
    labels = {r.label for r in fd.candidates(steps(frames(spark, payloads))).select("label").collect()}
    assert "0x3C0[0:1]BEu" not in labels and "0x3C0[0:1]BEs" not in labels


def test_taxonomy(spark):
    import math

    rng = random.Random(3)
    payloads = [
        [9, i % 256, rng.randrange(256), (i // 40) % 3, int(127 + 100 * math.sin(i / 15)), 0, 0, 0] for i in range(300)
    ]
    c = fd.classify(steps(frames(spark, payloads)), max_width=1)
    got = {r.off: r.behaviour for r in c.select("f.off", "behaviour", "f.signed").collect() if not r.signed}
    assert [got[i] for i in range(5)] == ["constant", "counter", "checksum", "switch", "dynamic"]


def test_multiplexor_and_negative_case(spark):
    rng = random.Random(2)
    muxed = [[i % 3, (i % 3) * 80 + rng.randrange(20), rng.randrange(256), 1] for i in range(300)]
    plain = [[rng.randrange(4), rng.randrange(256), rng.randrange(256), 1] for i in range(300)]
    df = frames(spark, muxed, 0x5C0).unionByName(frames(spark, plain, 0x5C1))
    got = mx.detect_multiplexor(steps(df)).collect()
    assert [(r.arb_id, r.mux_byte, r.mux_values) for r in got] == [(0x5C0, 0, [0, 1, 2])]
    assert got[0].score > 0.5
    labels = {r.label for r in mx.extract_multiplexed(steps(df), mx.detect_multiplexor(steps(df))).collect()}
    assert "0x5C0[m0=1][1:2]BEu" in labels and not any("[0:" in x for x in labels)


def test_roles(spark):
    periodic = frames(spark, [[0]] * 20, 1)
    bursty = frames(spark, [[0]] * 8, 2, times=[0, 0.02, 0.04, 1, 1.02, 3.5, 3.52, 3.54])
    rare = frames(spark, [[0]] * 2, 3)
    r = {x.arb_id: x for x in fr.message_roles(periodic.unionByName(bursty).unionByName(rare)).collect()}
    assert [r[i].role for i in (1, 2, 3)] == ["periodic", "sporadic", "on_demand"]
    assert abs(r[1].period_ms - 20) < 1e-6


def test_sliced_windows_match_plain_ones(spark):
    rng = random.Random(7)
    rows = sorted((rng.randrange(2), rng.randrange(500), i) for i in range(400))
    by_key: dict[int, list] = {}
    for k, t, i in rows:
        by_key.setdefault(k, []).append((t, i))
    df = spark.createDataFrame([(k, t, i, float(i % 11)) for k, t, i in rows], "k int, t int, i int, v double")
    part = F.floor(F.col("t") / 7)
    got = {(r.k, r.i): r for r in with_previous(df, ["k"], ["t", "i"], ["i"], part, 2).collect()}
    nxt = {(r.k, r.i): r.i_n1 for r in with_next(df, ["k"], ["t", "i"], ["i"], part).collect()}
    num = with_row_number(df, ["k"], ["t", "i"], part)
    rn = {(r.k, r.i): r.rn for r in num.collect()}
    run = {(r.k, r.i): r.s for r in with_running_sum(df, ["k"], ["t", "i"], {"s": F.col("v")}, part).collect()}
    tail = {(r.k, r.i): r.s for r in trailing_sums(num, ["k"], "rn", {"s": F.col("v")}, 5, rows=9).collect()}
    for k, seq in by_key.items():
        ids = [i for _, i in seq]
        for n, i in enumerate(ids):
            assert got[k, i].i_p1 == (ids[n - 1] if n else None)
            assert got[k, i].i_p2 == (ids[n - 2] if n > 1 else None)
            assert nxt[k, i] == (ids[n + 1] if n + 1 < len(ids) else None)
            assert rn[k, i] == n + 1
            assert run[k, i] == sum(x % 11 for x in ids[: n + 1])
            assert tail[k, i] == sum(x % 11 for x in ids[max(0, n - 4) : n + 1])


def test_exact_median(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (5, 1, 9, 1)] + [("b", 2.0)], "k string, v double")
    got = {r.k: r.median for r in fr.exact_median(df, ["k"], "v").collect()}
    assert got == {"a": 3.0, "b": 2.0}


def test_exact_median_narrows_ranges(spark):
    """A periodic id with rare long pauses: nearly all gaps lie in a sliver of the range."""
    rng = random.Random(2)
    rows = {
        "periodic": [0.02 + rng.gauss(0, 1e-6) for _ in range(3000)] + [rng.uniform(0, 3600) for _ in range(20)],
        "even": [rng.gauss(0, 1) for _ in range(1000)],
        "two": [1.0] * 500 + [2.0] * 500,
        "few": [-3.0, 8.0],
    }
    df = spark.createDataFrame([(k, v) for k, vs in rows.items() for v in [*vs, None]], "k string, v double")
    for ranked in (1, 50, 8192):
        got = {r.k: r.median for r in fr.exact_median(df, ["k"], "v", ranked).collect()}
        assert got == {k: statistics.median(v) for k, v in rows.items()}
    assert fr.exact_median(df.limit(0), ["k"], "v").count() == 0


def test_wide_payloads_are_read_to_their_end(spark):
    rng = random.Random(16)
    payloads = []
    for i in range(200):
        p = bytearray(16)
        p[1], p[2], p[9], p[12] = i // 50, rng.randrange(256), rng.randrange(256), i % 256
        p[14:16] = (1000 + (i * 37) % 500).to_bytes(2, "big")
        payloads.append(bytes(p))
    s = steps(frames(spark, payloads))
    assert fd.payload_bytes_of(s) == 16
    kinds = {r.off: r.behaviour for r in fd.classify(s, max_width=1).filter("NOT f.signed").select("f.off", "behaviour").collect()}
    assert set(kinds) == set(range(16)) and kinds[12] == "counter" and kinds[0] == "constant"
    single = {r.off for r in fd.candidates(s, max_width=1, bits=False).select("f.off").collect()}
    assert not single & {2, 9} and 14 in single
    assert {r.off for r in fd.value_counts(s, 1).collect()} == set(range(16))


def test_selector_behind_the_eighth_byte(spark):
    payloads = [bytes(10) + bytes([i % 3, (i % 3) * 80 + i // 9 % 8]) for i in range(200)]
    s = steps(frames(spark, payloads))
    found = mx.detect_multiplexor(s).collect()
    assert [(r.mux_byte, list(r.mux_values)) for r in found] == [(10, [0, 1, 2])]
    assert {r.off for r in mx.extract_multiplexed(s, mx.detect_multiplexor(s)).select("f.off").collect()} >= {11}


def test_representatives_read_the_frames_once(spark, monkeypatch):
    rng = random.Random(4)
    walk, rows = 500, []
    for i in range(120):
        walk += rng.randint(-9, 9)
        rows.append([i % 256, walk >> 8, walk & 255, 85, rng.randint(0, 2), rng.randint(0, 255)])
    h = fd.frame_history(frames(spark, rows).unionByName(frames(spark, [r[::-1] for r in rows], 0x3C1)))
    s = fd.frame_steps(h)
    want = cl.representatives(fd.classify(s), fd.candidates(s, max_width=2, bits=False))
    facts = fd.byte_facts(s)
    names = lambda x: sorted((r.arb_id, r.seq, r.label) for r in x.collect())
    assert names(fd.byte_candidates(facts)) == names(fd.candidates(s, max_width=2, bits=False))
    passes, partial_stats = [], fd.fb.partial_stats
    monkeypatch.setattr(fd.fb, "partial_stats", lambda *a, **kw: passes.append(1) or partial_stats(*a, **kw))
    got = _reps(h)
    assert len(passes) == 1
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
