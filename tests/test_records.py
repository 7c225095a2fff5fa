from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import frames
from signalspark.operators import corpus, diag, ev, fleet, labels as lb
from signalspark.operators.references import build_references, head_unit_references
from signalspark.plans import q_sources
from signalspark.sources import catalog, recordings as rec, sinks, textlogs, validate


def one(df, col):
    return df.select(col.alias("x")).first().x


def test_candump(spark):
    lines = [
        "(1642612345.678901) can0 3C0#001A2B0055000000", "(1642612345.7) can0 18DAF110#0102", "not a frame",
        "(1642612346.0) can1 100#", "(1642612347.0) can0 123#ABC", "(1642612347.5) can0 123#R",
    ]
    p = textlogs.parse_candump(spark.createDataFrame([("s", x) for x in lines], "session_id string, line string"))
    ok = textlogs.accepted(p).orderBy("t_mono").collect()
    assert [r.arb_id for r in ok] == [0x3C0, 0x18DAF110, 0x100]
    assert [r.is_extended for r in ok] == [False, True, False] and bytes(ok[0].data).hex() == "001a2b0055000000"
    assert textlogs.rejected(p).count() == 3


def test_candump_ids_are_extended_by_eight_digits(spark):
    lines = ["(1.0) can0 1000#01", "(2.0) can1 00001000#01"]
    p = textlogs.parse_candump(spark.createDataFrame([("s", x) for x in lines], "session_id string, line string"))
    assert [(r.arb_id, r.is_extended) for r in p.orderBy("t_mono").collect()] == [(0x1000, False), (0x1000, True)]


def test_validated_frames_of_large_ids_break_planted_rules_only(spark, tmp_path):
    rows = [(1, "2024-01-01", 1500), (2, "2024-01-01", 4000), (3, "2024-01-01", 4001), (11, "2024-01-01", 4000)]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long").select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k":1}').alias("props")
    )
    e.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.violations for r in q_sources.validate_frames(spark, str(tmp_path)).collect()}
    assert got == {1: "", 2: "", 3: "", 11: "direction.enum"}


def test_version_gate(spark):
    m = spark.createDataFrame([("a", "1.4"), ("b", "2.0"), ("c", "x"), ("d", None)], "session_id string, schema_version string")
    assert [r.session_id for r in rec.gate_version(m).filter("accepted").collect()] == ["a"]
    with pytest.raises(PySparkException):
        rec.gate_version(m, strict=True).collect()


def test_tokens_and_masking(spark):
    f = frames(spark, [[1, 2, 3], [4]])
    rows = corpus.pad_tokens(corpus.encode_frames(f)).orderBy("row_seq").collect()
    assert rows[0].tokens == [257, 3, 192, 1, 2, 3, 258] and rows[1].tokens == [257, 3, 192, 4, 258, 256, 256]
    m = corpus.mask_tokens(corpus.encode_frames(f), ["row_seq"], p=1.0).orderBy("row_seq").first()
    assert m.masked == [257, 259, 259, 259, 259, 259, 258] and m.labels == [-100, 3, 192, 1, 2, 3, -100]
    none = corpus.mask_tokens(corpus.encode_frames(f), ["row_seq"], p=0.0).orderBy("row_seq").first()
    assert none.masked == none.tokens and set(none.labels) == {-100}


def test_trouble_codes(spark):
    df = spark.range(1)
    codes = [one(df, diag.dtc_text(F.lit(x))) for x in (0x012345, 0xC12300, 0x812300)]
    assert codes[0] == "P0123" and codes[1][0] == "U" and codes[2][0] == "B"


def test_short_number(spark):
    df = spark.range(1)
    want = {0.01: "0.01", 1234567.0: "1.23457e+06", 1.234e-5: "1.234e-05", 100000.0: "100000", -2.5: "-2.5", 0.0: "0", 120.0: "120", 1e10: "1e+10"}
    for x, text in want.items():
        assert one(df, sinks.short_number(F.lit(x))) == text


def test_ocr_and_gears(spark):
    df = spark.range(1)
    assert [one(df, lb.text_number(F.lit(t))) for t in ("60 km/h", "", "--", "-4.5", ".5")] == [60.0, None, None, -4.5, 0.5]
    assert [one(df, lb.gear_code(F.lit(t))) for t in ("D", "3", "", "R1", "n", "P")] == [2.0, 3.0, None, -1.0, 1.0, 0.0]


def test_needle_at_30_degrees(spark):
    import math

    rows = []
    for x in range(60):
        for y in range(60):
            near = abs((y - 10) - math.tan(math.radians(30)) * (x - 5)) < 1.2 and 5 <= x <= 50
            rows.append(("f", x, y, 0, 0, 10 if near else 240))
    df = spark.createDataFrame(rows, "frame string, x int, y int, bx int, by int, lum int")
    assert abs(lb.needle_angle(df, ["frame"]).first().angle - 30) < 2


def test_crop_across_tiles(spark):
    px = spark.createDataFrame([(1, x, y, 0) for x in range(0, 200, 3) for y in range(0, 150, 5)], "frame int, x int, y int, lum int")
    roi = spark.createDataFrame([("a", 50, 60, 90, 10), ("b", 0, 0, 0, 5)], "name string, bx int, by int, bw int, bh int")
    want = {(x, y) for x in range(0, 200, 3) for y in range(0, 150, 5) if 50 <= x < 140 and 60 <= y < 70}
    assert {(r.x, r.y) for r in lb.crop(px, roi).collect()} == want


def test_charging(spark):
    df = spark.range(1)
    assert one(df, ev.ac_power(F.lit(230.0), F.lit(16.0))) == 11040.0
    assert [one(df, ev.charge_state_name(F.lit(c))) for c in (-1, 0, 5, 6)] == ["unknown", "idle", "fault", "unknown"]
    s = spark.createDataFrame([("s", float(t), 50.0) for t in range(0, 3601, 60)], "session_id string, t double, current double")
    soc = ev.soc_from_current(s, ["session_id"], 50.0, slice_s=600.0).orderBy("t").collect()
    assert soc[0].soc == 100.0 and abs(soc[-1].soc) < 1e-9


def test_merge_status(spark):
    parts = spark.createDataFrame(
        [("a", "d1", 1, [("edge",)]), ("a", "d2", 2, [("companion",)]), (None, "d3", 3, [("edge",)])],
        "session_id string, folder string, part_seq int, devices array<struct<role:string>>",
    )
    got = {r.session_id: (r.parts, r.status, r.missing) for r in fleet.merge_status(fleet.scan_parts(parts)).collect()}
    assert got == {"a": (2, "merged", []), "d3": (1, "awaiting", ["companion"])}


def test_reassembly_ignores_strays_and_incomplete(spark):
    data = ["2199", "037f2231", "2142", "100b62f190414243"]
    pad = [bytes.fromhex(x) for x in data]
    got = [bytes(r.pdu).hex() for r in diag.reassemble(frames(spark, pad, 0x7E8)).orderBy("t").collect()]
    assert got == ["7f2231"]
    whole = [bytes.fromhex(x) for x in ("100a62f190414243", "2144454647", "2148")]
    got = [bytes(r.pdu).hex() for r in diag.reassemble(frames(spark, whole, 0x7E8)).collect()]
    assert got == ["62f19041424344454647"]


def _reassembled(rows):
    """One responder's frames in order, one at a time."""
    out, open_ = [], None
    for d in rows:
        kind = d[0] >> 4 if d else None
        if kind == 0 and 0 < d[0] & 15 <= len(d) - 1:
            out.append(d[1 : 1 + (d[0] & 15)])
        elif kind == 1:
            open_ = ((d[0] & 15) << 8 | d[1], d[2:])
        elif kind == 2 and open_:
            open_ = (open_[0], open_[1] + d[1:])
        if kind in (1, 2) and open_ and len(open_[1]) >= open_[0]:
            if open_[0]:
                out.append(open_[1][: open_[0]])
            open_ = None
    return sorted(out)


def test_reassembly_with_interleaved_single_frames(spark):
    data = [bytes.fromhex(x) for x in ("100a62f190414243", "037f2278", "2144454647", "037f2278", "2148", "2199")]
    got = sorted(bytes(r.pdu) for r in diag.reassemble(frames(spark, data, 0x7E8)).collect())
    assert got == [bytes.fromhex("62f19041424344454647")] + [bytes.fromhex("7f2278")] * 2
    rng = random.Random(4)
    data = [b"", b"\x21", b"\x10\x00"]
    for _ in range(800):
        n = rng.randrange(2, 9)
        head = rng.choice([[rng.randrange(0, 8)], [0x10, rng.randrange(0, 40)], [0x21], [0x22], [0x30]])
        data.append(bytes((head + [rng.randrange(256) for _ in range(8)])[:n]))
    want = _reassembled(data)
    for slice_s in (0.05, 60.0):
        got = sorted(bytes(r.pdu) for r in diag.reassemble(frames(spark, data, 0x7E9), slice_s).collect())
        assert got == want and len(want) > 80


def test_validation(spark):
    good = '{"t_mono":1,"t_utc":1,"channel":"can0","arb_id":5,"is_extended":false,"dlc":1,"data":"0a","direction":"rx"}'
    bad = '{"t_mono":1,"t_utc":1,"channel":"can0","arb_id":4096,"is_extended":false,"dlc":2,"data":"0A","direction":"up","x":1}'
    df = spark.createDataFrame([("s", good), ("s", bad)], "session_id string, record string")
    ok, no = validate.split_valid(validate.violations(df, "frame"))
    assert ok.count() == 1
    assert no.first().violations == ["arb_id.standard", "data.hex", "data.length", "direction.enum", "x.unknown"]


def test_validation_of_types_and_payloads(spark):
    def broken(stream, *records):
        df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, record string")
        return [list(r.violations) for r in validate.violations(df, stream).orderBy("i").collect()]

    required = '{"t_mono":1,"arb_id":5,"is_extended":true,"dlc":1,"data":"0a","direction":"rx"%s}'
    assert broken("frame", required % "", required % ',"probe_id":null', required % ',"t_utc":null,"channel":3', "[1]", None) == [
        [], [], ["channel.type", "t_utc.type"], *[[f"{k}.missing" for k in ("arb_id", "data", "direction", "dlc", "is_extended", "t_mono")]] * 2,
    ]
    car = '{"t_utc":1.5,"kind":"%s","status":"%s","data":%s}'
    assert broken(
        "car_hw", car % ("energy", "success", '{"battery_percent":171.0,"fuel_percent":null,"energy_low":false}'),
        car % ("mileage", "unavailable", "{}"), car % ("nonsense", "odd", '{"x":1}'), car % ("speed", "error", '{"raw_mps":"1","soc":2,"reason":null}'),
        car % ("model", "success", '{"year":2020.5,"make":1}'), car % ("model", "success", "null"), '{"t_utc":1,"kind":"energy","status":"error"}',
    ) == [
        [], [], ["kind.enum", "status.enum"], ["data.raw_mps.type", "data.reason.type", "data.soc.unknown"],
        ["data.make.type", "data.year.type"], ["data.type"], [],
    ]
    assert broken("motion", '{"t_utc":1,"acc":[1,2.5,3],"rot":[1,2],"mag":null}', '{"t_utc":1,"acc":[1,null,3],"rot":["a",2,3],"att":1}') == [
        ["rot.length"], ["acc.type", "att.type", "rot.type"],
    ]
    assert broken("telltale", '{"t_utc":1,"name":"a","state":1}', '{"t_utc":1,"name":"a","state":"1","conf":2}') == [[], ["conf.range", "state.enum"]]
    assert broken("photo_index", '{"t_utc":1,"path":"a.jpg","w":1.5}', '{"t_utc":1}') == [["w.type"], ["path.missing"]]


def test_head_unit_references_read_the_format(spark):
    rows = [("s", 1.0, "energy", "success", '{"battery_percent":71.0,"fuel_percent":null}'), ("s", 2.0, "speed", "success", '{"raw_mps":13.4,"display_mps":14.2}'),
            ("s", 3.0, "mileage", "unavailable", '{"odometer_meters":5}'), ("s", 4.0, "mileage", "success", '{"odometer_meters":6}')]
    df = spark.createDataFrame(rows, "session_id string, t double, kind string, status string, data string")
    got = {(r.name, r.t, r.v) for r in head_unit_references(df).collect()}
    assert got == {("car_soc", 1.0, 71.0), ("car_speed_ms", 2.0, 13.4), ("car_display_speed_ms", 2.0, 14.2), ("car_odometer_m", 4.0, 6.0)}


def test_last_family_of_a_name_counts(spark):
    def family(n, v, name="speed"):
        return spark.createDataFrame([("s", name, float(i), float(v), "", "continuous", "edge") for i in range(n)],
                                     "session_id string, name string, t double, v double, unit string, kind string, clock string")

    got = build_references([family(10, 1), family(9, 2), family(3, 3), family(9, 4, "rpm")]).groupBy("name", "v").count().collect()
    assert {tuple(r) for r in got} == {("speed", 2.0, 9), ("rpm", 4.0, 9)}


def test_catalog_and_vin(spark):
    df = spark.range(1)
    assert one(df, catalog.hash_vin(F.lit(" abc "))) == one(df, catalog.hash_vin(F.lit("ABC")))
    assert abs(one(df, catalog.to_g(F.lit(9.80665))) - 1) < 1e-12


def test_long_frames_and_other_traffic(spark):
    body = bytes(range(62))
    first = bytes([0x10, 62]) + body[:6]
    more = bytes([0x21]) + body[6:] + bytes(7)
    assert [bytes(r.pdu) for r in diag.reassemble(frames(spark, [first, more], 0x7E8)).collect()] == [body]
    assert diag.reassemble(frames(spark, [b"\x02\x41\x00"] * 5, 0x3C0)).count() == 0


def test_text_frames_and_motion_import(spark, tmp_path):
    f = spark.createDataFrame([("s", 1.0, None, None, 5, None, None, b"\x0a\xff", None, None)], "session_id string, t_mono double, t_utc double, channel string, arb_id long, is_extended boolean, dlc short, data binary, direction string, probe_id string")
    rec.write_frames_jsonl(f, str(tmp_path / "j"))
    r = rec.read_frames_jsonl(spark, str(tmp_path / "j")).first()
    assert (r.arb_id, bytes(r.data), r.dlc, r.direction, r.t_utc) == (5, b"\x0a\xff", 2, "rx", 1.0)
    m = spark.createDataFrame([(1.0, 2.0, 3.0)], "t double, a double, b double")
    got = rec.import_motion(m, F.col("t"), [F.col("a")] * 3, [F.col("b")] * 3, F.lit("s")).first()
    assert (got.session_id, got.t_utc, got.acc, got.rot) == ("s", 1.0, [2.0] * 3, [3.0] * 3)


def test_signal_database_files(spark, tmp_path):
    rows = [("s", 0, 0, 0, "VERSION"), ("s", 1, 7, 0, "BO_ 7"), ("s", 1, 7, 1, " SG_ a"), ("t", 0, 0, 0, "VERSION")]
    lines = spark.createDataFrame(rows, "session_id string, part int, arb_id long, line_no int, line string")
    sinks.write_signal_database(lines, str(tmp_path / "db"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "db" / "session_id=s").glob("part-*")))
    assert text == "VERSION\nBO_ 7\n SG_ a\n"


def test_rule_counts_parse_a_record_once(spark):
    from signalspark.sources import validate

    records = spark.createDataFrame(
        [("s", '{"t_utc":1,"kind":"energy","status":"odd","data":{"battery_percent":"x","soc":1}}'), ("s", "no"), ("t", '{"t_utc":2,"kind":"speed","status":"success","data":{"raw_mps":1}}')],
        "session_id string, record string",
    )
    counts = validate.rule_counts(validate.violations(records, "car_hw"))
    assert {(r.session_id, r.rule, r.n) for r in counts.collect()} == {
        ("s", x, 1) for x in ("status.enum", "data.battery_percent.type", "data.soc.unknown", "t_utc.missing", "kind.missing", "status.missing")
    }
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
