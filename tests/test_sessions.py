from __future__ import annotations

import json

from signalspark.sources import recordings as rec, sessions


def _write(root, name, value):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=1))


def _lines(*rows):
    return "".join(json.dumps(r) + "\n" for r in rows)


def test_sessions_are_read_from_their_folders(spark, tmp_path):
    a, b, old = tmp_path / "x" / "a", tmp_path / "y" / "b", tmp_path / "old"
    _write(a, "manifest.json", {"schema_version": "1.2.0", "session_id": "drive-1", "sync_markers": [{"kind": "tap", "t_utc": 5.5}, {"kind": "brake", "t_utc": 7.0}]})
    _write(b, "manifest.json", {"schema_version": "1.0.0"})
    _write(old, "manifest.json", {"schema_version": "2.0.0", "session_id": "other"})
    frame = {"t_mono": 1.0, "arb_id": 100, "data": "0a0b"}
    _write(a, "can/frames.jsonl", _lines(frame, {**frame, "t_mono": 2.0, "direction": "tx", "t_utc": 9.0}))
    for folder in (b, old):
        spark.createDataFrame([(3.0, 200, b"\x01")], "t_mono double, arb_id long, data binary").coalesce(1).write.parquet(str(folder / "can" / "frames.parquet"))
    _write(b, "can/frames.jsonl", _lines({**frame, "arb_id": 999}))
    _write(a, "phone/motion.jsonl", _lines({"t_utc": 1.5, "acc": [1, 2, 3]}))
    _write(a, "edge/motion.jsonl", _lines({"t_utc": 2.5, "rot": [4, 5, 6]}))
    _write(b, "phone/location.jsonl", _lines({"t_utc": 3.5, "lat": 1.0, "lon": 2.0, "speed": -1.0, "course": 90.0}))
    _write(a, "can/discovery.json", {"uds": {"ecus": [{"tx_id": "0x7E0", "rx_id": "0x7E8", "dids": ["0xF190"]}]}})
    _write(b, "labels/annotations.json", {"speed": {"label": "x"}})
    _write(b, "labels/gear.jsonl", _lines({"t_utc": 4.0, "gear": 2, "conf": 0.9}))
    got = sessions.read_sessions(spark, str(tmp_path))
    assert {r.session_id for r in got["manifests"].collect()} == {"drive-1", "b"}
    frames = {(r.session_id, r.arb_id, r.t_mono, r.t_utc, bytes(r.data), r.direction) for r in got["frames"].collect()}
    assert frames == {("drive-1", 100, 1.0, 1.0, b"\x0a\x0b", "rx"), ("drive-1", 100, 2.0, 9.0, b"\x0a\x0b", "tx"), ("b", 200, 3.0, 3.0, b"\x01", "rx")}
    assert [(r.session_id, r.t, r.acc_y) for r in got["motion"].collect()] == [("drive-1", 1.5, 2.0)]
    assert [(r.session_id, r.t, r.rot_z) for r in got["edge_motion"].collect()] == [("drive-1", 2.5, 6.0)]
    assert [(r.session_id, r.speed, r.course) for r in got["location"].collect()] == [("b", None, 90.0)]
    assert [tuple(r) for r in rec.discovery_ecus(got["discovery"]).collect()] == [("drive-1", "0x7E0", "0x7E8", ["0xF190"])]
    assert [r.session_id for r in got["annotations"].collect()] == ["b"]
    assert [(r.session_id, r.t, r.gear) for r in got["gear"].collect()] == [("b", 4.0, 2.0)]
    assert all(got[k].count() == 0 for k in ("edge_location", "dashboard", "telltales"))
    markers = sessions.sync_markers(got["manifests"]).orderBy("pos").collect()
    assert [tuple(r) for r in markers] == [("drive-1", 0, 5.5, "tap"), ("drive-1", 1, 7.0, "brake")]
    assembled = {r.session_id: r for r in rec.assemble_sessions(got["manifests"], {"frames": got["frames"], "motion": got["motion"]}).collect()}
    assert assembled["drive-1"].frames_rows == 2 and assembled["b"].motion_rows == 0
