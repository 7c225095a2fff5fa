"""Explicit schemas of the recorded streams (never inferred)."""

from __future__ import annotations

FRAMES = (
    "session_id STRING, t_mono DOUBLE, t_utc DOUBLE, channel STRING, arb_id BIGINT, is_extended BOOLEAN, "
    "dlc SMALLINT, data BINARY, direction STRING, probe_id STRING"
)
FRAMES_JSON = FRAMES.replace("data BINARY", "data STRING")
VEC = "ARRAY<DOUBLE>"
MOTION = f"session_id STRING, t_utc DOUBLE, acc {VEC}, gravity {VEC}, rot {VEC}, att {VEC}, mag {VEC}"
LOCATION = (
    "session_id STRING, t_utc DOUBLE, lat DOUBLE, lon DOUBLE, alt DOUBLE, speed DOUBLE, course DOUBLE, "
    "h_acc DOUBLE, v_acc DOUBLE, produced_by_accessory BOOLEAN"
)
MANIFEST = (
    "schema_version STRING, session_id STRING, created_utc DOUBLE, vehicle MAP<STRING,STRING>, "
    "devices ARRAY<STRUCT<role:STRING,kind:STRING,id:STRING,sw_version:STRING,mount:STRING,"
    "clock:STRUCT<source:STRING,utc_offset_est_s:DOUBLE,err_est_s:DOUBLE>>>, "
    "streams ARRAY<STRUCT<path:STRING,kind:STRING,rows:BIGINT,index:STRING,t_start_utc:DOUBLE,t_end_utc:DOUBLE>>, "
    "sync_markers ARRAY<STRUCT<kind:STRING,t_utc:DOUBLE>>"
)
DISCOVERY = (
    "session_id STRING, obd STRUCT<supported_pids:ARRAY<STRING>,samples:ARRAY<STRUCT<mode:INT,pid:STRING,name:STRING,"
    "t_utc:DOUBLE,raw:STRING,value:STRING,unit:STRING>>>, uds STRUCT<ecus:ARRAY<STRUCT<tx_id:STRING,rx_id:STRING,dids:ARRAY<STRING>>>>, "
    "plain_can STRUCT<arb_ids:ARRAY<STRUCT<arb_id:STRING,count:BIGINT,dlc:INT>>>"
)
LABEL_DASHBOARD = "session_id STRING, t_utc DOUBLE, field STRING, value DOUBLE, conf DOUBLE"
LABEL_TELLTALE = "session_id STRING, t_utc DOUBLE, name STRING, state INT, conf DOUBLE"
LABEL_GEAR = "session_id STRING, t_utc DOUBLE, gear DOUBLE, conf DOUBLE"
CAR_HW = "session_id STRING, t_utc DOUBLE, kind STRING, status STRING, data STRING"
ANNOTATIONS = "session_id STRING, reference STRING, label STRING, r DOUBLE"
