"""Recorded diagnostics: reassembly and bulk decoding of responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from signalspark.functions.payload import decode_int
from signalspark.operators.slices import with_running_sum

# Identifier windows of diagnostic responses.
RESPONSE_11_LOW, RESPONSE_11_HIGH = 0x7E8, 0x7EF
RESPONSE_29 = 0x18DAF100
REQUEST_29_HIGH, TESTER = 0x18DA0000, 0xF1

# Standard data items as (number, name, bytes, unit, factor, divisor, offset).
PIDS = [
    (0x04, "engine_load", 1, "%", 100.0, 255.0, 0.0),
    (0x05, "coolant_temp", 1, "degC", 1.0, 1.0, -40.0),
    (0x0A, "fuel_pressure", 1, "kPa", 3.0, 1.0, 0.0),
    (0x0B, "intake_manifold_pressure", 1, "kPa", 1.0, 1.0, 0.0),
    (0x0C, "engine_rpm", 2, "rpm", 1.0, 4.0, 0.0),
    (0x0D, "vehicle_speed", 1, "km/h", 1.0, 1.0, 0.0),
    (0x0E, "timing_advance", 1, "deg", 1.0, 2.0, -64.0),
    (0x0F, "intake_temp", 1, "degC", 1.0, 1.0, -40.0),
    (0x10, "maf", 2, "g/s", 1.0, 100.0, 0.0),
    (0x11, "throttle_pos", 1, "%", 100.0, 255.0, 0.0),
    (0x1F, "run_time_since_start", 2, "s", 1.0, 1.0, 0.0),
    (0x21, "distance_with_mil", 2, "km", 1.0, 1.0, 0.0),
    (0x2F, "fuel_level", 1, "%", 100.0, 255.0, 0.0),
    (0x31, "distance_since_clear", 2, "km", 1.0, 1.0, 0.0),
    (0x33, "barometric_pressure", 1, "kPa", 1.0, 1.0, 0.0),
    (0x42, "control_module_voltage", 2, "V", 1.0, 1000.0, 0.0),
    (0x45, "rel_throttle_pos", 1, "%", 100.0, 255.0, 0.0),
    (0x46, "ambient_temp", 1, "degC", 1.0, 1.0, -40.0),
    (0x5B, "hybrid_battery_remaining", 1, "%", 100.0, 255.0, 0.0),
    (0x5C, "engine_oil_temp", 1, "degC", 1.0, 1.0, -40.0),
    (0x5E, "engine_fuel_rate", 2, "L/h", 1.0, 20.0, 0.0),
]
SUPPORT_PIDS = [0x00, 0x20, 0x40, 0x60, 0x80, 0xA0, 0xC0, 0xE0]

# Standard data identifiers.
DIDS = {
    0xF180: "boot_software_id",
    0xF181: "application_software_id",
    0xF182: "application_data_id",
    0xF183: "boot_software_fingerprint",
    0xF184: "application_software_fingerprint",
    0xF186: "active_diagnostic_session",
    0xF187: "vehicle_manufacturer_spare_part_number",
    0xF188: "vehicle_manufacturer_ecu_sw_number",
    0xF189: "vehicle_manufacturer_ecu_sw_version",
    0xF18A: "system_supplier_id",
    0xF18B: "ecu_manufacturing_date",
    0xF18C: "ecu_serial_number",
    0xF190: "vin",
    0xF191: "vehicle_manufacturer_ecu_hw_number",
    0xF192: "system_supplier_ecu_hw_number",
    0xF193: "system_supplier_ecu_hw_version",
    0xF194: "system_supplier_ecu_sw_number",
    0xF195: "system_supplier_ecu_sw_version",
    0xF197: "system_name",
    0xF19E: "asam_odx_file_id",
    0xF1A0: "vehicle_manufacturer_specific_a0",
    0xF1A1: "vehicle_manufacturer_specific_a1",
}

# Negative response codes.
RESPONSE_CODES = {
    0x11: "serviceNotSupported",
    0x12: "subFunctionNotSupported",
    0x22: "conditionsNotCorrect",
    0x31: "requestOutOfRange",
    0x33: "securityAccessDenied",
    0x35: "invalidKey",
    0x7E: "subFunctionNotSupportedInActiveSession",
    0x7F: "serviceNotSupportedInActiveSession",
}


def is_diag_response(arb_id: Column, extended: Column) -> Column:
    wide = arb_id.bitwiseAND(F.lit(0xFFFFFF00)) == RESPONSE_29
    return F.when(extended, wide).otherwise(arb_id.between(RESPONSE_11_LOW, RESPONSE_11_HIGH))


def request_id(arb_id: Column, extended: Column) -> Column:
    """Identifier the responder listens on."""
    wide = F.lit(REQUEST_29_HIGH).cast("long") + F.shiftleft(arb_id.bitwiseAND(F.lit(255)), 8) + TESTER
    return F.when(extended, wide).otherwise(arb_id - 8)


def reassemble(frames: DataFrame, slice_s: float = 60.0) -> DataFrame:
    """Responses of every responder, single frames and multi-frame messages.

    Only identifiers of responders are read: on a mixed bus the first byte of
    other traffic means something else.  A consecutive frame belongs to the last first frame of its
    responder as long as that one misses bytes, whatever single frames come in between; a new first frame
    gives up the open message.  Frames past the announced length are left
    out, which bounds a message to 4,095 bytes and its last frame.
    """
    key = ["session_id", "arb_id"]
    kind = F.shiftright(decode_int(F.col("data"), 0, 1), 4)
    extended = F.coalesce("is_extended", F.lit(False)) if "is_extended" in frames.columns else F.col("arb_id") > 0x7FF
    x = frames.filter(is_diag_response(F.col("arb_id"), extended)).select(*key, "t_mono", "row_seq", "data", kind.alias("kind"))
    single = x.filter("kind = 0").select(
        *key, F.col("t_mono").alias("t"), decode_int(F.col("data"), 0, 1).bitwiseAND(15).alias("length"), F.expr("substring(data, 2)").alias("body")
    )
    parts = x.filter("kind = 1 OR (kind = 2 AND octet_length(data) > 1)").withColumn(
        "body", F.expr("substring(data, CASE WHEN kind = 1 THEN 3 ELSE 2 END)")
    )
    own = F.octet_length("body").cast("long")
    parts = with_running_sum(
        parts, key, ["t_mono", "row_seq"], {"msg": F.when(F.col("kind") == 1, 1).otherwise(0), "frame_no": F.lit(1), "octets": own},
        F.floor(F.col("t_mono") / F.lit(float(slice_s))),
    ).filter("msg > 0")
    before = F.col("octets") - own
    starts = parts.filter("kind = 1").select(
        *key, "msg", F.col("t_mono").alias("t"), decode_int(F.col("data"), 0, 2).bitwiseAND(4095).alias("length"), before.alias("start")
    )
    open_ = (F.col("kind") == 1) | (before - F.col("start") < F.col("length"))
    chunk = F.struct("frame_no", F.hex("body").alias("c"))
    joined = parts.join(starts, [*key, "msg"]).filter(open_).groupBy(*key, "msg", "t", "length").agg(
        F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(chunk)), lambda s: s["c"]), "")).alias("body")
    )
    pdus = single.unionByName(joined.select(*single.columns))
    return pdus.filter((F.octet_length("body") >= F.col("length")) & (F.col("length") > 0)).select(
        *key, "t", F.col("length").cast("int").alias("length"), F.expr("substring(body, 1, CAST(length AS INT))").alias("pdu")
    )


def _byte(i: int, col: str = "pdu") -> Column:
    return decode_int(F.col(col), i, 1)


def obd_responses(pdus: DataFrame, mode: int = 1) -> DataFrame:
    """Positive answers of a mode: item number and the bytes after it."""
    return pdus.filter((_byte(0) == mode + 0x40) & (F.octet_length("pdu") >= 2)).select(
        "session_id", "arb_id", "t", _byte(1).cast("int").alias("pid"), F.expr("substring(pdu, 3)").alias("raw")
    )


def supported_pids(responses: DataFrame) -> DataFrame:
    """Item numbers announced by the support bit masks, block markers left out."""
    r = responses.filter(F.col("pid").isin(SUPPORT_PIDS) & (F.octet_length("raw") >= 4))
    mask = decode_int(F.col("raw"), 0, 4)
    on = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("bit_get", F.col("mask"), F.lit(31) - i) == 1)
    x = r.withColumn("mask", mask).select("session_id", "arb_id", (F.col("pid") + 1).alias("base"), F.explode(on).alias("i"))
    return x.select("session_id", "arb_id", (F.col("base") + F.col("i")).alias("pid")).filter(
        ~F.col("pid").isin(SUPPORT_PIDS)
    ).distinct()


def pid_catalog(df: DataFrame) -> DataFrame:
    """The item catalogue as a small table (21 rows)."""
    cols = "pid int, name string, length int, unit string, factor double, divisor double, shift double"
    return df.sparkSession.createDataFrame(PIDS, cols)


def decode_pids(responses: DataFrame) -> DataFrame:
    """Physical values of known items; unknown or short answers keep a NULL value."""
    x = responses.join(F.broadcast(pid_catalog(responses)), "pid", "left")
    raw = F.when(F.col("length") == 1, decode_int(F.col("raw"), 0, 1)).otherwise(decode_int(F.col("raw"), 0, 2))
    known = F.col("length").isNotNull() & (F.octet_length("raw") >= F.col("length"))
    value = F.round(raw * F.col("factor") / F.col("divisor") + F.col("shift"), 4)
    return x.select(
        "session_id", "arb_id", "t", F.format_string("0x%02X", "pid").alias("pid"), F.lower(F.hex("raw")).alias("raw"),
        F.when(known, F.col("name")).alias("name"), F.when(known, value).alias("value"), F.when(known, F.col("unit")).alias("unit"),
    )


def did_responses(pdus: DataFrame) -> DataFrame:
    """Positive identifier reads with the identifier's name and readable value."""
    names = F.create_map(*[F.lit(x) for kv in DIDS.items() for x in kv])
    did = decode_int(F.col("pdu"), 1, 2).cast("int")
    x = pdus.filter((_byte(0) == 0x62) & (F.octet_length("pdu") >= 3)).select(
        "session_id", "arb_id", "t", did.alias("did"), F.expr("substring(pdu, 4)").alias("raw")
    )
    return x.withColumn("name", F.try_element_at(names, "did")).withColumn("text", readable(F.col("raw")))


def readable(raw: Column) -> Column:
    """Text when every byte is printable, hexadecimal otherwise."""
    printable = F.hex(raw).rlike("^([2-6][0-9A-F]|7[0-9A-E])+$")
    return F.when(printable, F.decode(raw, "UTF-8")).otherwise(F.lower(F.hex(raw)))


def trouble_codes(pdus: DataFrame) -> DataFrame:
    """Codes of status-mask reports: four-byte records after a three-byte header."""
    x = pdus.filter((_byte(0) == 0x59) & (_byte(1) == 2) & (F.octet_length("pdu") >= 7))
    n = F.expr("(octet_length(pdu) - 3) DIV 4")
    x = x.select("session_id", "arb_id", "t", "pdu", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    rec = F.expr("substring(pdu, CAST(4 + i * 4 AS INT), 4)")
    x = x.withColumn("rec", rec)
    return x.select(
        "session_id", "arb_id", "t", "i", decode_int(F.col("rec"), 0, 3).alias("dtc"), decode_int(F.col("rec"), 3, 1).cast("int").alias("status")
    ).withColumn("code", dtc_text(F.col("dtc")))


def dtc_text(dtc: Column) -> Column:
    b0, b1 = F.shiftright(dtc, 16).bitwiseAND(255), F.shiftright(dtc, 8).bitwiseAND(255)
    letter = F.get(F.array(*[F.lit(c) for c in "PCBU"]), F.shiftright(b0, 6).cast("int"))
    return F.concat(letter, F.format_string("%d%X%02X", F.shiftright(b0, 4).bitwiseAND(3), b0.bitwiseAND(15), b1))


def response_code_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in RESPONSE_CODES.items() for x in kv])
    own = F.concat(F.format_string("0x%02X", code), F.when(code.between(0xF0, 0xFE), "(mfr-specific)").otherwise(""))
    return F.coalesce(F.try_element_at(names, code.cast("int")), own)


def negative_responses(pdus: DataFrame) -> DataFrame:
    x = pdus.filter((_byte(0) == 0x7F) & (F.octet_length("pdu") >= 3))
    return x.select("session_id", "arb_id", "t", _byte(1).cast("int").alias("service"), response_code_name(_byte(2)).alias("reason"))


def inventory(responses: DataFrame, dids: DataFrame) -> DataFrame:
    """Items and identifiers each responder answered, one row per item."""
    p = responses.select("session_id", "arb_id", F.lit("pid").alias("kind"), F.format_string("0x%02X", "pid").alias("item"))
    d = dids.select("session_id", "arb_id", F.lit("did").alias("kind"), F.format_string("0x%04X", "did").alias("item"))
    return p.unionByName(d).groupBy("session_id", "arb_id", "kind", "item").agg(F.count(F.lit(1)).alias("n"))


def latest_samples(samples: DataFrame) -> DataFrame:
    """Last sample of every item."""
    return samples.groupBy("session_id", "pid").agg(F.max_by(F.struct("t", "value", "raw"), F.struct("t", "arb_id")).alias("s")).select(
        "session_id", "pid", "s.t", "s.value", "s.raw"
    )


def rank_bus_candidates(scans: DataFrame) -> DataFrame:
    """Score of every bit rate and the best one per interface; error frames count five-fold."""
    score = F.when(F.col("frames") == 0, 0.0).otherwise(F.col("frames") - 5.0 * F.col("errors"))
    w = Window.partitionBy("interface").orderBy(F.desc("score"), "bitrate")
    return scans.withColumn("score", score).withColumn("rank", F.row_number().over(w))


def busiest_interface(ranked: DataFrame) -> DataFrame:
    """Interface whose best bit rate carries most frames."""
    best = ranked.filter("rank = 1").agg(F.max_by(F.struct("interface", "bitrate", "frames", "score"), F.struct("frames", F.col("interface"))).alias("b"))
    return best.select("b.*")


def fold_samples(polled: DataFrame, recorded: DataFrame) -> DataFrame:
    """Poll answers of known items and recorded samples in one sample table."""
    known = pid_catalog(polled).select(F.format_string("0x%02X", "pid").alias("pid"))
    p = polled.join(F.broadcast(known), "pid", "left_semi").select(
        "session_id", "name", "pid", "t", F.col("value").cast("string").alias("value"), "unit"
    )
    return p.unionByName(recorded.select("session_id", "name", "pid", "t", "value", "unit"))


