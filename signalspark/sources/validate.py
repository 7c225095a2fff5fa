"""Record validation: every record keeps the list of rules it breaks.

A record is parsed once, into a map of VARIANT values; key sets, types, ranges
and payloads are all checked on that map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

Rules = dict[str, Column]

# Keys and types of the record formats; "?" allows null, "!" is required, "one" has a value list.
FORMATS = {
    "frame": {
        "t_mono": "number!", "t_utc": "number", "channel": "string", "arb_id": "integer!", "is_extended": "boolean!",
        "dlc": "integer!", "data": "string!", "direction": "one!", "probe_id": "string?",
    },
    "location": {
        "t_utc": "number!", "lat": "number!", "lon": "number!", "alt": "number", "speed": "number", "course": "number",
        "h_acc": "number", "v_acc": "number", "produced_by_accessory": "boolean",
    },
    "motion": {"t_utc": "number!", "acc": "numbers!", "gravity": "numbers", "rot": "numbers!", "att": "numbers", "mag": "numbers?"},
    "dashboard": {"t_utc": "number!", "field": "string!", "value": "number!", "conf": "number"},
    "telltale": {"t_utc": "number!", "name": "string!", "state": "one!", "conf": "number"},
    "gear": {"t_utc": "number!", "gear": "number!", "conf": "number"},
    "car_hw": {"t_utc": "number!", "kind": "one!", "status": "one!", "data": "object"},
    "photo_index": {"t_utc": "number!", "path": "string!", "w": "integer", "h": "integer"},
}
# Payload of a head-unit answer by kind.
PAYLOADS = {
    "model": {"make": "string?", "model": "string?", "year": "integer?"},
    "energy": {"battery_percent": "number?", "fuel_percent": "number?", "range_meters": "number?", "energy_low": "boolean?"},
    "speed": {"raw_mps": "number?", "display_mps": "number?"},
    "mileage": {"odometer_meters": "number?"},
    "location": {"lat": "number?", "lon": "number?", "accuracy_m": "number?", "speed_mps": "number?", "bearing_deg": "number?"},
    "accelerometer": {"x": "number?", "y": "number?", "z": "number?"},
    "gyroscope": {"x": "number?", "y": "number?", "z": "number?"},
    "compass": {"x": "number?", "y": "number?", "z": "number?"},
}
REASON = {"reason": "string"}
STATUSES = ["success", "unavailable", "unimplemented", "error"]


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _type_checked(entries: Column, types: dict[str, str], prefix: Column | None = None) -> Column:
    """Keys of a map of VARIANT values with their wanted type and whether they have it.

    A value's type is read once, whatever the number of types it may be checked for;
    ``types`` are those of the formats, found under ``prefix`` and the key.
    """
    known = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    read = F.transform(F.map_entries(entries), lambda e: F.struct(
        e["key"].alias("key"),
        e["value"].alias("v"),
        F.schema_of_variant(e["value"]).alias("found"),
        F.try_element_at(known, F.concat(prefix, e["key"]) if prefix is not None else e["key"]).alias("want"),
    ))
    return F.transform(read, lambda x: F.struct(
        x["key"].alias("key"),
        x["want"].alias("want"),
        (x["v"].isNull() | x["want"].startswith("one") | _has_type(x["v"], x["found"], x["want"])).alias("ok"),
    ))


def _has_type(v: Column, found: Column, want: Column) -> Column:
    """Whether a VARIANT of type ``found`` has the type ``want`` of the formats."""
    number = found.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    is_a = want.startswith
    ok = (
        F.when(is_a("numbers"), found.startswith("ARRAY") & ~F.exists(
            _as(v, "array<variant>"), lambda x: ~F.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        ))
        .when(is_a("number"), number)
        .when(is_a("integer"), number & (_as(v, "double") == F.floor(_as(v, "double"))))
        .when(is_a("string"), found == "STRING")
        .when(is_a("boolean"), found == "BOOLEAN")
        .when(is_a("object"), found.startswith("OBJECT"))
    )
    return F.coalesce(ok, F.lit(False)) | (want.endswith("?") & (found == "VOID"))


def value_rules(stream: str, keys: Column) -> Rules:
    """Rules on the values of the parsed record ``keys`` beside their types; a missing key breaks only its ``missing`` rule."""
    at = lambda k: F.try_element_at(keys, F.lit(k))
    number = lambda k: _as(at(k), "double")
    text = lambda k: _as(at(k), "string")
    unit = lambda k: ~number(k).between(0.0, 1.0)
    three = lambda k: F.size(_as(at(k), "array<variant>")) != 3

    def one_of(k: str, values: list[str]) -> Column:
        return at(k).isNotNull() & ~F.coalesce((F.schema_of_variant(at(k)) == "STRING") & text(k).isin(values), F.lit(False))

    rules: dict[str, Rules] = {
        "frame": {
            "arb_id.range": ~number("arb_id").between(0, 536870911),
            "arb_id.standard": ~_as(at("is_extended"), "boolean") & (number("arb_id") > 2047),
            "dlc.range": ~number("dlc").between(0, 64),
            "data.hex": ~text("data").rlike("^([0-9a-f]{2})*$"),
            "data.length": F.length(text("data")) != number("dlc") * 2,
            "direction.enum": one_of("direction", ["rx", "tx"]),
        },
        "location": {"lat.range": ~number("lat").between(-90, 90), "lon.range": ~number("lon").between(-180, 180)},
        "motion": {f"{k}.length": three(k) for k in ("acc", "gravity", "rot", "att", "mag")},
        "dashboard": {"conf.range": unit("conf")},
        "telltale": {"conf.range": unit("conf"), "state.enum": at("state").isNotNull() & ~(
            _has_type(at("state"), F.schema_of_variant(at("state")), F.lit("integer")) & F.coalesce(number("state").isin(0.0, 1.0), F.lit(False))
        )},
        "gear": {"conf.range": unit("conf")},
        "car_hw": {"kind.enum": one_of("kind", list(PAYLOADS)), "status.enum": one_of("status", STATUSES)},
        "photo_index": {},
    }
    return rules[stream]


def _wrong_types(checked: Column, prefix: str = "") -> Column:
    wrong = F.filter(checked, lambda x: x["want"].isNotNull() & ~x["ok"])
    return F.transform(wrong, lambda x: F.concat(F.lit(prefix), x["key"], F.lit(".type")))


def _unknown(checked: Column, prefix: str = "") -> Column:
    return F.transform(F.filter(checked, lambda x: x["want"].isNull()), lambda x: F.concat(F.lit(prefix), x["key"], F.lit(".unknown")))


def payload_violations(kind: Column, checked: Column) -> Column:
    """Unknown keys and wrong types in the payload of a head-unit answer; values have no range."""
    found = F.concat(_unknown(checked, "data."), _wrong_types(checked, "data."))
    return F.coalesce(F.when(kind.isin(list(PAYLOADS)), found), F.array().cast("array<string>"))


def violations(records: DataFrame, stream: str) -> DataFrame:
    """``records.record`` is one JSON object; adds the sorted list of broken rules.

    Text that is no JSON object misses every required key.
    """
    x = records.withColumn("_keys", F.coalesce(_as(F.try_parse_json("record"), "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    keys = F.col("_keys")
    # each step is a column of its own, so that it is made once
    x = x.withColumn("_types", _type_checked(keys, FORMATS[stream]))
    required = [k for k, kind in FORMATS[stream].items() if kind.endswith("!")]
    missing = F.transform(
        F.array_except(F.array(*map(F.lit, required)), F.map_keys(keys)), lambda k: F.concat(k, F.lit(".missing"))
    )
    checks = F.array_compact(
        F.array(*[F.when(broken, F.lit(name)) for name, broken in value_rules(stream, keys).items()])
    )
    lists = [missing, _unknown(F.col("_types")), _wrong_types(F.col("_types")), checks]
    if stream == "car_hw":
        kind = _as(F.try_element_at(keys, F.lit("kind")), "string")
        payload = _as(F.try_element_at(keys, F.lit("data")), "map<string,variant>")
        types = {f"{name}.{k}": t for name, fields in PAYLOADS.items() for k, t in (fields | REASON).items()}
        x = x.withColumn("_kind", kind).withColumn("_payload", payload)
        x = x.withColumn("_data", _type_checked(F.col("_payload"), types, F.concat("_kind", F.lit("."))))
        lists.append(payload_violations(F.col("_kind"), F.col("_data")))
    return x.withColumn("violations", F.sort_array(F.concat(*lists))).select(*records.columns, "violations")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.filter(F.size("violations") == 0), checked.filter(F.size("violations") > 0)


def rule_counts(checked: DataFrame) -> DataFrame:
    """Records per session and broken rule.

    A plain explode would put a filter on the list below it, and with that the whole
    validation, copied for every use of each of its steps; ``explode_outer`` does not.
    """
    rules = checked.select("session_id", F.explode_outer("violations").alias("rule")).filter(F.col("rule").isNotNull())
    return rules.groupBy("session_id", "rule").agg(F.count(F.lit(1)).alias("n"))
