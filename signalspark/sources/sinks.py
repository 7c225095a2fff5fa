"""Results as signal-database text, JSON and training labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from signalspark.operators.identify import confident


def short_number(x: Column) -> Column:
    """Six significant digits without trailing zeros, like ``%g`` in C."""
    sci = F.format_string("%.5e", x)
    exp = F.regexp_extract(sci, r"e([+-]\d+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(sci, r"^(.*)e", 1), r"\.?0+$", "")
    fixed = None
    for e in range(-4, 6):
        text = F.format_string(f"%.{5 - e}f", x)
        text = F.when(F.lit(e < 5), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
        fixed = F.when(exp == e, text) if fixed is None else fixed.when(exp == e, text)
    out = fixed.otherwise(F.concat(mantissa, F.regexp_replace(F.regexp_extract(sci, r"(e.*)$", 1), r"e\+?(-?)(\d)$", "e$10$2")))
    return F.when(x == 0, "0").otherwise(out)


def signal_name(reference: Column) -> Column:
    name = F.regexp_replace(reference, "[^0-9A-Za-z_]", "_")
    return F.when(name.rlike("^[A-Za-z_]"), name).otherwise(F.concat(F.lit("s_"), name))


def signal_line(legacy: bool = False) -> Column:
    """One signal: start bit, length, byte order, sign, factor and offset."""
    bit = F.col("f.width") == 0
    little = F.col("f.endian") == "LE"
    own_bit = F.col("f.bit") if legacy else F.col("f.off") * 8 + 7 - F.col("f.bit") % 8
    start = F.when(bit, own_bit).when(little, F.col("f.off") * 8).otherwise(F.col("f.off") * 8 + 7)
    length = F.when(bit, 1).otherwise(F.col("f.width") * 8)
    order = F.when(bit | little, 1).otherwise(0)
    sign = F.when(F.col("f.signed") & ~bit, "-").otherwise("+")
    return F.format_string(
        ' SG_ %s : %d|%d@%d%s (%s,%s) [0|0] "" Vector__XXX',
        signal_name(F.col("reference")), start, length, order, sign, short_number(F.col("scale")), short_number(F.col("offset")),
    )


def signal_database(hypotheses: DataFrame, min_r: float = 0.9, node: str = "BUS", legacy: bool = False) -> DataFrame:
    """Signal-database text of every session as ordered lines.

    Lines are rows and are ordered per message, so no message is gathered
    anywhere; ``part``, ``arb_id`` and ``line_no`` give the order in the file.
    """
    c = confident(hypotheses, min_r).withColumn("end", F.col("f.off") + F.greatest(F.col("f.width"), F.lit(1)))
    msg = c.groupBy("session_id", "arb_id").agg(F.least(F.greatest(F.max("end"), F.lit(8)), F.lit(64)).alias("dlc"))
    heads = msg.select(
        "session_id", F.lit(1).alias("part"), "arb_id", F.lit(0).alias("line_no"),
        F.format_string(f"BO_ %d MSG_%X: %d {node}", "arb_id", "arb_id", "dlc").alias("line"),
    )
    w = Window.partitionBy("session_id", "arb_id").orderBy("reference")
    body = c.select("session_id", F.lit(1).alias("part"), "arb_id", F.row_number().over(w).alias("line_no"), signal_line(legacy).alias("line"))
    notes = c.select(
        "session_id", F.lit(2).alias("part"), "arb_id", F.row_number().over(w).alias("line_no"),
        F.format_string(
            'CM_ BO_ %d "%s: correlation %.3f, field %s";', "arb_id", signal_name(F.col("reference")), "r", "label"
        ).alias("line"),
    )
    head = hypotheses.select("session_id").distinct().select(
        "session_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("arb_id"),
        F.posexplode(F.array(*[F.lit(x) for x in ('VERSION "signalspark"', "", "NS_ :", "", "BS_:", "", f"BU_: {node}", "")])).alias("line_no", "line"),
    )
    return head.unionByName(heads).unionByName(body).unionByName(notes)


def write_signal_database(lines: DataFrame, path: str) -> None:
    """One folder per session; lines of a file in order."""
    lines.repartition("session_id").sortWithinPartitions("session_id", "part", "arb_id", "line_no").select(
        "session_id", "line"
    ).write.partitionBy("session_id").text(path)


def hypotheses_json(hypotheses: DataFrame) -> DataFrame:
    """Per session and reference the ranked list as JSON (a list has top-k entries)."""
    entry = F.struct("rank", "label", "r", "scale", "offset", "mutual_info", "n")
    return hypotheses.groupBy("session_id", "reference").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("hypotheses"))


def append_annotations(confirmed: DataFrame, path: str) -> None:
    """Confirmed mappings as training labels; repeated ones are kept."""
    confirmed.select("session_id", "reference", "label", "r").write.mode("append").parquet(path)
