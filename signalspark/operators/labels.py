"""Dashboard pixels and texts as label series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from signalspark.operators.frames import attach

TILE = 64
# Gear letters and the label stream of each region kind.
GEARS = {"P": 0, "R": -1, "N": 1, "D": 2}
STREAM_OF = {"digits": "dashboard_ocr", "telltale": "telltales", "needle": "dashboard_ocr", "gear": "gear"}


def crop(pixels: DataFrame, rois: DataFrame) -> DataFrame:
    """Pixels inside each region's box.

    Boxes are cut into tiles, so pixels meet regions through an equi-join on
    their tile; the pixel side is salted because one tile may hold most pixels.
    """
    def tiles(lo: str, size: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / TILE), F.floor((F.col(lo) + F.col(size) - 1) / TILE))

    r = rois.filter("bw > 0 AND bh > 0").withColumn("tx", F.explode(tiles("bx", "bw"))).withColumn("ty", F.explode(tiles("by", "bh")))
    p = pixels.withColumn("tx", F.floor(F.col("x") / TILE)).withColumn("ty", F.floor(F.col("y") / TILE))
    inside = "x >= bx AND x < bx + bw AND y >= by AND y < by + bh"
    return attach(p, r, ["tx", "ty"], "frame").filter(inside).drop("tx", "ty")


def telltale_state(cropped: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Lamp on when the mean brightness of its box passes ``threshold``."""
    a = cropped.groupBy(*keys).agg(F.avg("lum").alias("mean"), F.max("lum").alias("top"))
    norm = F.col("mean") / F.when(F.col("top") > 1, 255.0).otherwise(1.0)
    return a.select(*keys, norm.alias("brightness"), (norm > threshold).alias("on"))


def needle_angle(cropped: DataFrame, keys: list[str], dark_needle: bool = True) -> DataFrame:
    """Major-axis angle of the needle pixels in degrees, 0 to 180; NULL when unclear."""
    lim = cropped.groupBy(*keys).agg(((F.max("lum") + F.min("lum")) / 2.0).alias("mid"), F.count(F.lit(1)).alias("size"))
    x = cropped.join(lim, keys)
    hit = (F.col("lum") < F.col("mid")) if dark_needle else (F.col("lum") > F.col("mid"))
    px, py = F.when(hit, F.col("x") - F.col("bx")), F.when(hit, F.col("y") - F.col("by"))
    a = x.groupBy(*keys, "size").agg(
        F.count(px).alias("n"), F.covar_pop(px, py).alias("cxy"), F.var_pop(px).alias("cxx"), F.var_pop(py).alias("cyy")
    )
    angle = F.pmod(F.degrees(F.atan2(2.0 * F.col("cxy"), F.col("cxx") - F.col("cyy")) / 2.0), F.lit(180.0))
    return a.select(*keys, "n", F.when((F.col("size") >= 9) & (F.col("n") >= 5), angle).alias("angle"))


def angle_to_value(angle: Column, a0: Column, a1: Column, v0: Column, v1: Column) -> Column:
    return F.when(a0 == a1, v0).otherwise(v0 + F.try_divide(angle - a0, a1 - a0) * (v1 - v0))


def text_number(text: Column, scale: float = 1.0) -> Column:
    """Number in an OCR text: digits, point and minus are kept."""
    kept = F.regexp_replace(text, r"[^0-9.\-]", "")
    return F.when(kept.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), kept.cast("double") * F.lit(float(scale)))


def gear_code(text: Column) -> Column:
    """Code of the first gear letter or digit in a text."""
    c = F.regexp_extract(F.upper(text), "[PRND0-9]", 0)
    letters = F.create_map(*[F.lit(x) for kv in GEARS.items() for x in kv])
    digit = F.when(c.rlike("[0-9]"), c).cast("double")
    return F.coalesce(F.try_element_at(letters, c).cast("double"), digit)


def every_nth(frames: DataFrame, index: DataFrame, stride: int = 3) -> DataFrame:
    """Every ``stride``-th video frame with its time from the index."""
    return frames.filter(F.col("frame") % stride == 0).join(index, ["session_id", "frame"])


def route(labels: DataFrame) -> DataFrame:
    """Target stream of a label by its region kind, and photo or video as source."""
    streams = F.create_map(*[F.lit(x) for kv in STREAM_OF.items() for x in kv])
    source = F.when(F.col("wanted") == "photos", "photos").when(F.col("wanted") == "video", "video").when(
        F.col("kind").isin("digits", "gear"), "photos"
    ).otherwise("video")
    x = labels.withColumn("stream", F.try_element_at(streams, "kind"))
    return x.withColumn("source", F.when(F.col("have_photos"), source).otherwise("video"))


def roi_counts(routed: DataFrame) -> DataFrame:
    return routed.filter("value IS NOT NULL").groupBy("session_id", "stream", "source", "name").agg(F.count(F.lit(1)).alias("n"))
