"""Byte-token sequences of frames and masked training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from signalspark.functions.payload import to_bytes

# Token numbers after the 256 byte values.
PAD, BOF, EOF, MASK, VOCAB_SIZE = 256, 257, 258, 259, 260
IGNORE = -100


def encode_frames(frames: DataFrame) -> DataFrame:
    """Begin, two id bytes, payload bytes, end."""
    i = lambda c: c.cast("int")
    head = F.array(F.lit(BOF), i(F.shiftright("arb_id", 8).bitwiseAND(255)), i(F.col("arb_id").bitwiseAND(255)))
    return frames.withColumn("tokens", F.concat(head, to_bytes("data"), F.array(F.lit(EOF))))


def pad_tokens(encoded: DataFrame, length: int | None = None) -> DataFrame:
    """All sequences filled to one length, by default the longest."""
    if length is None:
        length = encoded.agg(F.max(F.size("tokens"))).first()[0]
    fill = F.array_repeat(F.lit(PAD), F.lit(length) - F.size("tokens"))
    return encoded.withColumn("tokens", F.concat("tokens", fill))


def mask_tokens(encoded: DataFrame, frame_key: list[str], p: float = 0.15, seed: int = 0) -> DataFrame:
    """Masked input and labels; only byte tokens are masked, others are ignored.

    The draw hashes the frame's key and the position, so it does not depend on
    partitioning or retries.
    """
    def drawn(x: Column, i: Column) -> Column:
        h = F.pmod(F.xxhash64(*[F.col(k) for k in frame_key], i, F.lit(seed)), F.lit(1000000))
        return (x < 256) & (h < F.lit(int(p * 1000000)))

    return encoded.withColumn(
        "labels", F.transform("tokens", lambda x, i: F.when(drawn(x, i), x).otherwise(IGNORE))
    ).withColumn("masked", F.transform("tokens", lambda x, i: F.when(drawn(x, i), MASK).otherwise(x)))
