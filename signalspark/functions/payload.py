"""Payload words and bit-field decoding as Catalyst expressions.

A payload is held as 64-bit words: word ``2j`` has the eight bytes from offset
``4j`` on, most significant first, and word ``2j + 1`` the same bytes reversed.
Every field of up to four bytes then lies inside one word, so decoding is a
shift, a mask and a sign fold, in whichever byte order.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

BYTE_WIDTHS = (1, 2, 3, 4)


def word_count(payload_bytes: int) -> int:
    return max(1, -(-payload_bytes // 4) - 1)


@dataclass(frozen=True)
class Field:
    seq: int
    off: int
    width: int
    endian: str
    signed: bool
    bit: int
    payload_bytes: int = 8

    def row(self) -> dict:
        word = min(self.off // 4, word_count(self.payload_bytes) - 1)
        local = self.off - 4 * word
        little = self.endian == "LE"
        if self.bit >= 0:
            shift, mask = 8 * (7 - local) + 7 - self.bit % 8, 1
        else:
            shift = 8 * local if little else 8 * (8 - local - self.width)
            mask = (1 << (8 * self.width)) - 1
        return {
            "seq": self.seq, "off": self.off, "width": self.width, "endian": self.endian, "signed": self.signed,
            "bit": self.bit, "word": 2 * word + little, "shift": shift, "mask": mask,
            "half": 1 << (8 * self.width - 1) if self.signed else 0,
        }


FIELD_TYPE = (
    "seq int, off int, width int, endian string, signed boolean, bit int, word int, shift int, mask bigint, half bigint"
)


def byte_fields(payload_bytes: int = 8, max_width: int = 4) -> list[Field]:
    """Byte fields ordered by width, offset, big before little, unsigned first."""
    out: list[Field] = []
    for width in BYTE_WIDTHS[:max_width]:
        for off in range(payload_bytes - width + 1):
            for endian in ("BE", "LE") if width > 1 else ("BE",):
                for signed in (False, True):
                    out.append(Field(len(out), off, width, endian, signed, -1, payload_bytes))
    return out


def bit_fields(payload_bytes: int = 8, first_seq: int = 0) -> list[Field]:
    """Single bits, most significant first, numbered across the payload."""
    return [Field(first_seq + b, b // 8, 0, "", False, b, payload_bytes) for b in range(8 * payload_bytes)]


def all_fields(payload_bytes: int = 8, max_width: int = 4, bits: bool = True) -> list[Field]:
    fields = byte_fields(payload_bytes, max_width)
    return fields + bit_fields(payload_bytes, len(fields)) if bits else fields


def field_array(fields: list[Field]) -> Column:
    """The fields as one constant array, folded to a literal by the optimizer."""
    return F.from_json(F.lit(json.dumps([f.row() for f in fields])), f"array<struct<{FIELD_TYPE.replace(' ', ':').replace(',:', ',')}>>")


def to_bytes(data: Column | str) -> Column:
    """BINARY to ARRAY<INT>; an empty payload gives an empty array."""
    data = F.col(data) if isinstance(data, str) else data
    n = F.octet_length(data)
    idx = F.when(n > 0, F.sequence(F.lit(1), n)).when(n == 0, F.array().cast("array<int>"))
    return F.transform(
        idx, lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int")
    )


def big_words(data: str, payload_bytes: int = 8) -> list[Column]:
    """The most-significant-first words of a BINARY; bytes past the end count as zero."""
    def half(at: int) -> str:
        return f"CAST(conv(hex(rpad(substring({data}, {at + 1}, 4), 4, X'00')), 16, 10) AS BIGINT)"

    return [
        F.expr(f"shiftleft({half(4 * j)}, 32) | {half(4 * j + 4)}") for j in range(word_count(payload_bytes))
    ]


def word_array(big: list[str]) -> Column:
    """All words of a payload from columns holding its ``big_words``."""
    return F.expr("array(" + ", ".join(f"{x}, {_swap(x)}" for x in big) + ")")


def _swap(x: str) -> str:
    return "(" + " | ".join(f"shiftleft(shiftrightunsigned({x}, {8 * k}) & 255L, {56 - 8 * k})" for k in range(8)) + ")"


def decode(words: str, f: str = "f") -> Column:
    """Value of field ``f``; NULL when there is no payload."""
    return F.expr(
        f"((shiftrightunsigned(get({words}, {f}.word), {f}.shift) & {f}.mask) ^ {f}.half) - {f}.half"
    )


def byte_at(words: str, pos: str) -> Column:
    """Byte number ``pos`` out of a payload's words."""
    word = f"least({pos} DIV 4, size({words}) DIV 2 - 1)"
    return F.expr(
        f"shiftrightunsigned(get({words}, CAST(2 * {word} AS INT)), CAST(8 * (7 - {pos} + 4 * {word}) AS INT)) & 255L"
    )


def decode_int(data: Column, off: int, width: int, endian: str = "BE", signed: bool = False) -> Column:
    """One fixed field of a BINARY column (no explosion)."""
    part = F.substring(data, off + 1, width)
    if endian == "LE":
        part = F.concat(*[F.substring(data, off + k + 1, 1) for k in range(width - 1, -1, -1)])
    v = F.conv(F.hex(part), 16, 10).cast("long")
    if signed:
        full = 1 << (8 * width)
        v = F.when(v >= full // 2, v - full).otherwise(v)
    return v


def field_label(arb_id: Column, f: str = "f") -> Column:
    """``0x3C0[1:3]BEu`` for byte fields, ``0x3C0#bit12`` for single bits."""
    byte_label = F.format_string(
        "0x%X[%d:%d]%s%s",
        arb_id,
        F.col(f"{f}.off"),
        F.col(f"{f}.off") + F.col(f"{f}.width"),
        F.col(f"{f}.endian"),
        F.when(F.col(f"{f}.signed"), "s").otherwise("u"),
    )
    return F.when(
        F.col(f"{f}.width") == 0, F.format_string("0x%X#bit%d", arb_id, F.col(f"{f}.bit"))
    ).otherwise(byte_label)


def ascii_preview(bytes_col: Column) -> Column:
    """Printable ASCII, a dot for every other byte."""
    return F.array_join(
        F.transform(bytes_col, lambda b: F.when((b >= 32) & (b < 127), F.char(b)).otherwise(".")),
        "",
    )
