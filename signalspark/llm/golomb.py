"""Golomb-Rice coding of sorted integers in numpy: quotients in unary, remainders in k bits."""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray, span: int) -> tuple[int, bytes, bytes]:
    """Code ascending distinct values below ``span``: (k, unary bits, remainder bits)."""
    n = len(values)
    if n == 0:
        return 0, b"", b""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    k = max(0, int(span // n).bit_length() - 1)
    quotients = gaps >> k
    unary = np.ones(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    bits = (gaps[:, None] >> np.arange(k)) & 1
    return k, np.packbits(unary).tobytes(), np.packbits(bits.astype(np.uint8)).tobytes()


def decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    if n == 0:
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * k).reshape(n, k).astype(np.int64)
    return np.cumsum((quotients << k) + bits @ (np.int64(1) << np.arange(k, dtype=np.int64)))
