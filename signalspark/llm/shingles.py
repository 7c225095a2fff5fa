"""Word shingles of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from signalspark.llm.textmap import LOWER

WORDS = 5
#: Blanks, tabs and line ends part words; A-Z become lower case.
PLAIN = bytes(32 if 9 <= c <= 13 else LOWER[c] for c in range(256))
#: Bytes that are hashed at once: some 20 MB of arrays.
CHUNK = 1 << 19
_LONG = 64
_TABLE = np.random.default_rng(20240102).integers(0, 1 << 63, (_LONG, 256), np.uint64).reshape(-1) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xBF58476D1CE4E5B9)


def _hash_words(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word between blanks: the sum of a random number per byte and place."""
    a = np.frombuffer(blob, np.uint8)
    word = np.zeros(len(a) + 2, bool)
    word[1:-1] = a != 32
    edge = np.flatnonzero(word[1:] != word[:-1]).astype(np.int32)
    start, length = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return start, np.zeros(0, np.uint64)
    first = np.cumsum(length, dtype=np.int32) - length
    place = np.arange(first[-1] + length[-1], dtype=np.int32) - np.repeat(first, length)
    byte = a[word[1:-1]]
    value = _TABLE[((place & (_LONG - 1)) << 8) | byte]
    if length.max() > _LONG:
        value = value * (2 * (place // _LONG) + 1).astype(np.uint64)
    h = np.add.reduceat(value, first) + length.astype(np.uint64)
    h *= _C
    return start, h ^ (h >> np.uint64(31))


def word_hashes(texts: Sequence[bytes | None], table: bytes = PLAIN) -> list[np.ndarray]:
    """Hashes of the words of each text, in order; ``table`` maps bytes, and what parts words to blanks."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        start, h = _hash_words(b" ".join(held))
        at = np.cumsum([0, *(len(t) + 1 for t in held)])
        out.extend(np.split(h, np.searchsorted(start, at[1:-1])))

    for text in texts:
        text = text.translate(table) if text else b""
        if size + len(text) > CHUNK and held:
            flush()
            held, size = [], 0
        if len(text) > 2 * CHUNK:  # cut between words
            parts, at = [], 0
            while at < len(text):
                end = text.find(b" ", at + CHUNK)
                end = len(text) if end < 0 else end
                parts.append(_hash_words(text[at:end])[1])
                at = end
            out.append(np.concatenate(parts))
            continue
        held.append(text)
        size += len(text) + 1
    if held:
        flush()
    return out


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words (of the whole sequence, if it is shorter)."""
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h += hashes[i : i + n]
        h *= _P
    h ^= h >> np.uint64(32)
    h *= _C
    h ^= h >> np.uint64(29)
    return h


def distinct(h: np.ndarray) -> np.ndarray:
    """Distinct values, ascending."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def shingle_sets(texts: Sequence[bytes | None], size: int = WORDS) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending; empty without words."""
    return [distinct(rolled(h, size)) if len(h) else h for h in word_hashes(texts)]
