"""Periodic runs of words, found from string synchronising sets.

Runs with short periods are read off directly, by comparing every word with the
one so many places on.  Longer periods come scale by scale, tau = 4, 8, 16, ...:

1. Every stretch of tau words has a hash.  A position is *selected* where the
   least hash of the tau + 1 stretches from it on is at one of the two ends.
   Selection looks at 2 tau words only, so where these repeat, it repeats.
2. Stretches of period tau / 3 or less take no part: they would all be equal.
   They are exactly those inside runs that smaller scales have found.
3. A run of period q has, for 3 tau - 1 <= q, a selected position in its first
   q + tau words, and the same one q words on.  So two selected positions with equal
   contexts of 2 tau words, 3 tau - 1 to 6 tau - 2 apart, propose their distance.
4. A proposal is extended word by word to its longest stretch and kept if that
   is three periods long and no divisor of the period is a period too.

Steps 1 to 3 run in numpy over many documents at once, which a word of their
own parts; hashes only select and propose, words decide.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from signalspark.llm.textmap import with_columns

LEAST_WORDS = 24
TIMES = 3
#: First scale; periods below 3 * FIRST - 1 are read off directly.
FIRST = 4
#: Words that are searched at once (a longer document is searched alone).
CHUNK = 1 << 18
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

Run = tuple[int, int, int]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def paired(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of stretches of 2 * size words from those of size words."""
    return mix(h[:-size] * _C1 + mix(h[size:] + _C2)) if len(h) > size else h[:0]


def stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each stretch of at least ``least`` true values."""
    edge = np.flatnonzero(np.diff(equal.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def primitive(w: np.ndarray, start: int, q: int) -> bool:
    """Whether no proper divisor of q is a period of the stretch of period q from ``start`` on."""
    left, r = q, 2
    while left > 1:
        if r * r > left:
            r = left
        if left % r == 0:
            d = q // r
            if np.array_equal(w[start : start + q], w[start + d : start + d + q]):
                return False
            while left % r == 0:
                left //= r
        r += 1
    return True


def agree(w: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words agree from places i < j on, forwards (step 1) or before them (step -1)."""
    n, block = 0, 32
    room = len(w) - j if step > 0 else i
    while n < room:
        k = min(block, room - n)
        a, b = (w[i + n : i + n + k], w[j + n : j + n + k]) if step > 0 else (w[i - n - k : i - n][::-1], w[j - n - k : j - n][::-1])
        differ = a != b
        at = int(differ.argmax())
        if differ[at]:
            return n + at
        n += k
        block *= 2
    return n


def short_runs(w: np.ndarray) -> list[Run]:
    """All runs of three periods or more whose period is below 3 * FIRST - 1."""
    found: list[Run] = []
    for q in range(1, TIMES * FIRST - 1):
        start, end = stretches(w[:-q] == w[q:], (TIMES - 1) * q) if len(w) > q else ((), ())
        found += [(int(a), int(b - a) + q, q) for a, b in zip(start, end, strict=True) if primitive(w, int(a), q)]
    return found


def periodic_starts(n: int, runs: list[Run], tau: int) -> np.ndarray:
    """Whether the stretch of tau words from each place on lies in a run of period tau / 3 or less."""
    edge = np.zeros(n + 1, np.int32)
    for a, length, q in runs:
        if a < n and TIMES * q <= tau <= length:
            edge[a] += 1
            edge[a + length - tau + 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def window_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least value of each ``size`` neighbours."""
    have = 1
    out = x
    while 2 * have <= size:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = size - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def selected(h: np.ndarray, skip: np.ndarray, tau: int) -> np.ndarray:
    """The synchronising set of a scale from the hashes of stretches of tau words."""
    ids = np.where(skip[: len(h)], _NONE, h)
    if len(ids) <= tau:
        return np.zeros(0, np.int64)
    least = window_min(ids, tau + 1)
    n = len(least)
    return np.flatnonzero(((ids[:n] == least) | (ids[tau : tau + n] == least)) & (least != _NONE))


def proposals(places: np.ndarray, context: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """(distance, place) of selected places with equal contexts, so far apart that the scale answers for them."""
    low, high = TIMES * tau - 1, 2 * TIMES * tau - 2
    places = places[places < len(context)]
    c = context[places]
    i, k = np.arange(len(places)), 1
    found: list[tuple[int, int]] = []
    while True:
        i = i[i + k < len(places)]
        gap = places[i + k] - places[i]
        near = gap <= high
        i, gap = i[near], gap[near]
        if not len(i):
            return sorted(found)
        hit = (gap >= low) & (c[i] == c[i + k])
        found += zip(gap[hit].tolist(), places[i[hit]].tolist(), strict=True)
        k += 1


def runs(w: np.ndarray, bounds: np.ndarray) -> list[Run]:
    """(start, length, period) of all runs of three periods or more of a sequence of word numbers.

    ``bounds`` has the ends of its documents, longest first; each but the last
    ends with a word that occurs nowhere else, so no run crosses an end.
    """
    found = short_runs(w)
    h, size, tau = mix(w.astype(np.uint64) * _C1 + _C3), 1, FIRST
    lengths = np.diff(bounds, prepend=0)
    while True:
        # documents that are too short for three of the scale's least periods are at the end
        long = int(np.searchsorted(-lengths, -TIMES * (TIMES * tau - 1), "right"))
        if not long:
            return found
        n = int(bounds[long - 1])
        h = h[:n]
        while size < tau:
            h, size = paired(h, size), 2 * size
        places = selected(h, periodic_starts(n, found, tau), tau)
        last, covered = 0, 0
        for d, at in proposals(places, paired(h, tau), tau):
            if d != last:
                last, covered = d, 0
            if at < covered:
                continue
            left, right = agree(w, at, at + d, -1), agree(w, at, at + d, 1)
            covered = at + right
            if left + right >= (TIMES - 1) * d and primitive(w, at - left, d):
                found.append((at - left, left + right + d, d))
        tau *= 2


def numbered(texts: list[list[bytes]], orders: list[np.ndarray | None]) -> list[np.ndarray]:
    """Each word as a number, the same for the same word, after reordering."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    out = []
    for words, order in zip(texts, orders, strict=True):
        x = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        out.append(x if order is None else x[order])
    return out


def search(sequences: list[np.ndarray]) -> list[list[Run]]:
    """The runs of each sequence that are at least ``LEAST_WORDS`` long, by start, then period."""
    found: list[list[Run]] = [[] for _ in sequences]
    order = sorted((i for i in range(len(sequences)) if len(sequences[i]) >= LEAST_WORDS), key=lambda i: -len(sequences[i]))
    if not order:
        return found
    free = max(int(sequences[i].max()) for i in order) + 1
    joined = np.concatenate([np.append(sequences[i], free + k) for k, i in enumerate(order)]).astype(np.int32)
    ends = np.cumsum([len(sequences[i]) + 1 for i in order])
    for start, length, period in runs(joined, ends):
        if length >= LEAST_WORDS:
            k = int(np.searchsorted(ends, start, "right"))
            found[order[k]].append((start - int(ends[k - 1] if k else 0), length, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in found]


def summary(words: list[bytes], found: list[Run]) -> tuple:
    """Number of runs, the strongest one, the digests, and the words that stay."""
    gone = np.zeros(len(words) + 1, np.int32)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    stay = np.cumsum(gone[:-1]) == 0
    kept = b" ".join([words[i] for i in np.flatnonzero(stay)] if found else words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in found)
    strongest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(found), *strongest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), kept


def find_runs(
    documents: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    order: Callable[[int, object], np.ndarray | None] | None = None,
    order_key: Column | None = None,
    with_text: bool = False,
) -> DataFrame:
    """Find all periodic runs of words of every whole text, and the text without the repeats.

    Words are separated by white space (``\\x20\\x09-\\x0D``).  A run is a longest
    stretch with smallest period q of at least ``max(24, 3 * q)`` words.  Adds
    n_runs; start, length, period and exponent_milli of the run with the greatest
    length / period (ties: smallest start, then period; null without runs);
    runs_sha256 of all runs; collapsed_sha256 of the words that no run repeats
    (after a run's first q words its words go), and with ``with_text`` those
    words (``collapsed``) and the ``runs``.

    ``order`` may reorder a text before the search: from its number of words and
    ``order_key`` it returns the numbers of the words to take, or None.  Null
    and empty texts have no words.  Row by row, without a shuffle: repeated rows
    repeat, an empty table stays empty, ids may be null, and columns with these
    names are replaced.  A text is searched by one task, in memory linear in its words.
    """

    def task():
        def run(texts, keys):
            rows: list[tuple] = []
            at = 0
            split = [(t or b"").split() for t in texts]
            while at < len(split):
                size, end = 0, at
                while end < len(split) and (end == at or size + len(split[end]) <= CHUNK):
                    size += len(split[end])
                    end += 1
                orders = [order(len(w), k) if order else None for w, k in zip(split[at:end], keys[at:end], strict=True)]
                words = [w if o is None else [w[i] for i in o] for w, o in zip(split[at:end], orders, strict=True)]
                for w, found in zip(words, search(numbered(split[at:end], orders)), strict=True):
                    *values, kept = summary(w, found)
                    if with_text:
                        values += [kept.decode("utf-8", "replace"), [dict(zip(("start", "length", "period"), r, strict=True)) for r in found]]
                    rows.append(tuple(values))
                at = end
            return list(zip(*rows, strict=True)) if rows else [[] for _ in range(7 + 2 * with_text)]

        return run

    fields = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    fields += ", collapsed string, runs array<struct<start:long,length:long,period:long>>" * with_text
    return with_columns(documents, task, fields, [F.col(f"`{text}`").cast("binary"), F.lit(None) if order_key is None else order_key], keep)
