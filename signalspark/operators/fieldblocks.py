"""Partial statistics of fields, made in numpy from a task's batches of frames.

A batch is cut into runs of one id.  Every field of a batch is a shift and a mask of whole columns,
and a run's statistics are a row per (id, field): no frame is ever copied once per field.  Spark merges
the rows of all runs; everything here is a count, a bound or an integer sum, so merging is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from signalspark.functions.payload import Field

#: Rows of one batch handed back to Spark.
ROWS_OUT = 65_536
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

RANGES = "n bigint, width int, vmin bigint, vmax bigint, n_flips bigint"
MOMENTS = ", ".join(f"{c} bigint" for c in (
    "n0", "s0", "h0", "l0", "n1", "s1", "h1", "l1", "n2", "sc", "hc", "lc", "so", "hx", "lx"
))
MOMENT_COLS = [c.split()[0] for c in MOMENTS.split(", ")]


def word_columns(prefix: str, words: str, payload_words: int) -> list[Column]:
    """The most-significant-first words of a word array as plain columns."""
    return [F.get(words, F.lit(2 * j)).alias(f"{prefix}{j}") for j in range(payload_words)]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _ints(col: pa.Array) -> np.ndarray:
    return (pc.fill_null(col, 0) if col.null_count else col).to_numpy(zero_copy_only=False)


class Words:
    """Decoded fields of a batch: ``prefix`` names the frame's words or those of one before it."""

    def __init__(self, batch: pa.RecordBatch, prefix: str, n: int):
        cols = [_column(batch, f"{prefix}{j}") for j in range(n)]
        self.valid = cols[0].is_valid().to_numpy(zero_copy_only=False)
        big = [_ints(c).view(np.uint64) for c in cols]
        self.words = [x for w in big for x in (w, w.byteswap())]

    def field(self, row: dict) -> np.ndarray:
        v = ((self.words[row["word"]] >> np.uint64(row["shift"])) & np.uint64(row["mask"])).view(np.int64)
        return (v ^ row["half"]) - row["half"] if row["half"] else v


def runs(batch: pa.RecordBatch, keys: Sequence[str]) -> tuple[pa.RecordBatch, np.ndarray]:
    """The batch with rows of equal keys together, and where each key starts."""
    code = np.zeros(batch.num_rows, dtype=np.int64)
    for k in keys:
        one = _column(batch, k).dictionary_encode()
        code = code * (len(one.dictionary) + 1) + pc.fill_null(one.indices, len(one.dictionary)).to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    if len(starts) > code.max(initial=-1) + 1:
        order = np.argsort(code, kind="stable")
        batch, code = batch.take(pa.array(order)), code[order]
        starts = np.flatnonzero(np.diff(code, prepend=-1))
    return batch, starts


def _rows(batch: pa.RecordBatch, keys: Sequence[str], at: np.ndarray, values: dict[str, tuple]) -> Iterator[pa.RecordBatch]:
    """Rows with the keys found at row ``at`` and the given (array, type) columns."""
    for i in range(0, len(at), ROWS_OUT):
        cut = slice(i, i + ROWS_OUT)
        take = pa.array(at[cut])
        cols = [_column(batch, k).take(take) for k in keys]
        cols += [pa.array(a[cut], type=t) for a, t in values.values()]
        yield pa.RecordBatch.from_arrays(cols, names=[*keys, *values])


def _key_schema(df: DataFrame, keys: Sequence[str], more: str) -> StructType:
    schema = StructType([df.schema[k] for k in keys])
    return StructType(schema.fields + StructType.fromDDL(more).fields)


def _map(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: StructType) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(each, schema)


def _sums(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of 64-bit products in two halves that cannot overflow."""
    return np.add.reduceat(x >> 32, starts), np.add.reduceat(x & 0xFFFFFFFF, starts)


def _moments(f: Field, v: np.ndarray, p: np.ndarray, here: np.ndarray, before: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Integer sums of a field, of the value before it, and of both where both are there.

    Unsigned values are moved to the middle of their range, so a square has at most 62 bits.
    """
    mid = 0 if f.signed or f.bit >= 0 else 1 << (8 * f.width - 1)
    both = here & before
    x0, x1 = np.where(here, v - mid, 0), np.where(before, p - mid, 0)
    xc, xo = np.where(both, x0, 0), np.where(both, x1, 0)

    def count(m: np.ndarray) -> np.ndarray:
        return np.add.reduceat(m, starts, dtype=np.int64)

    def total(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, starts)

    return [
        count(here), total(x0), *_sums(x0 * x0, starts),
        count(before), total(x1), *_sums(x1 * x1, starts),
        count(both), total(xc), *_sums(xc * xc, starts),
        total(xo), *_sums(xc * xo, starts),
    ]


def partial_stats(df: DataFrame, keys: Sequence[str], fields: list[Field], n_words: int, lagged: set[int]) -> DataFrame:
    """Range rows per run and field, with moments for the fields numbered in ``lagged``.

    ``df`` has the keys, ``size``, and the words ``w<j>`` and ``q<j>`` of a frame and the one before it;
    without the latter nothing flips.
    """
    rows = [f.row() for f in fields]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch, starts = runs(batch, keys)
        cur = Words(batch, "w", n_words)
        old = Words(batch, "q", n_words) if "q0" in batch.schema.names else None
        both, whole = cur.valid & old.valid if old else None, cur.valid.all()
        n = np.diff(starts, append=batch.num_rows)
        size = np.where(cur.valid, _ints(_column(batch, "size")), -1)
        width = np.maximum.reduceat(size, starts)
        at_once = max(1, ROWS_OUT // len(starts))
        for i in range(0, len(fields), at_once):
            out: list[list[np.ndarray]] = []
            for f, row in zip(fields[i : i + at_once], rows[i : i + at_once]):
                v = cur.field(row)
                p = old.field(row) if old else v
                lo = np.minimum.reduceat(v if whole else np.where(cur.valid, v, HIGHEST), starts)
                hi = np.maximum.reduceat(v if whole else np.where(cur.valid, v, LOWEST), starts)
                flips = np.add.reduceat((v != p) & both, starts, dtype=np.int64) if old else np.zeros(len(starts), np.int64)
                one = [np.full(len(starts), f.seq), n, width, lo, hi, flips]
                if lagged:
                    zeros = [np.zeros(len(starts), dtype=np.int64)] * len(MOMENT_COLS)
                    one += _moments(f, v, p, cur.valid, old.valid, starts) if f.seq in lagged else zeros
                out.append(one)
            names = ["seq", "n", "width", "vmin", "vmax", "n_flips", *(MOMENT_COLS if lagged else [])]
            small = ("seq", "width")
            values = {
                c: (np.concatenate([o[k] for o in out]), pa.int32() if c in small else pa.int64()) for k, c in enumerate(names)
            }
            yield from _rows(batch, keys, np.tile(starts, len(out)), values)

    more = "seq int, " + RANGES + (", " + MOMENTS if lagged else "")
    return _map(df, work, _key_schema(df, keys, more))


def _tally(run: np.ndarray, x: np.ndarray, n_runs: int, low: int, card: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, value and number of every value in every run."""
    code = run * card + (x - low)
    if n_runs * card <= 8 * len(code):
        c = np.bincount(code, minlength=1)
        at = np.flatnonzero(c)
        c = c[at]
    else:
        at, c = np.unique(code, return_counts=True)
    return at // card, at % card + low, c


def partial_counts(df: DataFrame, keys: Sequence[str], fields: list[Field], n_words: int, own: bool, steps: bool) -> DataFrame:
    """Occurrences of values per run and byte group, and with ``steps`` of differences to the frame before.

    ``size`` is the widest payload of the run.  With ``own`` a payload counts only as far as it goes itself.
    """
    rows = [f.row() for f in fields]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch, starts = runs(batch, keys)
        cur = Words(batch, "w", n_words)
        old = Words(batch, "q", n_words) if steps else None
        run = np.repeat(np.arange(len(starts)), np.diff(starts, append=batch.num_rows))
        size = _ints(_column(batch, "size"))
        width = np.maximum.reduceat(np.where(cur.valid, size, -1), starts)
        out: list[tuple] = []
        for f, row in zip(fields, rows):
            here = cur.valid & (size >= f.off + f.width) if own else cur.valid
            v, card = cur.field(row), 1 << (8 * f.width)
            out.append((f, 0, *_tally(run[here], v[here], len(starts), 0, card)))
            if old is not None:
                here = here & old.valid
                out.append((f, 1, *_tally(run[here], (v - old.field(row))[here], len(starts), -card, 2 * card)))
        lens = [len(o[2]) for o in out]
        owner = np.concatenate([o[2] for o in out])
        yield from _rows(batch, keys, starts[owner], {
            "off": (np.repeat([o[0].off for o in out], lens), pa.int32()),
            "width": (np.repeat([o[0].width for o in out], lens), pa.int32()),
            "is_step": (np.repeat([o[1] == 1 for o in out], lens), pa.bool_()),
            "value": (np.concatenate([o[3] for o in out]), pa.int64()),
            "c": (np.concatenate([o[4] for o in out]), pa.int64()),
            "size": (width[owner], pa.int32()),
        })

    return _map(df, work, _key_schema(df, keys, "off int, width int, is_step boolean, value bigint, c bigint, size int"))


def partial_steps(df: DataFrame, keys: Sequence[str], fields: list[Field], n_words: int) -> DataFrame:
    """Counts of short steps per run and wanted field, and one step that repeats there.

    ``df`` is sorted by ``keys``; the first row of a key, not ``is_frame``, lists its wanted fields in
    ``seqs`` and their spans in ``spans``; the frames follow, with words ``w<j>``, ``q<j>``, ``r<j>``.
    """
    rows = [f.row() for f in fields]
    place = np.full(max(f.seq for f in fields) + 1, -1)
    place[[f.seq for f in fields]] = np.arange(len(fields))
    names = ("n", "n_short", "n_zero", "n_near", "n_equal", "step", "c")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_spans = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch, starts = runs(batch, keys)
            is_frame = _column(batch, "is_frame").to_numpy(zero_copy_only=False)
            heads = batch.filter(pc.invert(_column(batch, "is_frame")))
            wanted = np.full((heads.num_rows, len(fields)), -1, dtype=np.int64)
            seqs, spans = _column(heads, "seqs"), _column(heads, "spans")
            owner = np.repeat(np.arange(heads.num_rows), pc.list_value_length(seqs).to_numpy(zero_copy_only=False))
            wanted[owner, place[seqs.flatten().to_numpy(zero_copy_only=False)]] = spans.flatten().to_numpy(zero_copy_only=False)
            span = np.full((len(starts), len(fields)), -1, dtype=np.int64)
            has = np.flatnonzero(~is_frame[starts])
            span[has] = wanted
            here = [tuple(_column(batch, k)[int(starts[i])].as_py() for k in keys) for i in (0, -1)]
            if is_frame[starts[0]] and here[0] == last_key:
                span[0] = last_spans
            last_key, last_spans = here[1], span[-1].copy()

            run = np.repeat(np.arange(len(starts)), np.diff(starts, append=batch.num_rows))
            keep = np.flatnonzero(is_frame & (span >= 0).any(axis=1)[run])
            if not len(keep):
                continue
            batch, run = batch.take(pa.array(keep)), run[keep]
            starts = np.flatnonzero(np.diff(run, prepend=-1))
            span, n = span[run[starts]], np.diff(starts, append=len(run))
            w, q, r = (Words(batch, c, n_words) for c in "wqr")
            there, there1 = w.valid & q.valid, q.valid & r.valid
            numbers = np.arange(len(run))
            out: list[tuple] = []
            for j, (f, row) in enumerate(zip(fields, rows)):
                active = np.flatnonzero(span[:, j] >= 0)
                if not len(active):
                    continue
                limit = np.repeat(span[:, j], n)
                v, p = w.field(row), q.field(row)
                d, d1 = v - p, p - r.field(row)
                ok = there & (2 * np.abs(d) < limit)
                near = ok & there1 & (2 * np.abs(d1) < limit)
                equal = near & (d == d1)
                zero = d == 0
                last = np.maximum.reduceat(np.where(equal & ~zero, numbers, -1), starts)
                step = np.where(last >= 0, d[last], 0)
                same = ok & (d == np.repeat(step, n)) & ~zero
                sums = [np.add.reduceat(m, starts, dtype=np.int64)[active] for m in (ok, ok & zero, near, equal)]
                c = np.add.reduceat(same, starts, dtype=np.int64)[active]
                out.append((np.full(len(active), f.seq), starts[active], n[active], *sums, step[active], c))
            values = {"seq": (np.concatenate([o[0] for o in out]), pa.int32())}
            values |= {c: (np.concatenate([o[k + 2] for o in out]), pa.int64()) for k, c in enumerate(names)}
            yield from _rows(batch, keys, np.concatenate([o[1] for o in out]), values)

    return df.mapInArrow(each, _key_schema(df, keys, "seq int, " + ", ".join(f"{c} bigint" for c in names)))


def partial_ratios(df: DataFrame, keys: Sequence[str], fields: list[Field], n_words: int, max_values: int) -> DataFrame:
    """Sums of every byte per value of every byte that has at most ``max_values`` values in the run."""
    rows = [f.row() for f in fields]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = batch.filter(_column(batch, "w0").is_valid())
        if not batch.num_rows:
            return
        batch, starts = runs(batch, keys)
        words = Words(batch, "w", n_words)
        run = np.repeat(np.arange(len(starts)), np.diff(starts, append=batch.num_rows))
        byte = [words.field(row) for row in rows]
        out: list[tuple] = []
        for i, sel in enumerate(byte):
            at, c = np.unique(run * 256 + sel, return_counts=True)
            few = np.bincount(at // 256, minlength=len(starts)) <= max_values
            mine = few[run]
            if not mine.any():
                continue
            groups, slot = np.unique((run * 256 + sel)[mine], return_inverse=True)
            total = np.bincount(slot)
            for j, other in enumerate(byte):
                if i != j:
                    x = other[mine]
                    s = np.bincount(slot, weights=x).astype(np.int64)
                    q = np.bincount(slot, weights=x * x).astype(np.int64)
                    out.append((np.full(len(groups), fields[i].off), np.full(len(groups), fields[j].off), groups, total, s, q))
        if not out:
            return
        owner = np.concatenate([o[2] for o in out]) // 256
        values = {
            "sel": (np.concatenate([o[0] for o in out]), pa.int32()),
            "other": (np.concatenate([o[1] for o in out]), pa.int32()),
            "sv": (np.concatenate([o[2] for o in out]) % 256, pa.int64()),
            "n": (np.concatenate([o[3] for o in out]), pa.int64()),
            "s": (np.concatenate([o[4] for o in out]), pa.int64()),
            "q": (np.concatenate([o[5] for o in out]), pa.int64()),
        }
        yield from _rows(batch, keys, starts[owner], values)

    return _map(df, work, _key_schema(df, keys, "sel int, other int, sv bigint, n bigint, s bigint, q bigint"))
