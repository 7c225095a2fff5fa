"""Hashes that occur again, found by an exchange of Golomb-coded fingerprints.

Most band and seed hashes occur once, and a row of theirs that is shuffled meets nothing.
A task sends each owner of a range of fingerprints those it has, sorted and
coded (some 22 bits each, and one that a task has often only once); the owner
returns those that several tasks sent, or one task had more than once.  A filter
of fixed size then keeps the other rows where they are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from signalspark.llm import golomb
from signalspark.llm.tables import listed_in, partitions, remove, store

#: Bits of a fingerprint, the high ones of a hash.
BITS = 40
#: Hashes that a task codes at once, and that one owner may hold at most, on average.
HELD, OWNED = 1 << 19, 1 << 22


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - BITS)).view(np.int64)


def again(df: DataFrame) -> DataFrame:
    """``fp`` of the hashes that occur again in the first column (long, or array of long; no nulls)."""
    column = df.select(df.columns[0])
    size = F.size(column.columns[0]) if column.dtypes[0][1].startswith("array") else F.lit(1)
    total = column.select(F.sum(size).alias("n")).first()["n"] or 0
    owners = max(partitions(df.sparkSession), -(-total // OWNED))
    names = ["owner", "base", "n", "k", "unary", "rest", "twice"]

    def coded(held: list[np.ndarray]) -> pa.RecordBatch:
        fps, times = np.unique(fingerprints(np.concatenate(held)), return_counts=True)
        owner = fps // ((1 << BITS) // owners + 1)
        cut = np.flatnonzero(np.diff(owner, prepend=-1))
        out = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(fps)], strict=True):
            part = fps[a:b]
            k, unary, rest = golomb.encode(part - part[0], int(part[-1] - part[0]) + 1)
            out.append((int(owner[a]), int(part[0]), b - a, k, unary, rest, part[times[a:b] > 1].tobytes()))
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def send(batches) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            values = batch.column(0)
            held.append((values.flatten() if pa.types.is_list(values.type) else values).to_numpy())
            n += len(held[-1])
            if n >= HELD:
                yield coded(held)
                held, n = [], 0
        if n:
            yield coded(held)

    def meet(t: pa.Table) -> pa.Table:
        rows = zip(*(t[c].to_pylist() for c in names[1:6]), strict=True)
        values, times = np.unique(np.concatenate([golomb.decode(n, k, u, r) + base for base, n, k, u, r in rows]), return_counts=True)
        twice = np.frombuffer(b"".join(t["twice"].to_pylist()), np.int64)
        return pa.table({"fp": np.union1d(values[times > 1], twice)})

    sent = column.mapInArrow(send, "owner int, base long, n long, k int, unary binary, rest binary, twice binary")
    return sent.groupBy("owner").applyInArrow(meet, "fp long")


def again_filter(df: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Tells in tasks which hashes may occur again; it is never wrong about those that do."""
    found, path = store(again(df), "again")
    listed = listed_in(found)
    remove(df.sparkSession, path)
    return lambda hashes: listed(fingerprints(hashes))
