"""Arrow passes over a text column, shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows, and bytes of text, whose texts and results are Python objects at once.
ROWS, BYTES = 1024, 4 << 20
#: Bytes to bytes: A-Z to a-z, nothing else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and number of rows of runs of at most ``ROWS`` rows and, unless one row has more, ``BYTES`` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = size[at - 1] if at else 0
        end = min(at + ROWS, max(at + 1, int(np.searchsorted(size, before + BYTES, "right"))))
        yield at, end - at
        at = end


def with_columns(
    df: DataFrame,
    task: Callable[[], Callable[..., Sequence]],
    fields: str,
    inputs: Sequence[Column | str],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append columns computed from ``inputs`` of each row, without a shuffle.

    ``task`` is called once per task and returns a function that takes one list
    per input and returns one list per new column.  The first input is a text
    (string or binary), whose size bounds what is in memory at once.  An input
    may name a string column to be read as bytes; if it is carried along anyway,
    it is sent to Python once.  ``keep``
    names the columns to carry along (default: all); a new column replaces an
    old one of the same name.  Rows keep their order and number.
    """
    new = T._parse_datatype_string(fields)
    names = [f.name for f in new.fields]
    carried = [c for c in (df.columns if keep is None else keep) if c not in names]
    out = T.StructType([df.schema[c] for c in carried] + new.fields)
    arrow = to_arrow_schema(T.StructType(new.fields))
    # clash-free names for the inputs, which may be carried or replaced
    free = (n for i in range(10**6) if (n := f"_text{i}") not in (*carried, *names))
    cols, place = [F.col(f"`{c}`") for c in carried], []
    for c in inputs:
        if isinstance(c, str) and c in carried:
            place.append(carried.index(c))
            continue
        place.append(len(cols))
        cols.append((F.col(f"`{c}`") if isinstance(c, str) else c).alias(next(free)))
    as_bytes = [isinstance(c, str) for c in inputs]
    n = len(carried)

    def run(batches):
        fn = task()
        for batch in batches:
            texts = [batch.column(at) for at in place]
            texts = [t.cast(pa.binary()) if b else t for t, b in zip(texts, as_bytes, strict=True)]
            for at, rows in slices(texts[0]):
                part = batch.slice(at, rows)
                values = fn(*(t.slice(at, rows).to_pylist() for t in texts))
                arrays = [part.column(i) for i in range(n)]
                arrays += [pa.array(v, type=f.type) for v, f in zip(values, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *names])
        pa.default_memory_pool().release_unused()  # an idle worker outlives its task

    return df.select(*cols).mapInArrow(run, out)


def with_text_columns(
    df: DataFrame,
    task: Callable[[], Callable[[list], Sequence]],
    fields: str,
    text: str = "text",
    keep: Sequence[str] | None = None,
    binary: bool = False,
) -> DataFrame:
    """``with_columns`` of one text column: ``bytes`` if ``binary``, None for null."""
    named = binary and df.schema[text].dataType == T.StringType()
    return with_columns(df, task, fields, [text if named else F.col(f"`{text}`").cast("binary" if binary else "string")], keep)
