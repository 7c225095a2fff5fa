"""Shape similarity of two series by banded dynamic time warping.

The recurrence runs along both series, so it has no relational form; Spark
pairs and groups the series, and a task warps the pairs of a batch side by side.  A pair is
two series on a grid, whose length follows the grid and not the row counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


#: Numbers of pairs that are warped side by side.
CELLS = 1 << 18


def _zscore(v: np.ndarray) -> np.ndarray | None:
    v = v[np.isfinite(v)]
    if len(v) < 3 or v.std() < 1e-12:
        return None
    return (v - v.mean()) / v.std()


def warp_similarity(a: np.ndarray, b: np.ndarray, band_frac: float = 0.1) -> float:
    """1 / (1 + warping cost per step) within a diagonal band; 0 if degenerate."""
    return warp_similarities([(a, b)], band_frac)[0]


def warp_similarities(pairs: Sequence[tuple[np.ndarray, np.ndarray]], band_frac: float = 0.1) -> list[float]:
    """``warp_similarity`` of many pairs, those of equal lengths side by side."""
    out, by_size = [0.0] * len(pairs), {}
    for at, (a, b) in enumerate(pairs):
        x, y = _zscore(np.asarray(a, float)), _zscore(np.asarray(b, float))
        if x is not None and y is not None:
            by_size.setdefault((len(x), len(y)), []).append((at, x, y))
    for (n, m), some in by_size.items():
        step = max(1, CELLS // (n + m))
        for k in range(0, len(some), step):
            places, xs, ys = zip(*some[k : k + step])
            for at, cost in zip(places, _costs(np.stack(xs), np.stack(ys), band_frac)):
                out[at] = float(1.0 / (1.0 + cost / (n + m)))
    return out


def _costs(x: np.ndarray, y: np.ndarray, band_frac: float) -> np.ndarray:
    """Least warping cost of every row of ``x`` with that of ``y``.

    Cells are filled one anti-diagonal at a time: a cell needs only the two
    diagonals before it, so a diagonal of all pairs is one vector operation.
    """
    n, m = x.shape[1], y.shape[1]
    band = max(int(band_frac * max(n, m)), abs(n - m) + 1)
    back = y[:, ::-1]
    last = np.full((len(x), n + 1), np.inf)  # diagonal s - 1, indexed by i
    older = np.full((len(x), n + 1), np.inf)  # diagonal s - 2
    older[:, 0] = 0.0
    for s in range(2, n + m + 1):
        lo = max(1, s - m, -((band - s) // 2))
        hi = min(n, s - 1, (s + band) // 2)
        now = np.full((len(x), n + 1), np.inf)
        if lo <= hi:
            near = np.minimum(np.minimum(last[:, lo - 1 : hi], last[:, lo : hi + 1]), older[:, lo - 1 : hi])
            now[:, lo : hi + 1] = (x[:, lo - 1 : hi] - back[:, m - s + lo : m - s + hi + 1]) ** 2 + near
        older, last = last, now
    return last[:, n]


def dtw_similarity(pairs: DataFrame, keys: Sequence[str], band_frac: float = 0.1) -> DataFrame:
    """``pairs`` has keys, ``gi``, ``x``, ``y``; one similarity per key."""
    fields = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", similarity double"
    points = F.sort_array(F.collect_list(F.struct("gi", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))))
    packed = pairs.groupBy(*keys).agg(points.alias("p")).select(*keys, F.col("p.x").alias("x"), F.col("p.y").alias("y"))

    def warp(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[list(keys)].assign(similarity=warp_similarities(list(zip(pdf["x"], pdf["y"])), band_frac))

    # as many tasks as the session shuffles to, however few bytes the series have
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(n, *keys).mapInPandas(warp, schema)
