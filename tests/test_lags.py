"""Lag search and resampling of many short series."""

from __future__ import annotations

import random

import pytest
from test_series import plain_lags

from signalspark.operators import tseries as ts


@pytest.mark.parametrize("rows", [7, 10_000])
def test_lags_of_many_short_series_in_batches(spark, rows):
    rng = random.Random(41)
    names = [*(f"s{i}" for i in range(30)), None]
    sides, want = ([], []), {}
    for name in names:
        sig, ref = ({i: rng.random() for i in range(rng.randint(1, 40))} for _ in range(2))
        want[name] = plain_lags(ref, sig, 5)
        for side, x in zip(sides, (ref, sig), strict=True):
            side += [(name, 1, i, v) for i, v in x.items()]
    sides[1].append(("alone", 1, 3, 0.5))
    ref, sig = (spark.createDataFrame(x, "session_id string, arb_id long, gi long, v double") for x in sides)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        scores = ts.lag_scores(ref, sig, ["session_id", "arb_id"], 1.0, 5.0)
        got = scores.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.session_id for r in got} == set(names)
    for name, lags in want.items():
        mine = {r.k: (r.r, r.n) for r in got if r.session_id == name}
        assert {k: n for k, (_, n) in mine.items()} == {k: n for k, (_, n) in lags.items()}
        assert all(abs(mine[k][0] - r) < 1e-9 for k, (r, _) in lags.items())
    # no group of its own in Python for each of many short runs
    assert "CoGroups" not in scores._jdf.queryExecution().executedPlan().toString()


def test_the_grid_comes_to_the_rows_with_their_slices(spark):
    series = [(n, i * 0.5, float(i)) for n in "ab" for i in range(400)]
    series = spark.createDataFrame(series, "session_id string, t double, v double")
    grid = spark.createDataFrame([("a", 10.2, 90)], "session_id string, t0 double, n_grid long")
    out = ts.resample(series, grid, ["session_id"], ["session_id"], 1.0, 2.0)
    got = {(r.session_id, r.gi): r.v for r in out.collect()}
    assert set(got) == {("a", i) for i in range(90)}  # b has no grid
    assert all(abs(v - 2 * (10.2 + i)) < 1e-9 for (_, i), v in got.items())
    assert "_salt" not in out._jdf.queryExecution().optimizedPlan().toString()  # rows are not shuffled anew to meet it
