from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalspark.functions.payload import all_fields
from signalspark.operators import scoring
from signalspark.operators import tseries as ts

FIELDS = all_fields(8)
SEQ = next(f.seq for f in FIELDS if (f.off, f.width, f.endian, f.signed) == (0, 2, "BE", False))
IDS, REFS, POINTS, TOP = 40, 3, 60, 2


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(7)
    raw = rng.integers(0, 60000, (IDS, POINTS + 1))
    frac = rng.random((IDS, POINTS))
    keep = [(1 << 63 - SEQ) if SEQ else -(1 << 63)] + [0] * (-(-len(FIELDS) // 64) - 1)
    rows = [
        ("s", i, 0, POINTS, g, float(frac[i, g]), int(raw[i, g]) << 47 << 1 if raw[i, g] < 32768 else (int(raw[i, g]) << 48) - (1 << 64),
         int(raw[i, g + 1]) << 48 if raw[i, g + 1] < 32768 else (int(raw[i, g + 1]) << 48) - (1 << 64), 0, *keep)
        for i in range(IDS) for g in range(POINTS)
    ]
    names = ", ".join(f"keep_{i} long" for i in range(len(keep)))
    ids = spark.createDataFrame(
        rows, f"group_id string, arb_id long, run long, n_grid long, gi long, frac double, big_0_lo long, big_0_hi long, big_0_at long, {names}"
    )
    x = raw[:, :-1] + frac * (raw[:, 1:] - raw[:, :-1])
    y = rng.random((REFS, POINTS)) * 30000 + x[:REFS]
    gone = {(2, 5), (2, 6)}  # the last reference misses points
    refs = spark.createDataFrame(
        [("s", j, 0, g, float(y[j, g]), 1e-8) for j in range(REFS) for g in range(POINTS) if (j, g) not in gone],
        "group_id string, ref_no int, run long, gi long, v double, slack double",
    )
    r = np.zeros((IDS, REFS))
    for j in range(REFS):
        ok = [g for g in range(POINTS) if (j, g) not in gone]
        r[:, j] = [np.corrcoef(x[i, ok], y[j, ok])[0, 1] for i in range(IDS)]
    return ids, refs, r, x, y


def test_a_task_returns_the_best_of_all_its_ids(sides):
    ids, refs, r, *_ = sides
    got = scoring.pair_sums(scoring.packed_ids(ids), scoring.packed_refs(refs), FIELDS, 1, 10, 0.0, TOP, whole=True).collect()
    want = {(int(i), j) for j in range(REFS) for i in np.argsort(-np.abs(r[:, j]))[:TOP]}
    assert {(p.arb_id, p.ref_no) for p in got} == want and len(got) == TOP * REFS


def test_scores_and_totals_do_not_depend_on_runs(sides, monkeypatch):
    ids, refs, r, *_ = sides
    for run in (16384, 16):
        monkeypatch.setattr(scoring, "RUN_POINTS", run)
        at = F.floor(F.col("gi") / run).cast("long")
        a, b = scoring.packed_ids(ids.withColumn("run", at)), scoring.packed_refs(refs.withColumn("run", at))
        pairs = scoring.pair_scores(a, b, FIELDS, 1, 10, 0.1, None).collect()
        found = {(p.arb_id, p.ref_no): p.r for p in pairs}
        want = {(i, j): r[i, j] for i in range(IDS) for j in range(REFS) if abs(r[i, j]) >= 0.1}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
        for t in scoring.pair_totals(a, b, FIELDS, 1, 10, 0.1).collect():
            of = [p for p in pairs if p.ref_no == t.ref_no]
            assert (t.n_pairs, t.n_strong, t.samples) == (len(of), sum(abs(p.r) > 0.5 for p in of), sum(p.n for p in of))
            assert abs(t.total_r - sum(abs(p.r) for p in of)) < 1e-9


def test_information_of_a_task_is_that_of_the_joined_rows(spark, sides):
    ids, refs, _, x, y = sides
    pairs = [(i, j) for i in range(5) for j in range(REFS)]
    wanted = spark.createDataFrame([("s", j, i, SEQ) for i, j in pairs], "group_id string, ref_no int, arb_id long, seq int")
    got = scoring.information(scoring.packed_ids(ids), scoring.packed_refs(refs), wanted, FIELDS, 1).collect()
    rows = [
        (i, j, float(x[i, g]), float(y[j, g])) for i, j in pairs for g in range(POINTS) if (j, g) not in {(2, 5), (2, 6)}
    ]
    want = ts.mutual_information(spark.createDataFrame(rows, "arb_id long, ref_no int, x double, y double"), ["arb_id", "ref_no"])
    want = {(w.arb_id, w.ref_no): w.mi for w in want.collect()}
    assert len(got) == len(want) == len(pairs)
    assert all(abs(g.mi - want[g.arb_id, g.ref_no]) < 1e-9 for g in got)


def test_few_pairs_of_whole_references_need_their_sums(monkeypatch):
    """The k best of many ids equal those of all correlations, and single precision rules nearly all others out."""
    monkeypatch.setattr(scoring, "STRIP", 50)
    rng = np.random.default_rng(9)
    y = rng.normal(size=(80, 130)) * 10.0 ** rng.integers(-3, 6, 130)
    y[:, 7] = 3.0
    xs = [rng.normal(size=(80, 12)) * 1e4 + 1e6 for _ in range(60)]
    for i, x in enumerate(xs):
        x[:, 0], x[:, 1] = 5.0, -3.0 * y[:, i] + 1.0
        x[:, 2] = x[:, 3] * 2.0  # a tie
    r = np.abs([np.nan_to_num([[np.corrcoef(x[:, i], y[:, j])[0, 1] if x[:, i].std() and y[:, j].std() else 0.0 for j in range(130)] for i in range(12)]) for x in xs])
    one, best, met, found = scoring._Whole(y, False), scoring._Best(3, np.full(130, 1e-8)), [], {}
    near = one.near
    monkeypatch.setattr(one, "near", lambda *a: met.append(near(*a)) or met[-1])
    for k, x in enumerate(xs):
        i, j, sx, sxx, sxy, got = one.pairs(x, 0.05, best)
        assert np.allclose(sxy, (x[:, i] * y[:, j]).sum(0)) and np.allclose(got, r[k, i, j], atol=1e-9)
        found |= {(k, a, b): v for a, b, v in zip(i.tolist(), j.tolist(), got.tolist())}
    flat = r.reshape(-1, 130)
    third = np.maximum(np.sort(flat, axis=0)[-3], 0.05 - 1e-6)
    want = {(*divmod(a, 12), b) for a, b in zip(*(v.tolist() for v in np.nonzero(flat >= third - 1e-8)))}
    assert {p for p, v in found.items() if v >= third[p[2]] - 1e-8} == want and not any(p[2] == 7 for p in want)
    assert sum(len(i) for i, _ in met[20:]) < 0.02 * 40 * 12 * 130
    n, strong, total, samples = sum(scoring._Whole(y, True).added(x, 0.05) for x in xs)
    use = flat >= 0.05
    assert (n == use.sum(0)).all() and (strong == (flat > 0.5).sum(0)).all() and (samples == 80 * n).all()
    assert np.allclose(total, (flat * use).sum(0))


def test_columns_that_are_nearly_equal_are_compared_as_one():
    rng = np.random.default_rng(11)
    y, high, low = rng.normal(size=(90, 40)), rng.integers(0, 256, (90, 8)), rng.integers(0, 256, (90, 8))
    x = np.concatenate([high, high * 256 + low, -3.0 * high, low, np.zeros((90, 1))], axis=1).astype(float)
    one = scoring._Whole(y, False)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.nan_to_num(np.abs(np.corrcoef(x.T, y.T)[: x.shape[1], x.shape[1] :]))
    for mixed in (x, x[:, ::-1], x[:, rng.permutation(x.shape[1])]):  # groups of the last ids are kept where they hold
        at = [int(np.flatnonzero((x == c[:, None]).all(0))[0]) for c in mixed.T]
        i, j = one.near(mixed, np.full(40, 0.2))
        assert len(set(zip(i, j))) == len(i) and set(zip(i, j)) >= set(zip(*np.nonzero(r[at] >= 0.2)))
        assert len(one.kin.heads) == 17 and one.kin.reach(scoring._unit(mixed)).max() < scoring.KIN
