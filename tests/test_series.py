from __future__ import annotations

import math
import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame, functions as F

from helpers import frames
from signalspark.functions import stats
from signalspark.operators import align as al
from signalspark.operators import causality as ca
from signalspark.operators import clusters as cl
from signalspark.operators import fields as fd
from signalspark.operators import identify as idn
from signalspark.operators import scoring
from signalspark.operators import tseries as ts
from signalspark.operators import warping
from signalspark.operators.warping import dtw_similarity, warp_similarity

S = "session_id string, t double, v double"


def series(spark, pts, name="s"):
    return spark.createDataFrame([(name, float(t), float(v)) for t, v in pts], S)


def test_linear_fit_and_guarded_pearson(spark):
    df = spark.createDataFrame([("a", float(x), 0.01 * x - 2) for x in range(50)] + [("b", 1.0, float(x)) for x in range(5)], "k string, x double, y double")
    got = {r.k: r for r in ts.linear_fit(df, ["k"]).collect()}
    assert abs(got["a"].scale - 0.01) < 1e-12 and abs(got["a"].offset + 2) < 1e-9 and abs(got["a"].r - 1) < 1e-12
    assert (got["b"].scale, got["b"].offset, got["b"].r) == (0.0, 0.0, 0.0)
    assert df.filter("k = 'b'").agg(stats.pearson(F.col("x"), F.col("y"))).first()[0] == 0.0


def test_common_grid_overlap(spark):
    a = spark.createDataFrame([("s", 0.0, 10.0), ("s", 5.0, 20.0)], "session_id string, t_start double, t_end double")
    g = ts.common_grid(a, ["session_id"], 1.0).first()
    assert (g.t0, g.n_grid) == (5.0, 6)


def test_resample_gap_and_left_interval(spark):
    s = series(spark, [(0, 0), (1, 1), (5, 5)])
    grid = spark.createDataFrame([("s", 0.5, 4)], "session_id string, t0 double, n_grid long")
    got = {r.gi: r.v for r in ts.resample(s, grid, ["session_id"], ["session_id"], 1.0, 2.0).collect()}
    assert got == {0: 0.5}
    edge = spark.createDataFrame([("s", 0.0, 6)], "session_id string, t0 double, n_grid long")
    got = {r.gi: r.v for r in ts.resample(s, edge, ["session_id"], ["session_id"], 1.0, 2.0).collect()}
    assert got == {0: 0.0, 1: 1.0}


def test_resample_matches_numpy(spark):
    rng = random.Random(4)
    t = sorted({round(rng.uniform(0, 100), 3) for _ in range(80)})
    v = [rng.gauss(0, 1) for _ in t]
    grid = spark.createDataFrame([("s", t[0], int((t[-1] - t[0]) * 2) + 1)], "session_id string, t0 double, n_grid long")
    got = {r.gi: r.v for r in ts.resample(series(spark, zip(t, v)), grid, ["session_id"], ["session_id"], 2.0, None, 10.0).collect()}
    want = np.interp(t[0] + np.arange(len(got)) / 2.0, t, v)
    assert len(got) == int((t[-1] - t[0]) * 2) + 1
    assert np.allclose([got[i] for i in range(len(got))], want)


def test_best_lag_sign(spark):
    pts = [(i, math.sin(i / 9.0) + 0.3 * math.sin(i / 3.1)) for i in range(300)]
    mk = lambda d: spark.createDataFrame([("s", i, float(math.sin((i - d) / 9.0) + 0.3 * math.sin((i - d) / 3.1))) for i, _ in pts], "session_id string, gi long, v double")
    b = ts.best_lag(mk(0), mk(7), ["session_id"], 10.0, 2.0).first()
    assert b.lag == -0.7 and b.r > 0.999


def plain_lags(ref, sig, k):
    """{lag: (r, n)} of two {grid index: value} series, pair by pair."""
    out = {}
    for lag in range(-k, k + 1):
        both = [(v, ref[i + lag]) for i, v in sig.items() if i + lag in ref]
        if not both:
            continue
        x, y = np.array(both).T
        flat = len(both) < 3 or x.std() < 1e-12 or y.std() < 1e-12
        out[lag] = (0.0 if flat else float(np.corrcoef(x, y)[0, 1]), len(both))
    return out


@pytest.mark.parametrize("run", [4096, 25])
def test_lags_of_gappy_series_across_runs(spark, monkeypatch, run):
    monkeypatch.setattr(ts, "LAG_RUN", run)
    rng = random.Random(run)
    sides, want = ([], []), {}
    for name, base in (("plain", 0.0), ("far", 1e6), ("still", 7.0), ("apart", 0.0)):
        walk = np.cumsum([rng.gauss(0, 1) for _ in range(260)])
        at = lambda i: 0.0 if name == "still" and i < 200 else walk[i]  # noqa: B023, E731
        sig = {i: float(base + at(i)) for i in range(240) if rng.random() < 0.8 and not 90 < i < 110}
        ref = {i + 4: float(3 * base + 2 * at(i) + rng.gauss(0, 0.1)) for i in range(240) if rng.random() < 0.7}
        if name == "apart":
            ref = {i + 1000: v for i, v in ref.items()}
        want[name] = plain_lags(ref, sig, 9)
        for side, x in zip(sides, (ref, sig), strict=True):
            side += [(name, i, v) for i, v in x.items()] + [(name, 5000, None)]
    ref, sig = (spark.createDataFrame(x, "session_id string, gi long, v double") for x in sides)
    got = ts.lag_scores(ref, sig, ["session_id"], 1.0, 9.0).collect()
    for name, lags in want.items():
        mine = {r.k: (r.r, r.n) for r in got if r.session_id == name}
        assert {k: n for k, (_, n) in mine.items()} == {k: n for k, (_, n) in lags.items()}
        assert all(abs(mine[k][0] - r) < 1e-9 for k, (r, _) in lags.items())
    best = {r.session_id: r.lag for r in ts.best_lag(ref, sig, ["session_id"], 1.0, 9.0).collect()}
    assert best["plain"] == best["far"] == 4.0 and "apart" not in best


def test_causes_lead_across_clocks(spark):
    rng = np.random.default_rng(5)
    v = np.cumsum(rng.normal(size=600))
    cause = spark.createDataFrame([("s", i * 0.05, float(x)) for i, x in enumerate(v)], S).withColumn("clock", F.lit("edge"))
    effect = cause.select("session_id", (F.col("t") + 100.0 + 0.3).alias("t"), "v", F.lit("companion").alias("clock"))
    delta = spark.createDataFrame([("s", 100.0)], "session_id string, delta double")
    got = ca.causality_lead(cause, effect, ["session_id"], alignment=delta).first()
    assert abs(got.lead_s - 0.3) < 1e-9 and got.r > 0.999
    assert tuple(ca.causality_lead(cause, effect, ["session_id"]).first()) == ("s", 0.0, 0.0)


def test_commands_share_the_grids_of_an_effect(spark, monkeypatch):
    rng = np.random.default_rng(8)
    walks = np.clip(128 + np.cumsum(rng.integers(-9, 10, size=(4, 300)), axis=1), 0, 255)
    lengths = [300, 300, 300, 280]  # the last id has a grid of its own
    parts = [frames(spark, [[int(b)] for b in w[:n]], 0x100 + i, 0.05) for i, (w, n) in enumerate(zip(walks, lengths))]
    effect = spark.createDataFrame([("s", "brake", i * 0.05 + 0.3, float(x)) for i, x in enumerate(walks[1])], "session_id string, name string, t double, v double")
    grids, resample = [], ts.resample
    monkeypatch.setattr(ts, "resample", lambda s, grid, *a, **kw: grids.append(grid.count()) or resample(s, grid, *a, **kw))

    def found(some):
        h = fd.frame_history(some)
        fields = fd.candidates(fd.frame_steps(h), drop_counters=False, drop_checksums=False)
        rows = ca.command_candidates(h, fields, effect, min_r=0.05, top_k=1000).collect()
        return {(r.arb_id, r.label): (r.lead_s, round(r.r, 9)) for r in rows}

    together = found(reduce(DataFrame.unionByName, parts))
    assert grids == [2]
    alone = found(parts[1]) | found(parts[3])
    assert alone and alone == {k: v for k, v in together.items() if k[0] in (0x101, 0x103)}
    assert max(together.items(), key=lambda kv: abs(kv[1][1]))[0][0] == 0x101


def test_mutual_information_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = x**2 + rng.normal(scale=0.1, size=400)
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    c, _, _ = np.histogram2d(x, y, bins=16)
    p = c / c.sum()
    outer = p.sum(1, keepdims=True) @ p.sum(0, keepdims=True)
    want = (p[p > 0] * np.log(p[p > 0] / outer[p > 0])).sum()
    assert abs(ts.mutual_information(df, ["k"]).first().mi - want) < 1e-9


def test_derivative_matches_numpy(spark):
    t = [0.0, 0.5, 0.7, 2.0, 2.5, 40.0, 41.0]
    v = [1.0, 2.0, 0.0, 3.0, 3.0, 8.0, 7.0]
    d = {r.t: r.dv for r in ts.derivative(series(spark, zip(t, v)), ["session_id"], 1.0).collect()}
    assert np.allclose([d[x] for x in t], np.gradient(v, t))


def test_derivative_between_equal_times_is_not_finite(spark):
    v = [0.0, 2.0, 2.0, 5.0, 4.0]
    x = spark.createDataFrame([("s", t, y, i) for i, (t, y) in enumerate(zip([0.0, 0.0, 1.0, 1.0, 1.0], v))], S + ", i int")
    got = [r.dv for r in ts.derivative(x, ["session_id"], 60.0, ("t", "i")).orderBy("i").collect()]
    assert got[0] == math.inf and got[4] == -math.inf and not any(map(math.isfinite, got[1:4]))


def _warp_by_table(a, b, band_frac=0.1):
    a, b = (np.asarray(a) - np.mean(a)) / np.std(a), (np.asarray(b) - np.mean(b)) / np.std(b)
    n, m = len(a), len(b)
    band = max(int(band_frac * max(n, m)), abs(n - m) + 1)
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(m, i + band) + 1):
            cost[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
    return 1 / (1 + cost[n, m] / (n + m))


def test_warping_matches_full_table():
    rng = np.random.default_rng(1)
    for n, m in ((3, 3), (40, 40), (50, 37), (25, 31)):
        a, b = rng.normal(size=n).cumsum(), rng.normal(size=m).cumsum()
        assert abs(warp_similarity(a, b) - _warp_by_table(a, b)) < 1e-12
    s = np.sin(np.arange(100) / 8)
    assert warp_similarity(s, np.sin((np.arange(100) - 3) / 8)) > warp_similarity(s, rng.normal(size=100))
    assert warp_similarity([1, 1, 1], s) == 0.0 and warp_similarity([1, 2], s) == 0.0


def test_pairs_of_a_batch_are_warped_side_by_side(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pairs = {f"s{k}": rng.normal(size=(2, 30 + k % 2)).cumsum(1) for k in range(12)} | {"flat": np.ones((2, 30))}
    rows = [(k, i, float(x), float(y)) for k, (a, b) in pairs.items() for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "session_id string, gi long, x double, y double")
    got = {r.session_id: r.similarity for r in dtw_similarity(df, ["session_id"]).collect()}
    assert got.pop("flat") == 0.0 and len(got) == 12
    assert all(abs(got[k] - _warp_by_table(*pairs[k])) < 1e-12 for k in got)
    calls, costs = [], warping._costs
    monkeypatch.setattr(warping, "_costs", lambda x, y, b: calls.append(len(x)) or costs(x, y, b))
    assert warping.warp_similarities(list(pairs.values()))[:12] == list(got[f"s{k}"] for k in range(12)) and calls == [6, 6]


def test_marker_alignment(spark):
    motion = spark.createDataFrame(
        [("s", i / 10, -0.4 if i == 20 else 0.01) for i in range(100)], "session_id string, t double, acc_x double"
    )
    marker = spark.createDataFrame([("s", 0, 2.3, "brake_pulse")], "session_id string, pos int, t double, kind string")
    a = al.align_by_markers(marker, motion).first()
    assert abs(a.delta - 0.3) < 0.05 and a.confidence > 0.9


def test_identify_finds_planted_field_and_partitions_do_not_matter(spark, monkeypatch):
    rng = random.Random(11)
    payloads, raws = [], []
    for i in range(2000):
        raw = int(4000 + 1500 * math.sin(i / 90.0) + 500 * math.sin(i / 37.0))
        raws.append(raw)
        payloads.append([i % 256, raw >> 8, raw & 255, rng.randrange(256), (i // 300) % 3, 0, 0, rng.randrange(256)])
    bus = frames(spark, payloads).unionByName(
        frames(spark, [[rng.randrange(256) for _ in range(8)] for _ in range(2000)], arb_id=0x100)
    )
    refs = spark.createDataFrame(
        [("s", n, i * 0.02 - 0.7, f(raws[i] * 0.01)) for n, f in (("gps_speed", float), ("odd", math.sqrt)) for i in range(0, 2000, 5)],
        "session_id string, name string, t double, v double",
    ).withColumn("clock", F.lit("companion"))
    delta = spark.createDataFrame([("s", -0.7)], "session_id string, delta double")

    def run():
        m = idn.Matching(fd.frame_history(bus), refs, delta)
        return m, [(r.label, round(r.r, 9), round(r.scale, 9)) for r in m.hypotheses().filter("reference = 'gps_speed'").orderBy("rank").collect()]

    m, top = run()
    assert top[0][0] == "0x3C0[1:3]BEu" and top[0][1] > 0.9999 and abs(top[0][2] - 0.01) < 1e-4
    assert not any(label.startswith("0x100") for label, _, _ in top)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert run()[1] == top
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = lambda k: {(r.ref_no, r.arb_id, r.seq): (r.n, round(r.r, 9)) for r in m.scored(k).collect()}
    pruned, full = rows(3), rows(None)
    best = sorted(full, key=lambda k: -abs(full[k][1]))[:3]
    assert all(pruned[k] == full[k] for k in best) and len(pruned) < len(full)
    # runs, id blocks and reference blocks of any size give the same rows
    for points, ids, per in ((50, 1, 1), (1 << 20, 99, 99)):
        monkeypatch.setattr(scoring, "RUN_POINTS", points)
        monkeypatch.setattr(scoring, "IDS", ids)
        monkeypatch.setattr(scoring, "REFS", per)
        assert rows(3) == pruned and rows(None) == full


def _cluster_vectors(spark, seed=3):
    """Two sessions: tight and loose groups, copies of one series, noise, constants and gaps."""
    rng = np.random.default_rng(seed)
    rows = []
    for session, n in (("all", 260), ("small", 30)):
        centres = rng.normal(size=(7, 24))
        for i in range(n):
            c, kind = centres[i % 7], i % 10
            v = c * (-2.0 if i % 3 else 1.0) + rng.normal(size=24) * (0.2, 0.6, 0.45)[i % 3]
            v = rng.normal(size=24) if kind == 7 else np.ones(24) if kind == 8 else centres[0] if kind < 3 else v
            gi = np.sort(rng.permutation(24)[: 18 if kind == 5 else 24])
            if i == 4:
                gi = gi[:2]
            if kind == 9:
                gi = rng.permutation(24)
            rows.append((session, f"s{i:04d}", gi.tolist(), v[gi].tolist(), 24))
    return rows, spark.createDataFrame(rows, "session_id string, name string, gi array<int>, v array<double>, n_grid int")


def _cluster_brute(rows, min_r):
    label = {(r[0], r[1]): r[1] for r in rows}
    full = {(r[0], r[1]): dict(zip(r[2], r[3])) for r in rows}
    links = []
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1]:
                x, y = full[a[0], a[1]], full[b[0], b[1]]
                both = sorted(set(x) & set(y))
                u, w = (np.array([d[k] for k in both]) for d in (x, y))
                if len(both) >= 3 and u.std() > 1e-12 and w.std() > 1e-12 and abs(np.corrcoef(u, w)[0, 1]) >= min_r:
                    links.append(((a[0], a[1]), (b[0], b[1])))
    while True:
        old = dict(label)
        for p, q in links:
            label[p] = label[q] = min(label[p], label[q])
        if old == label:
            return sorted((s, n, c) for (s, n), c in label.items())


@pytest.mark.parametrize("min_r", [0.8, 0.95])
def test_pruned_clusters_equal_brute_force(spark, min_r):
    rows, x = _cluster_vectors(spark)
    want = _cluster_brute(rows, min_r)
    assert 10 < len({(s, c) for s, _, c in want}) < len(want) - 50
    for block, pivots in ((16, 20), (10_000, 3), (10_000, 0)):
        got = cl.connected_components(x.select("session_id", "name"), cl.correlation_edges(x, min_r, block, pivots))
        assert sorted(map(tuple, got.select("session_id", "name", "label").collect())) == want


def test_clusters_copy_few_vectors(spark):
    """Copies and parts of tight clusters meet no block; noise meets in pairs of blocks of bounded size."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 48))
    v = [centres[0] if i % 3 == 0 else centres[i % 10] + 0.2 * rng.normal(size=48) for i in range(2000)]
    v += [rng.normal(size=48) for _ in range(300)]
    x = spark.createDataFrame(
        [("all", f"s{i:05d}", list(range(48)), u.tolist(), 48) for i, u in enumerate(v)],
        "session_id string, name string, gi array<int>, v array<double>, n_grid int",
    )
    table, cells = cl.placed(x, 0.8, 100)
    kinds = {r.kind: r["count"] for r in table.groupBy("kind").count().collect()}
    visitors = cl.visits(table, cells, 0.8)
    sizes = cl.dealt(table, 100).unionByName(cl.met_in_cells(table, visitors, 100)).groupBy(*cl.GROUP).count().collect()
    assert kinds["near"] >= 2000 and max(r["count"] for r in sizes) < 300
    assert sum(r["count"] for r in sizes) < 2300 * 2300 / 100 / 4
    one = cl.placed(x.withColumn("v", cl.F.expr("transform(v, e -> 1D)")), 0.8, 100)[0]
    assert {r.kind for r in one.select("kind").distinct().collect()} == {"far"}
    assert cl.correlation_edges(x.limit(0)).count() == 0


def test_clusters(spark):
    pts = [("s", n, float(i), f(i)) for i in range(60) for n, f in (
        ("A", lambda i: math.sin(i / 5)), ("B", lambda i: -3 * math.sin(i / 5) + 1), ("C", lambda i: float((i * 7919) % 13)))]
    s = spark.createDataFrame(pts, "session_id string, name string, t double, v double")
    got = {r.name: (r.cluster, r.size, r.cluster_no) for r in cl.cluster_series(s, hz=1.0).collect()}
    assert got == {"A": ("A", 2, 1), "B": ("A", 2, 1), "C": ("C", 1, 2)}


def test_components_of_long_chain_and_star(spark):
    names = [f"n{i:03d}" for i in range(60)]
    edges = [("s", a, b) for a, b in zip(names[:40], names[1:40])] + [("s", "n040", n) for n in names[41:59]]
    nodes = spark.createDataFrame([("s", n) for n in names], "session_id string, name string")
    e = spark.createDataFrame(edges, "session_id string, src string, dst string")
    got = {r.name: r.label for r in cl.connected_components(nodes, e).collect()}
    assert {got[n] for n in names[:40]} == {"n000"} and {got[n] for n in names[40:59]} == {"n040"} and got["n059"] == "n059"


def test_components_of_a_long_chain_in_any_order_take_few_rounds(spark):
    order = np.random.default_rng(3).permutation(1000)
    names = [f"n{i:04d}" for i in order]
    nodes = spark.createDataFrame([("s", n) for n in names], "session_id string, name string")
    e = spark.createDataFrame([("s", a, b) for a, b in zip(names, names[1:])], "session_id string, src string, dst string")
    got = cl.connected_components(nodes, e, max_rounds=12).collect()
    assert len(got) == 1000 and {r.label for r in got} == {"n0000"}


def test_labels_of_components_are_not_broadcast(spark, monkeypatch):
    plans, attach = [], cl.attach

    def seen(*args, **kw):
        out = attach(*args, **kw)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(cl, "attach", seen)
    nodes = spark.createDataFrame([("s", f"n{i}") for i in range(9)], "session_id string, name string")
    edges = spark.createDataFrame([("s", f"n{i}", f"n{i + 1}") for i in range(8)], "session_id string, src string, dst string")
    assert {r.label for r in cl.connected_components(nodes, edges).collect()} == {"n0"}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)
