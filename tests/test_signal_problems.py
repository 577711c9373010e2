"""Regular grids and implausible readings against plain Python."""

import random
from collections import defaultdict

import numpy as np

from sensorframe.operators import grid, spikes

S = 1_000_000


def test_grid_slots(spark):
    r = random.Random(3)
    rows, t = [], 0
    for _ in range(600):
        t += r.choice([1, 3, 7, 20, 119, 120, 121, 500, 4000]) * S
        rows.append((r.choice(["a", "b", None]), t + r.randrange(S), r.choice([1.0, 5.0, None, float("nan")]), "x"))
    rows += rows[:5]
    got = grid.regular_grid(spark.createDataFrame(rows, "d string, at long, v double, slice string"), "d", "at", "v").collect()
    by = defaultdict(list)
    for d, at, v, _ in rows:
        if d and v is not None and v == v:
            by[d].append(at)
    want = set()
    for d, ts in by.items():
        ts.sort()
        for a, b in zip(ts, ts[1:]):
            if b - a <= 120 * S:
                want |= {(d, k * 5 * S) for k in range(a // (5 * S) + 1, b // (5 * S))}
    filled = [(x.d, x.slot_start_us) for x in got if x.filled]
    assert set(filled) == want and len(filled) == len(want)
    assert {(x.d, x.slot_start_us) for x in got if not x.filled} == {(d, t // (5 * S) * 5 * S) for d, ts in by.items() for t in ts}
    assert all(np.isfinite(x.value) for x in got)


def test_ssa_beats_a_straight_line():
    t = np.arange(300)
    true = 10 * np.sin(t / 4) + t / 50
    x = true.copy()
    gap = np.r_[40:52, 130:140, 200:215]
    x[gap] = np.nan
    line = np.interp(t, t[~np.isnan(x)], x[~np.isnan(x)])
    got, converged = grid.ssa_impute(x)
    assert converged
    assert np.abs(got - true)[gap].mean() < 0.2 * np.abs(line - true)[gap].mean()
    assert (got[~np.isnan(x)] == x[~np.isnan(x)]).all()


def test_ssa_small_series():
    for x in ([], [np.nan], [1.0, np.nan, 3.0], [2.0] * 5 + [np.nan] * 3 + [2.0] * 9):
        out, converged = grid.ssa_impute(np.array(x, float))
        assert len(out) == len(x) and converged
    assert grid.ssa_impute(np.array([1.0, np.nan, 3.0]))[0].tolist() == [1, 2, 3]
    rough = np.random.default_rng(0).normal(0, 1, 60)
    rough[::3] = np.nan
    assert not grid.ssa_impute(rough, rounds=1)[1]


def test_grid_empty(spark):
    assert grid.regular_grid(spark.createDataFrame([], "d string, at long, v double"), "d", "at", "v").collect() == []


def series(n, seed, level=1000.0, noise=20.0):
    r = np.random.default_rng(seed)
    return (np.cumsum(r.integers(700, 1400, n)) * 1000).astype(int), np.round(level + r.normal(0, noise, n))


def planted():
    rows, cases, k = [], set(), 0
    for d in range(4):
        noise = [20, 200, 5, 60][d]
        t, v = series(3000, d, 1000 * d, noise)
        t = t + (2 * 3600 * S - 40 * S)  # so runs cross a slice border
        bad = set()
        for i in (100, 700, 701, 1500):  # alone, and two in a row
            v[i] += 25 * noise
            bad.add(i)
        v[2000:] += 30 * noise  # a lasting change of level
        v[20:60] = v[20]
        bad |= set(range(20, 60))
        v[300:307] = v[300]  # seven are too few
        v[400:403] += 25 * noise  # three in a row are no spike
        v[900] = 40000
        bad.add(900)
        for i in range(3000):
            for _ in range(2 if i % 500 == 0 else 1):
                rows.append(("imu", k, f"d{d}", int(t[i]), float(v[i]), "x"))
                if i in bad:
                    cases.add(k)
                k += 1
    return rows, cases


def test_implausible(spark):
    rows, cases = planted()
    odd = [("imu", 10**6, None, 5, 1e9, "x"), ("imu", 10**6 + 1, "d0", None, 1e9, "x"), ("imu", 10**6 + 2, "d0", 7, None, "x"), ("imu", 10**6 + 3, "d0", 8, float("nan"), "x"), ("imu", 10**6 + 4, "lone", 8, float("inf"), "x"), ("eda", 10**6 + 5, "lone", 8, -1.0, "x")]
    df = spark.createDataFrame(rows + odd, "signal string, row_id long, device_id string, at_us long, value double, slice string")
    got = [(x.signal, x.row_id) for x in spikes.implausible(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {("imu", c) for c in cases} | {("imu", 10**6 + 4), ("eda", 10**6 + 5)}


def test_run_over_many_slices(spark):
    rows = [("imu", i, "d", i * 3 * 3600 * S, 7.0) for i in range(8)] + [("imu", 100 + i, "e", i * 3 * 3600 * S, 7.0) for i in range(7)]
    got = {x.row_id for x in spikes.implausible(spark.createDataFrame(rows, "signal string, row_id long, device_id string, at_us long, value double")).collect()}
    assert got == set(range(8))


def test_copies_and_empty(spark):
    schema = "signal string, row_id long, device_id string, at_us long, value double"
    rows = [("eda", i, "d", 5, 1.0) for i in range(5000)]
    assert spikes.implausible(spark.createDataFrame(rows, schema)).collect() == []
    assert spikes.implausible(spark.createDataFrame([], schema)).collect() == []


def test_esd_limits():
    # Rosner's published critical values for n = 54, alpha = 0.05
    assert np.allclose(spikes.esd_limits(54, 3), [3.158, 3.151, 3.143], atol=0.02)


def test_esd_takes_the_scale_again_after_each_removal():
    rng = np.random.default_rng(4)
    rest = rng.normal(0, 1, 400)
    rest[:60] = np.where(np.arange(60) % 2, 9.0, -7.0)  # many outliers, that would hide each other from a plain deviation
    assert set(np.flatnonzero(spikes.esd_outliers(rest))) >= set(range(60))
    assert spikes.esd_outliers(rest).sum() <= 62 and spikes.esd_outliers(rest[60:]).sum() <= 2
    assert spikes.esd_outliers(np.zeros(9)).sum() == 0 and spikes.esd_outliers(np.array([1.0, 2.0])).sum() == 0
    assert spikes.esd_outliers(np.r_[np.zeros(9), 5.0]).tolist() == [False] * 9 + [True]


def test_season_is_removed_only_where_it_stands_out():
    t = np.arange(2000) * S
    phase = (t % (60 * S)) * 12 // (60 * S)
    rng = np.random.default_rng(0)
    group, usable, minute = np.zeros(2000, int), np.ones(2000, bool), np.full(2000, 60 * S)
    pattern = np.where(phase < 6, 5.0, -5.0)
    assert (spikes.season(t, rng.normal(0, 1, 2000), group, usable, minute) == 0).all()
    strong = spikes.season(t, pattern + rng.normal(0, 1, 2000), group, usable, minute)
    assert np.abs(strong - pattern)[(phase % 6 > 0) & (phase % 6 < 5)].max() < 1
    assert (spikes.season(t, pattern, group, usable, minute * 0) == 0).all()


def small_spikes():
    """A series with a cycle of a minute and spikes of eight variations, which the rule of ten leaves to the test."""
    rng = np.random.default_rng(7)
    at = np.cumsum(rng.integers(700, 1300, 4000)) * 1000
    v = rng.normal(0, 20, 4000) + 150 * np.sin(2 * np.pi * at / (60 * S))
    bad = np.arange(50, 4000, 150)
    v[bad] += 160
    return at, v, set(bad.tolist())


def test_esd_and_season_decide(monkeypatch):
    at, v, bad = small_spikes()
    n = len(v)
    flags = lambda period, ratio=None: set(np.flatnonzero(spikes.spike_flags(at, v, np.zeros(n, int), np.full(n, 20.0), np.ones(n, bool), np.zeros(n, bool), np.full(n, period), ratio)).tolist())
    found = flags(60 * S)
    assert len(found & bad) >= 0.95 * len(bad) and len(found - bad) <= 16
    assert len(flags(0) & bad) < 0.8 * len(found & bad)  # without the season
    assert flags(60 * S, 10.0) == set()
    monkeypatch.setattr(spikes, "esd_outliers", lambda rest: np.ones(len(rest), bool))
    assert len(flags(60 * S) - bad) > 100  # without the test


def test_the_period_is_found_by_source(spark):
    at, v, bad = small_spikes()
    rng = np.random.default_rng(1)
    flat = np.cumsum(rng.normal(0, 5, 4000)) + rng.normal(0, 20, 4000)
    rows = [("imu", i, d, int(t), float(x)) for d, xs in (("cycle", v), ("flat", flat)) for i, (t, x) in enumerate(zip(at, xs))]
    df = spark.createDataFrame(rows, "signal string, row_id long, device_id string, at_us long, value double")
    own = df.selectExpr("*", f"at_us div {spikes.SLICE_US} as slice", "true as own")
    assert {r.device_id: r.period for r in spikes.source_behaviour(own).collect()} == {"cycle": 60 * S, "flat": 0}
    got = {r.row_id for r in spikes.implausible(df.where("device_id = 'cycle'"), ratio=None).collect()}
    assert len(got & bad) >= 0.9 * len(bad)


def test_slow_sources_and_other_values_of_a_time(spark):
    rng = np.random.default_rng(3)
    rows = [("eda", i, "slow", i * 100 * S, float(x)) for i, x in enumerate(np.round(1000 + rng.normal(0, 10, 200)))]
    rows[60] = (*rows[60][:4], 3000.0)  # a source with a reading every 100 s
    rows += [("eda", 1000 + i, "quick", i * S, float(x)) for i, x in enumerate(np.round(1000 + rng.normal(0, 10, 300)))]
    rows += [("eda", 5000, "quick", 150 * S, 4000.0)]  # beside a normal reading of the same time
    got = {r.row_id for r in spikes.implausible(spark.createDataFrame(rows, "signal string, row_id long, device_id string, at_us long, value double")).collect()}
    assert got == {60, 5000}
