"""Unpacking against an independent statement of its rules in NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.operators import unpack as U

SCHEMA = "k string, start_ms double, sampling_rate double, sensor_id int, true_ms double, true_index long, x array<double>, y array<double>, extra string"


def oracle(packets, error=0.05, drop_gaps=False):
    """packets: (start, rate, true_ms, true_index, values) of one group. Returns (timestamps, values with None in gaps)."""
    ps = sorted((p for p in packets if len(p[4])), key=lambda p: p[0])
    if all(p[2] is None for p in ps):
        ps = [(s, r, s + (len(v) - 1) * 1000 / r, len(v) - 1, v) for s, r, _, _, v in ps]
    g, at, flat, cum = [], [], [], 0
    for s, r, t, i, v in ps:
        if t is not None and i is not None:
            g.append(cum + i)
            at.append(t)
        cum += len(v)
        flat += list(v)
    base = ps[0][0]
    at = [t - base for t in at]
    fs = [1000 * (b - a) / (t - s) for (a, s), (b, t) in zip([(0, -base), *zip(g, at)], zip(g, at))]
    med = float(np.median(fs))
    ok = [abs(f - med) / med <= error for f in fs]
    if not any(ok):
        return [], []
    mean = float(np.mean([f for f, o in zip(fs, ok) if o]))
    raw, vals, idx, n = [], [], [], 0
    for si in range(g[0]):
        raw.append(at[0] - (g[0] - si) * 1000 / mean)
        vals.append(flat[si])
        idx.append(n)
        n += 1
    for k in range(1, len(g)):
        if ok[k]:
            for si in range(g[k - 1], g[k]):
                raw.append(at[k - 1] + (si - g[k - 1]) * 1000 / fs[k])
                vals.append(flat[si])
                idx.append(n)
                n += 1
        elif drop_gaps:
            n += int((at[k] - at[k - 1]) * med / 1000)
        else:
            for j in range(math.ceil((at[k] - at[k - 1]) * med / 1000)):
                raw.append(at[k - 1] + j * 1000 / med)
                vals.append(None)
                idx.append(n)
                n += 1
    for si in range(g[-1], len(flat)):
        raw.append(at[-1] + (si - g[-1]) * 1000 / mean)
        vals.append(flat[si])
        idx.append(n)
        n += 1
    i, y = np.array(idx, float), np.array(raw)
    slope, cut = np.polyfit(i - i.mean(), y, 1)
    return list(base + cut + slope * (i - i.mean())), vals


def group(seed, n=20, size=50, rate=50.0, lost=(), no_true=(), index=25, none_true=False):
    r = np.random.default_rng(seed)
    out = []
    for k in range(n):
        if k in lost:
            continue
        start = 1.7e12 + k * size * 1000 / rate
        t = None if none_true or k in no_true else start + index * 1000 / rate + r.normal(0, 0.5)
        out.append((start, rate, t, None if t is None else index, [float(x) for x in r.integers(-9999, 9999, size)]))
    return out


GROUPS = {
    "clean": group(0), "lost": group(1, lost=(7,)), "two lost": group(2, lost=(3, 4, 12)), "no true ends": group(3, no_true=(0, 9, 19)), "none true": group(4, none_true=True, lost=(5,)),
    "index 0": group(5, index=0), "index len": group(6, index=50, lost=(8,)), "mixed": [(*p[:4], p[4][: 48 + 2 * (i % 2)]) for i, p in enumerate(group(7))], "empty packet": group(8) + [(1.7e12 + 5, 50.0, None, None, [])],
}


def frame(spark, groups):
    rows = [(k, s, r, 1, t, i, v, [2 * x for x in v], f"{k}-{n}") for k, ps in groups.items() for n, (s, r, t, i, v) in enumerate(ps)]
    return spark.createDataFrame(rows[::-1], SCHEMA)


@pytest.mark.parametrize("drop_gaps", [False, True])
def test_native(spark, drop_gaps):
    out = U.unpack(frame(spark, GROUPS), ["k"], ["x", "y"], ["extra"], drop_gaps=drop_gaps).collect()
    for k, ps in GROUPS.items():
        got = sorted((r.timestamp_ms, r.x, r.y, r.extra) for r in out if r.k == k)
        ts, vals = oracle(ps, drop_gaps=drop_gaps)
        assert len(got) == len(ts), k
        assert np.abs(np.array([g[0] for g in got]) - ts).max() < 0.005, k
        assert [g[1] for g in got] == vals and all(b == (None if a is None else 2 * a) for _, a, b, _ in got), k
        assert all((e is None) == (a is None) for _, a, _, e in got)
        gaps = np.diff([g[0] for g in got])
        assert drop_gaps or np.allclose(gaps, gaps[0], atol=0.01)


def test_single_packet_and_empty(spark):
    one = {"one": group(0, n=1)}
    with pytest.raises(Exception, match="nominal"):
        U.unpack(frame(spark, one), ["k"], ["x"]).collect()
    assert U.unpack(frame(spark, one), ["k"], ["x"], on_rate="drop").count() == 0
    assert U.unpack(frame(spark, one).where("false"), ["k"], ["x"]).count() == 0


def test_errors(spark):
    p = frame(spark, {"a": group(0)})
    with pytest.raises(Exception, match="length"):
        U.unpack(p.withColumn("y", F.slice("y", 1, 10)), ["k"], ["x", "y"]).collect()
    with pytest.raises(Exception, match="several sensors"):
        U.unpack(p.withColumn("sensor_id", F.when(F.col("extra") == "a-3", 2).otherwise(1)), ["k"], ["x"]).collect()
    with pytest.raises(ValueError):
        U.unpack(p, ["k"], ["x"], on_rate="warn")
    empty = U.unpack(p.withColumn("y", F.array().cast("array<double>")), ["k"], ["x", "y"]).collect()
    assert len(empty) == 1000 and all(r.y is None for r in empty)


def test_rate_modes(spark):
    p = frame(spark, {"off": [(s, 80.0, t, i, v) for s, r, t, i, v in group(0)], "fine": group(1)})
    assert [r.k for r in U.rate_off(p, ["k"], ["x"]).collect()] == ["off"]
    assert U.unpack(p, ["k"], ["x"], on_rate="ignore").count() == 2000
    both = U.unpack_or_legacy(p, ["k"], ["x"])
    assert both.where("k = 'fine'").count() == 1000 and both.where("k = 'off'").count() == 1000


def test_legacy_overlap(spark):
    p = frame(spark, {"a": [(0.0, 10.0, None, None, [1.0, 2.0, 3.0, 4.0]), (250.0, 10.0, None, None, [5.0, 6.0])]})
    assert [(r.timestamp_ms, r.x) for r in U.unpack_legacy(p, ["k"], ["x"]).orderBy("timestamp_ms").collect()] == [(0, 1), (100, 2), (200, 3), (250, 5), (350, 6)]


def test_unpack_signal(spark):
    from datetime import datetime, timezone

    from sensorframe import schema as sc

    meta = sc.METADATA.simpleString()
    rows = []
    for device in ("C2Q1", "dev"):
        for s, _, t, i, v in group(3, n=20):
            at = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc)
            rows.append(((1, device, "p", 1, None, None, ["x"]), at(s), [int(x) for x in v], 50, 0, at(t), i))
    df = spark.createDataFrame(rows, f"data_point_metadata {meta}, measurement_timestamp_utc timestamp, raw_adc array<bigint>, sampling_rate long, sensor_id long, true_timestamp_millis timestamp, true_timestamp_sample_index long")
    out = U.unpack_signal(df, "eda", on_rate="ignore")
    assert out.count() == 2000 and out.select("data_point_metadata.device_id").distinct().count() == 2
    assert out.first().data_point_metadata.annotation_labels == ["x"]
    with pytest.raises(ValueError):
        U.unpack_signal(df, "eda", sensor_id="0")
    src = spark.createDataFrame([(1, "7")], "data_source_id long, sensor_id string")
    assert U.unpack_signal(df, "eda", "7", src, on_rate="ignore").count() == 2000
    assert U.unpack_signal(df, "eda", "8", src, on_rate="ignore").count() == 0
