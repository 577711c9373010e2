"""Late events, incremental reads, time normalisation and intervals against plain Python."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sensorframe.functions import timeparse, zones
from sensorframe.operators import incremental, intervals, panes, readings

HOUR = 3_600_000_000
META = "data_source_id long, device_id string, participant_id string, participant_namespace long, echo_metadata struct<bucket_start: timestamp, bucket_write_time: timestamp, deleted_time: timestamp, snapshot_time: timestamp>, sensor_store_metadata struct<sensor_store_write_time: timestamp>, annotation_labels array<string>"
POINTS = f"row_id long, data_spec_name string, data_point_metadata struct<{META.replace(' long', ': bigint').replace(' string', ': string').replace('echo_metadata struct', 'echo_metadata: struct').replace('sensor_store_metadata struct', 'sensor_store_metadata: struct').replace('annotation_labels array', 'annotation_labels: array')}>, measurement_timestamp_utc timestamp, rate double, confidence long, pane string, _first int"
T0 = datetime(2019, 6, 3, tzinfo=timezone.utc)


def us(t):
    return int((t - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def point(i, device, spec, at, arrival, rate=1.0, conf=None, deleted=None, bucket=None):
    stored = (arrival,) if arrival else None
    return (i, spec, (1, device, None, None, (None, bucket, deleted, None), stored, []), at, rate, conf, "clash", 1)


def random_points(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        at = T0 + timedelta(minutes=r.randrange(0, 200, 10))
        late = timedelta(minutes=r.choice([1, 30, 61, 119, 120, 180, 2880, 2939, 2940, 2941, 4000]))
        rows.append(point(i, r.choice(["a", "b", None]), r.choice(["s", "t"]), at, r.choice([at + late, None]), r.choice([1.0, 2.0, None, float("nan")]), r.choice([1, None]), r.choice([None] * 9 + [at]), r.choice([None, at + late])))
    return rows


def brute_effective(rows):
    groups = defaultdict(list)
    for i, spec, m, at, rate, conf, *_ in rows:
        arrival = (m[5][0] if m[5] else None) or m[4][1]
        if arrival and not m[4][2]:
            groups[m[1], spec, at].append((arrival, i, (repr(rate), conf), rate))
    out = []
    for (d, spec, at), rs in groups.items():
        before = None
        for k, (arrival, i, v, rate) in enumerate(sorted(rs)):
            if k == 0 or v != before:
                out.append((i, d, spec, at, arrival))
            before = v
    return out


def test_effective_rows_and_outcomes(spark):
    for seed in range(3):
        rows = random_points(300, seed)
        df = spark.createDataFrame(rows, POINTS)
        want = brute_effective(rows)
        eff = readings.effective_rows(df)
        assert sorted(r.row_id for r in eff.collect()) == sorted(w[0] for w in want)
        found = set()
        for _, d, _, at, arrival in want:
            hour = us(at) // HOUR * HOUR
            if d and us(arrival) >= hour + 49 * HOUR:
                found.add((d, hour // 1000, "dropped"))
            elif d and us(arrival) >= hour + 2 * HOUR:
                found.add((d, hour // 1000, "corrected"))
        got = [tuple(r) for r in panes.period_outcomes(panes.corrected_periods(eff)).collect()]
        assert set(got) == found and len(got) == len(found)


def test_sliding_panes(spark):
    r = random.Random(5)
    rows = [(r.choice("xy"), t := r.randrange(0, 600), t + r.choice([0, 50, 130, 400]), float(r.randrange(9))) for _ in range(400)]
    spec = panes.PaneSpec(size=120, slide=50, publish=20, close=200)
    df = spark.createDataFrame(rows, "k string, t long, a long, v double")
    from pyspark.sql import functions as F

    got = {(x.k, x.window_start_us): (x.n_initial, x.total_initial, x.n_final, x.total_final, x.late_events, x.dropped_events) for x in panes.late_corrected(df, ["k"], spec, "t", "a", F.lit(1), F.col("v")).collect()}
    want = defaultdict(lambda: [0, 0.0, 0, 0.0, 0, 0])
    for k, t, a, v in rows:
        for m in range(-5, 13):
            w = m * 50
            if w <= t < w + 120:
                x, late, dropped = want[k, w], a >= w + 140, a >= w + 320
                x[0] += not late
                x[1] += 0 if late else v
                x[2] += not dropped
                x[3] += 0 if dropped else v
                x[4] += late and not dropped
                x[5] += dropped
    assert got == {k: tuple(v) for k, v in want.items()}


def test_redelivered_value_takes_back_the_former(spark):
    rows = [point(1, "a", "s", T0, T0 + timedelta(minutes=5), 10.0), point(2, "a", "s", T0, T0 + timedelta(hours=5), 4.0), point(3, "a", "s", T0, T0 + timedelta(hours=6), 4.0)]
    r = panes.corrected_periods(readings.effective_rows(spark.createDataFrame(rows, POINTS))).collect()
    assert [(x.n_initial, x.total_initial, x.n_final, x.total_final, x.late_events) for x in r] == [(1, 10.0, 1, 4.0, 1)]


RUNS = "log_id long, run_id long, registry string, data_spec_name string, write_start_time timestamp, write_end_time timestamp, logged_at timestamp, run_status string"


def test_unread_rows(spark):
    r = random.Random(1)
    rows = random_points(200, 9)
    h = lambda k: T0 + timedelta(hours=k)
    log = []
    for i in range(60):
        a = r.choice([None, h(r.randrange(60))])
        b = r.choice([None, h(r.randrange(60)), a and a + timedelta(hours=3)])
        log.append((i, i // 2, r.choice(["one", "one", "two", None]), "s", a, b, r.choice([None, h(r.randrange(5))]), r.choice(["SUCCEEDED", "FAILED", None])))
    log.append((99, 99, "three", "t", None, None, None, "FAILED"))
    eff = readings.effective_rows(spark.createDataFrame(rows, POINTS))
    got = sorted((x.registry, x.row_id) for x in incremental.unread_rows(eff, spark.createDataFrame(log, RUNS)).collect())
    last = {}
    for entry in log:
        if entry[2]:
            order = (us(entry[6]) if entry[6] else -1, entry[0])
            if (entry[2], entry[1]) not in last or order > last[entry[2], entry[1]][0]:
                last[entry[2], entry[1]] = (order, entry)
    done = defaultdict(list)
    for (reg, _), (_, e) in last.items():
        if e[7] == "SUCCEEDED" and e[4] and e[5]:
            done[reg].append((e[4], e[5]))
    specs = {(e[2], e[3]) for e in log if e[2]}
    want = sorted((reg, i) for i, _, spec, _, arrival in brute_effective(rows) for reg, s in specs if s == spec and not any(a <= arrival < b for a, b in done[reg]))
    assert got == want


def test_ledger_survives_failures(spark, tmp_path):
    source = spark.range(100).withColumnRenamed("id", "seq")
    ledger = incremental.IntervalLedger(spark, str(tmp_path / "ledger"), bucket=16)
    ranges = lambda *xs: spark.createDataFrame(list(xs), "start_us long, end_us long")
    spans = lambda df: sorted((r.start_us, r.end_us) for r in df.collect())
    run = lambda xs, work=lambda d: d, hook=None: ledger.run(source, "seq", ranges(*xs), work, hook)
    assert ledger.output() is None and spans(ledger.pending(ranges((3, 9)))) == [(3, 9)]
    assert run([(0, 40)])

    def fails(*_):
        raise RuntimeError("lost")

    for work, hook in ((fails, None), (lambda d: d, fails)):  # before any output, and between output and commit
        with pytest.raises(RuntimeError):
            run([(0, 80)], work, hook)
    assert spans(ledger.processed()) == [(0, 40)]
    assert run([(0, 60), (70, 90)]) and spans(ledger.processed()) == [(0, 60), (70, 90)]
    assert spans(ledger.pending(ranges((0, 100)))) == [(60, 70), (90, 100)]
    assert run([(0, 100)]) and sorted(r.seq for r in ledger.output().collect()) == list(range(100))
    assert not run([(0, 100)])


def test_two_runs_with_one_version(spark, tmp_path):
    ledger = incremental.IntervalLedger(spark, str(tmp_path / "ledger"), bucket=16)
    source, all_ = spark.range(50).withColumnRenamed("id", "seq"), spark.createDataFrame([(0, 50)], "start_us long, end_us long")
    other = lambda: ledger.run(source, "seq", all_, lambda d: d)
    with pytest.raises(Exception, match="(?i)exist"):
        ledger.run(source, "seq", all_, lambda d: d, other)
    assert sorted(r.seq for r in ledger.output().collect()) == list(range(50))


def test_subtract(spark):
    r = random.Random(8)
    sides = []
    for _ in range(2):
        rows = []
        for k in "ab":
            m = intervals.IntervalMap()
            for _ in range(6):
                s = r.randrange(100)
                m.insert(s, s + r.randrange(1, 15))
            rows += [(k, s, e) for s, e in m]
        sides.append(rows)
    kind = "k string, start_us long, end_us long"
    got = incremental.subtract(*[spark.createDataFrame(x, kind) for x in sides], ["k"]).collect()
    cells = lambda rows: {(k, t) for k, s, e in rows for t in range(s, e)}
    assert cells(tuple(x) for x in got) == cells(sides[0]) - cells(sides[1])


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(-3, 12)), max_size=40))
@settings(max_examples=200, deadline=None)
def test_interval_map(pairs):
    m, covered = intervals.IntervalMap(), set()
    for s, n in pairs:
        m.insert(s, s + n)
        covered |= set(range(s, s + n))
    assert {x for a, b in m for x in range(a, b)} == covered
    assert all(b < c for (_, b), (c, _) in zip(list(m), list(m)[1:]))


def brute_periods(rows, longest):
    by, out = defaultdict(list), set()
    for d, label, s, e in rows:
        if d is not None and label is not None and s is not None and e is not None and e > s:
            by[d, label].append((s, e))
    for k, xs in by.items():
        m = intervals.IntervalMap()
        for s, e in xs:
            m.insert(s, e)
        out |= {(*k, "period", s, e) for s, e in m} | {(*k, "gap", a, b) for a, b in m.gaps() if b - a <= longest}
    return out


@pytest.mark.parametrize("slice_us", [1, 7, 1000])
def test_periods_and_gaps(spark, slice_us):
    r = random.Random(slice_us)
    rows = []
    for _ in range(300):
        s = r.choice([None, *range(-20, 120)])
        rows.append((r.choice(["a", "b", "a'\"{", None]), r.choice(["x", "y", None]), s, r.choice([None, (s or 0) + r.choice([-3, 0, 1, 2, 5, 40])]), "extra"))
    df = spark.createDataFrame(rows, "device_id string, annotation_label string, start_us long, end_us long, _slice string")
    got = [tuple(x) for x in intervals.periods_and_gaps(df, ["device_id", "annotation_label"], 9, slice_us).collect()]
    want = brute_periods([x[:4] for x in rows], 9)
    assert set(got) == want and len(got) == len(want)


def test_empty_tables(spark):
    eff = readings.effective_rows(spark.createDataFrame([], POINTS))
    assert panes.period_outcomes(panes.corrected_periods(eff)).collect() == []
    assert incremental.unread_rows(eff, spark.createDataFrame([], RUNS)).collect() == []
    df = spark.createDataFrame([], "device_id string, annotation_label string, start_us long, end_us long")
    assert intervals.periods_and_gaps(df, ["device_id", "annotation_label"], 9).collect() == []


TIMES = [
    ("1549966050281", "o", "utc", 1549966050281 * 10**6),
    ("1558920008713944000", "o", "utc", 1558920008713944000),
    ("1559723934.16", "o", "utc", 1559723934160000000),
    ("9223372036854776", "o", "utc", None),
    ("  2019-06-07T09:39:56-07:00[America/Phoenix]\n", "o", "utc", "2019-06-07T16:39:56"),
    ("2018-12-12t21:54:37z", "o", "utc", "2018-12-12T21:54:37"),
    ("20190103T161952Z", "o", "berlin", "2019-01-03T16:19:52"),
    ("2019-03-20 08:53:54 America/New_York", "o", "utc", "2019-03-20T12:53:54"),
    ("2019-04-29 06:53:59 GMT+05:45", "o", "utc", "2019-04-29T01:08:59"),
    ("2019-04-22 18:43:06-04", "o", "utc", "2019-04-22T22:43:06"),
    ("May 11, 2019 7:57:49 PM PDT", "o", "utc", "2019-05-12T02:57:49"),
    ("Mon, 07 Jan 2019 06:50:21 -0800", "o", "utc", "2019-01-07T14:50:21"),
    ("14-Dec-18 16:32:43", "o", "utc", "2018-12-14T16:32:43"),
    ("29/11/2018 10:16:42", "dmy", "utc", "2018-11-29T10:16:42"),
    ("03.02.2019 10:16", "dmy", "utc", "2019-02-03T10:16:00"),
    ("3/2/2019 4:33:43", "mdy", "utc", "2019-03-02T04:33:43"),
    ("02/20/2019 12:00:00 AM", "mdy", "utc", "2019-02-20T00:00:00"),
    ("2018-12-27", "o", "berlin", "2018-12-26T23:00:00"),
    ("2019-10-27 02:30:00", "o", "berlin", "2019-10-27T00:30:00"),  # occurs twice: the earlier
    ("2019-03-31 02:30:00", "o", "berlin", "2019-03-31T01:30:00"),  # skipped: offset before the change
    ("2019-06-01 12:00:00", "o", "offset", "2019-06-01T19:00:00"),
    ("2019-06-01 12:00:00", "o", "invalid", "2019-06-01T12:00:00"),
    ("2019-06-01 12:00:00", "o", None, "2019-06-01T12:00:00"),
    ("2020-02-30 10:00:00", "o", "utc", None),
    ("13/32/2020 08:00:00", "mdy", "utc", None),
    ("0000-00-00 00:00:00", "o", "utc", None),
    ("25:61", "o", "utc", None),
    ("", "o", "utc", None),
    ("x" * 100_000, "o", "utc", None),
    (None, "o", "utc", None),
]


def test_normalize_times(spark):
    sources = spark.createDataFrame([("berlin", None), ("berlin", "Europe/Berlin"), ("offset", "-07:00"), ("invalid", "Narwhal/Bay"), ("invalid", "-80:00"), (None, "UTC")], "device_serial_number string, device_time_zone_name string")
    df = spark.createDataFrame([(i, *t[:3]) for i, t in enumerate(TIMES)], "i int, text string, origin string, device string")
    got = {r.i: r.instant_ns for r in timeparse.normalize_times(df, "text", "origin", "device", sources).collect()}
    for i, (*_, want) in enumerate(TIMES):
        if isinstance(want, str):
            want = us(datetime.fromisoformat(want).replace(tzinfo=timezone.utc)) * 1000
        assert got[i] == want, TIMES[i]
    assert len(got) == len(TIMES)


def test_wall_kinds(spark):
    from pyspark.sql import functions as F

    z = zones.zone_table(spark).where("zone = 'Europe/Berlin' and year = 2019")
    walls = {"2019-07-01 00:00:00": "exact", "2019-10-27 02:30:00": "ambiguous", "2019-03-31 02:30:00": "nonexistent"}
    rows = spark.createDataFrame([(w, us(datetime.fromisoformat(w).replace(tzinfo=timezone.utc)) // 10**6) for w in walls], "w string, s long")
    assert {r.w: r.k for r in rows.join(z, F.lit(True)).select("w", zones.wall_kind(F.col("s"), F.col("spans")).alias("k")).collect()} == walls
