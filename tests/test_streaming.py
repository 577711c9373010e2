"""Streams give what batches give."""

from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F

from sensorframe.operators.intervals import IntervalMap
from sensorframe.operators.panes import PaneSpec
from sensorframe.streaming.groups import stream_groups, stream_intervals
from sensorframe.streaming.panes import PaneStore, stream_panes
from sensorframe.streaming.replay import replay, run_to_end

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def feed(spark, folder, schema, batches, build, mode="append"):
    """Runs a stream over one file a batch and returns the rows of all its outputs."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/b{i:03d}")
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in"))
    out = []
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/check").foreachBatch(lambda df, n: out.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def minutes(spark, tmp_path, batches, lateness="10 days"):
    """What holds after each batch of (key, start, end) in minutes, by the rows of stream_intervals."""
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [[(k, at(a), at(b)) for k, a, b in x] + [(None, at(1), at(2)), ("d", at(5), at(5))] for x in batches]
    out = feed(spark, tmp_path, "key string, start timestamp, end timestamp", rows, lambda s: stream_intervals(s, lateness=lateness))
    base = int(T0.timestamp()) * 10**6
    holds = []
    for r in range(1, max(x.revision for x in out) + 1):
        now = set(holds[-1]) if holds else set()
        for x in (x for x in out if x.revision == r):
            (now.add if x.live else now.discard)((x.kind, (x.start_us - base) // 60_000_000, (x.end_us - base) // 60_000_000))
        holds.append(now)
    return holds


def told(pairs):
    m = IntervalMap()
    for a, b in pairs:
        m.insert(a, b)
    return {("period", a, b) for a, b in m} | {("gap", a, b) for a, b in m.gaps()}


def test_stream_intervals(spark, tmp_path):
    pairs = [[(0, 10), (30, 40)], [(8, 20), (50, 60)], [(20, 31), (55, 58), (90, 91)]]
    got = minutes(spark, tmp_path, [[("d", *p) for p in x] for x in pairs])
    assert got == [told(sum(pairs[: n + 1], [])) for n in range(3)]


def test_stream_intervals_replaces_the_gap_behind(spark, tmp_path):
    got = minutes(spark, tmp_path, [[("d", 0, 10), ("d", 100, 110)], [("d", 5, 50)], [("d", 40, 105)]])
    assert got == [told([(0, 10), (100, 110)]), told([(0, 50), (100, 110)]), told([(0, 110)])]


def test_stream_intervals_late_rows(spark, tmp_path):
    # the watermark trails the latest start by an hour: after the second batch it stands at 440
    got = minutes(spark, tmp_path, [[("d", 0, 10), ("d", 20, 30)], [("d", 500, 510)], [("d", 501, 505)], [("d", 5, 25), ("d", 445, 450)]], "1 hour")
    assert got[-1] == told([(0, 10), (20, 30), (445, 450), (500, 510)])


def test_stream_groups(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    batches = [[("d", at(1), 1.0), ("e", at(2), 5.0)], [("d", at(50), 2.0)], [("d", at(130), 3.0)], [("z", at(300), 0.0)]]
    size = lambda f: pd.DataFrame({"k": [f.k.iloc[0]], "n": [len(f)], "total": [f.v.sum()]})
    out = feed(spark, tmp_path, "k string, t timestamp, v double", batches, lambda s: stream_groups(s, ["k"], "t", "1 hour", size, "k string, n long, total double", "1 minute"))
    assert sorted((r.k, r.n, r.total) for r in out) == [("d", 1, 3.0), ("d", 2, 3.0), ("e", 1, 5.0)]


def test_pane_store(spark, tmp_path):
    spec = PaneSpec(size=100, slide=50, publish=10, close=200)
    store = PaneStore(spark, str(tmp_path / "p"), ["k"], spec)
    df = lambda *rows: spark.createDataFrame(list(rows), "k string, t long, a long, v double")
    run = lambda n, d: {(r.k, r.window_start_us): (r.n_final, r.total_final) for r in store.add(d, n, "t", "a", F.col("v")).collect()}
    assert run(0, df(("x", 10, 20, 1.0), ("x", 60, 70, 2.0), ("y", 10, 10, 9.0))) == {("x", -50): (1, 1.0), ("x", 0): (2, 3.0), ("x", 50): (1, 2.0), ("y", -50): (1, 9.0), ("y", 0): (1, 9.0)}
    second = df(("x", 20, 90, 5.0), (None, 20, 90, 7.0), ("x", None, 90, 5.0))
    want = {("x", -50): (2, 6.0), ("x", 0): (3, 8.0), (None, -50): (1, 7.0), (None, 0): (1, 7.0)}
    assert run(1, second) == want
    assert run(1, second) == want  # run again, nothing counts twice
    late = run(2, df(("x", 30, 290, 1.0), ("x", 60, 290, 1.0)))  # the window at -50 closed at 250
    assert late == {("x", 0): (5, 10.0), ("x", 50): (2, 3.0)}
    assert run(3, df(("x", 10, 1000, 1.0))) == {}
    assert run(4, df(("x", None, None, 1.0)).where("false")) == {}


def test_stream_panes_writer(spark, tmp_path):
    schema, seen = "k string, t long, a long, v double", {}
    for i, rows in enumerate([[("x", 10, 20, 1.0)], [("x", 20, 30, 2.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    keep = lambda w, n: seen.update({(r.k, r.window_start_us): r.total_final for r in w.collect()})
    stream_panes(s, f"{tmp_path}/state", ["k"], PaneSpec(100, 100, 0, 500), "t", "a", F.col("v"), keep).trigger(availableNow=True).start().awaitTermination()
    assert seen == {("x", 0): 3.0}


def test_pane_store_results_do_not_depend_on_batches(spark, tmp_path):
    spec = PaneSpec(size=100, slide=50, publish=10, close=200)
    late = [("x", 0, 900), ("x", 640, 880), ("y", 5, 2000), ("x", 1990, 2001)]
    rows = sorted([("x", t, t + 7, 1.0) for t in range(0, 2000, 30)] + [(*r, 5.0) for r in late], key=lambda r: r[2])

    def run(name, size):
        store, out = PaneStore(spark, str(tmp_path / name), ["k"], spec, bucket=150, compact=2), {}
        for n in range(0, len(rows), size):
            df = spark.createDataFrame(rows[n : n + size], "k string, t long, a long, v double")
            out |= {(r.k, r.window_start_us): (r.n_final, r.total_final) for r in store.add(df, n // size, "t", "a", F.col("v")).collect()}
        return out, store.dropped((len(rows) - 1) // size)

    want = {}
    for k, t, a, v in rows:
        for w in range(t // 50 - 1, t // 50 + 1):
            if w * 50 + 300 > a:
                n, total = want.get((k, w * 50), (0, 0.0))
                want[k, w * 50] = (n + 1, total + v)
    assert run("one", len(rows)) == run("few", 24) == (want, 2)


def test_pane_store_adds_what_is_delivered_late(spark, tmp_path):
    store = PaneStore(spark, str(tmp_path / "p"), ["k"], PaneSpec(size=100, slide=100, publish=0, close=200))
    add = lambda n, *rows: [(r.window_start_us, r.n_final, r.total_final, r.closed) for r in store.add(spark.createDataFrame(list(rows), "k string, t long, a long, v double"), n, "t", "a", F.col("v")).collect()]
    assert add(0, ("x", 10, 20, 1.0)) == [(0, 1, 1.0, False)]
    assert add(1, ("y", 390, 400, 1.0)) == [(300, 1, 1.0, False)]
    assert add(2, ("x", 20, 299, 2.0)) == [(0, 2, 3.0, True)]  # arrived before the closing at 300
    assert add(3, ("x", 20, 300, 2.0)) == [] and store.dropped(3) == 1
    assert add(4, ("y", 890, 900, 1.0)) == [(800, 1, 1.0, False)]
    assert add(5, ("x", 20, 299, 2.0)) == [] and store.dropped(5) == 2  # the pane has left the store


def test_hourly_events_whatever_the_batches(spark, tmp_path):
    hour = 3_600_000_000
    rows = [("d", h * hour + 60_000_000, h * hour + 120_000_000, 1.0) for h in range(120)]
    for size in (120, 24):
        store, seen = PaneStore(spark, str(tmp_path / f"b{size}"), ["k"], PaneSpec()), {}
        for i in range(0, 120, size):
            df = spark.createDataFrame(rows[i : i + size], "k string, t long, a long, v double")
            seen |= {r.window_start_us: r.n_final for r in store.add(df, i // size, "t", "a", F.col("v")).collect()}
        assert seen == {h * hour: 1 for h in range(120)} and store.dropped(120 // size - 1) == 0


def test_replay_keeps_the_order(spark, tmp_path):
    df = spark.createDataFrame([(i, (i * 7919) % 1000) for i in range(1000)], "i long, t long")
    got = run_to_end(replay(df, F.col("t"), 4), "test").groupBy("batch").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).orderBy("batch").collect()
    assert sum(r.n for r in got) == 1000 and len(got) > 1 and all(x.b <= y.a for x, y in zip(got, got[1:]))
