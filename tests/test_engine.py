"""The engine's own operators: literal cases, errors and groups."""

import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sensorframe import schema as sc
from sensorframe.functions import timeutil as tu
from sensorframe.operators import dedup, filters, frames, keys, metadata
from sensorframe.operators import predicates as pr
from sensorframe.session import require_utc
from sensorframe.sources import catalog

UTC = timezone.utc
T0 = datetime(2024, 1, 1, 12, tzinfo=UTC)


def row_of(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def points(spark, rows, extra=""):
    """rows: (device, source, participant, namespace, written, labels, at, *payload)."""
    data = [((s, d, p, ns, None, (w,) if w else None, labels), at, *rest) for d, s, p, ns, w, labels, at, *rest in rows]
    kind = sc.METADATA.simpleString()
    return spark.createDataFrame(data, f"data_point_metadata {kind}, measurement_timestamp_utc timestamp{extra}")


# scalar functions ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("zone", "day"),
    [("US/Pacific", "2019-09-29"), ("-07:00", "2019-09-29"), ("-00:15", "2019-09-29")] + [(z, "2019-09-30") for z in ("Area/51", "+05:00", "30:00", "-80:00", "00:15", "00:80", "-00:80", "00:00", "", "+29:69", None)],
)
def test_date_in_zone(spark, zone, day):  # fixed values: what these texts must give
    at = F.lit(datetime(2019, 9, 30, 0, 10, 10, 125000, tzinfo=UTC))
    assert row_of(spark, x=tu.date_in_zone(at, F.lit(zone).cast("string"))).x == day


def test_times(spark):
    t = F.lit(datetime(2020, 1, 1, 12, 15, 30, 123456, tzinfo=UTC))
    r = row_of(spark, a=F.unix_micros(tu.floor_second(t)), b=F.unix_micros(tu.ceil_second(t)), c=tu.millis(tu.parse_store(F.lit("1641049200000"))), d=tu.millis(tu.parse_store(F.lit("2019-10-07 07:51:37.857 UTC"))), e=tu.parse_store(F.lit("nonsense")), f=tu.millis(tu.parse_warehouse(F.lit(1000))), g=F.unix_micros(tu.parse_warehouse(F.lit(9223372036854776))), h=tu.job_label(F.lit("foo.bar!Baz-_" + "a" * 100)), i=tu.readable_zone(F.lit(-28800)))
    assert (r.b - r.a, r.a % 10**6, r.c, r.d, r.e, r.f) == (10**6, 0, 1641049200000, 1570434697857, None, 1)
    assert r.g == 9223372036854775 and r.h == "foo_bar_baz-_" + "a" * 50 and r.i == "America/Los_Angeles"
    for bad in (tu.readable_zone(F.lit(17)), tu.required(F.lit(None).cast("long"), "time"), tu.filter_time(F.lit(5), "bigint")):
        with pytest.raises(Exception, match="zone|null|range"):
            row_of(spark, x=bad)
    with pytest.raises(ValueError):
        tu.filter_time(F.lit(1.0), "double")
    with pytest.raises(ValueError):
        tu.floor_unit(t, "WEEK")


def test_strict_times(spark):
    one = lambda c: row_of(spark, x=c).x
    assert one(tu.time_text_millis(F.lit("2019-10-07"))) == 1570406400000 and one(tu.time_text_millis(F.lit("2019-10-07 07:51:37.857 UTC"))) == 1570434697857
    assert one(tu.millis(tu.from_millis(F.lit(1672660800000)))) == 1672660800000 and one(tu.utc_only(F.lit("2020-01-01 00:00:00+00:00"))) == datetime(2020, 1, 1)
    for bad in (tu.time_text_millis(F.lit("")), tu.time_text_millis(F.lit("not a time")), tu.time_text_millis(F.lit(None).cast("string")), tu.utc_only(F.lit("2020-01-01 00:00:00+05:00"))):
        with pytest.raises(Exception, match="no time|not in UTC"):
            one(bad)


def test_mock_and_observed(spark, tmp_path):
    from pyspark.sql import Observation

    t = catalog.SensorTables(spark, str(tmp_path))
    t.append(points(spark, [("dev1", 1, None, None, None, [], T0)]).withColumn("data_spec_name", F.lit("s")), "datapoint")
    mock = catalog.BatchSource(mock=25).read(t)
    assert mock.schema.fieldNames() == t.schema("datapoint").fieldNames() and mock.select("data_point_metadata.device_id").distinct().count() == 10
    assert catalog.BatchSource(cache=True).read(t).count() == 1
    rows = spark.createDataFrame([("a", T0 + timedelta(hours=h), None, None, None, None) for h in range(5)], "device_id string, measurement_timestamp_utc timestamp, data_spec string, sensor_id string, algorithm_name string, algorithm_version string")
    spans = spark.createDataFrame([("a", int(T0.timestamp() * 10**6), int((T0 + timedelta(hours=2)).timestamp() * 10**6))], "device_id string, start_us long, end_us long")
    o = Observation("filter")
    assert len(filters.apply_filters(rows, [filters.data_filter(spans, "f", True)], ["f"], o).collect()) == 2 and o.get["rows_removed"] == 3


def test_utc_guard(spark):
    require_utc(spark)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError):
            require_utc(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# schemas and sources ------------------------------------------------------------------------------------------------


def test_catalogue():
    path = Path(__file__).parent.parent / "FIXTURES.md"
    c = sc.Catalogue.read(str(path))
    assert len(c) == 217 and len(c.by_class) == 217
    vendor = next(n for n in c.by_name if n.endswith(".imu")).removesuffix("imu")
    assert sum(sc.class_name(n, vendor) == s.class_name for n, s in c.by_name.items()) >= 215
    imu = c[vendor + "imu"]
    c.check(imu.name, imu.schema)
    fields = imu.schema.fields
    for wrong in (fields[1:], [f for f in fields if f.name != "sensor_id"], [f for f in fields if f.name != "measurement_timestamp_utc"], [*fields, sc.T.StructField("extra", sc.T.LongType())]):
        with pytest.raises(ValueError):
            c.check(imu.name, sc.T.StructType(wrong))


GOOD = ["a", "A.b-c_d", "x" * 64, "0", "com.x.imu", "-"]
BAD = ["", "x" * 65, "a b", "a;b", "a'b", 'a"b', "a`b", "a\n", "a/b", "é", None, 5]


@pytest.mark.parametrize("text", GOOD)
def test_identifiers(text):
    assert catalog.identifier(text) == text


@pytest.mark.parametrize("text", BAD)
def test_bad_identifiers(text):
    with pytest.raises(ValueError):
        catalog.identifier(text)


@pytest.mark.parametrize("n", [-1, 0, 1.5, True, "3"])
def test_bad_limits(n):
    with pytest.raises(ValueError):
        catalog.row_limit(n)


def test_tables(spark, tmp_path, capsys):
    t = catalog.SensorTables(spark, str(tmp_path))
    df = points(spark, [("dev1", 1, None, None, None, [], T0 + timedelta(hours=h)) for h in range(5)]).withColumn("data_spec_name", F.lit("s"))
    t.append(df, "datapoint")
    t.append(df, "datapoint")
    assert t.tables() == ["datapoint"] and "data_spec_name" in t.schema("datapoint").fieldNames()
    read = lambda **k: t.read_datapoints(**k).count()
    at = lambda h: F.lit(T0 + timedelta(hours=h))
    assert read() == 10 and read(remove_duplicates=True) == 5 and read(start=at(1), end=at(3)) == 6 and read(device_ids=[]) == 0 and read(data_types=["s"], limit=3) == 3
    for bad in ({"device_ids": ["a b"]}, {"table": "x;y"}, {"limit": 0}):
        with pytest.raises(ValueError):
            t.read_datapoints(**bad)
    t.read_datapoints(data_types=["s"], start=at(1)).select("data_spec_name").explain("formatted")
    plan = capsys.readouterr().out
    pushed, read = next(x for x in plan.splitlines() if "PushedFilters" in x), next(x for x in plan.splitlines() if "ReadSchema" in x)
    assert "GreaterThanOrEqual(measurement_timestamp_utc" in pushed and "data_point_metadata" not in read


def test_run_state(spark, tmp_path):
    s = catalog.RunState(spark, str(tmp_path), "baseline")
    assert s.next_range(T0) == (T0 - timedelta(days=3), T0)
    s.commit(T0)
    assert s.next_range(T0 + timedelta(hours=1)) == (T0, T0 + timedelta(hours=1))
    s.commit(T0 + timedelta(hours=2))
    assert s.next_range(T0 + timedelta(hours=3)) == (T0 + timedelta(hours=2), T0 + timedelta(hours=3))
    with pytest.raises(ValueError):
        catalog.StreamSource()


def test_redelivered_readings(spark):
    rows = [("d", 1, None, None, T0, [], T0, 1.0), ("d", 1, "p", 1, T0 + timedelta(1), ["x"], T0, 1.0), ("d", 1, None, None, T0, [], T0, 2.0), ("d", 2, None, None, T0, [], T0, 1.0), (None, 1, None, None, T0, [], T0, None), (None, 1, None, None, T0 + timedelta(1), None, T0, None)]
    df = points(spark, rows, ", rate double").withColumn("row_id", F.monotonically_increasing_id())
    assert catalog.remove_redelivered(df).count() == 4 and catalog.remove_redelivered(df).columns == df.columns


# predicates ---------------------------------------------------------------------------------------------------------


def test_condition_algebra(spark):
    df = points(spark, [("C2Q1", 1, "p", 1, T0, ["x"], T0), ("my-Test-1", 2, None, None, None, None, T0 + timedelta(hours=1)), (None, None, None, None, None, [], T0 + timedelta(hours=2))])
    count = lambda c: c.apply(df).count()
    a, b = pr.Devices(("C2Q1",)), pr.Label("x")
    assert (a & b) & a == pr.And((a, b)) and (a | b) | b == pr.Or((a, b))
    assert count(pr.Everything()) == 3 and count(pr.Nothing()) == 0 and count(pr.And()) == 3 and count(pr.Or()) == 0
    assert count(-a) == 2 and count(-b) == 2 and count(a | pr.DeviceType("TEST_DEVICE")) == 2
    assert count(pr.TimeRange(T0, T0 + timedelta(hours=2))) == 2 and count(pr.TimeRange()) == 3
    assert count(pr.UserNamespace(1)) == 1 and count(pr.UserNamespace(1, negate=True)) == 2
    assert count(pr.WriteTimeRange(T0, None)) == 1
    with pytest.raises(pr.NotApplicable):
        pr.Label("x").column("messages")
    with pytest.raises(pr.NotApplicable):
        pr.WriteTimeRange(T0).column("annotations")
    stream = spark.createDataFrame([("d", None, T0)], "device_id string, participant_id string, start_time timestamp")
    assert pr.TimeRange(T0, T0 + timedelta(1)).apply(stream, "messages").count() == 0
    assert pr.TimeRange(T0 - timedelta(1), T0).apply(stream, "messages").count() == 1


def test_algorithm(spark):
    df = points(spark, [("d", s, None, None, None, [], T0) for s in (1, 2, 3, 9)])
    src = spark.createDataFrame([(1, "trackerx", "1"), (2, "track", "2"), (2, None, None), (3, None, None)], "data_source_id long, algorithm_name string, algorithm_version string")
    named = pr.with_sources(df, src, ["algorithm_name", "algorithm_version"]).withColumn("sensor_id", F.lit(None).cast("string"))
    assert pr.Algorithm("trackerx").apply(named).count() == 3
    assert pr.Algorithm("trackerx", substring=True).apply(named).count() == 4
    assert pr.Algorithm(("track",), "2").apply(named).count() == 3
    with pytest.raises(Exception, match="unknown data source"):
        pr.with_sources(df, src, ["algorithm_name"], strict=True).collect()


# interval filters ---------------------------------------------------------------------------------------------------


def test_filters(spark):
    r = random.Random(2)
    at = lambda h: T0 + timedelta(hours=h)
    us = lambda t: None if t is None else int(t.timestamp() * 10**6)
    data = [(i, r.choice(["a", "b", None]), at(r.randrange(0, 48)), r.choice(["s", "t", None]), r.choice(["0", None]), None, None, 1) for i in range(300)]
    df = spark.createDataFrame(data, "i long, device_id string, measurement_timestamp_utc timestamp, data_spec string, sensor_id string, algorithm_name string, algorithm_version string, covering int")
    tables = {}
    for name, n in (("in1", 6), ("in2", 4), ("ex", 3)):
        tables[name] = [(r.choice(["a", "b", None]), us(r.choice([None, at(r.randrange(40))])), us(r.choice([None, at(r.randrange(60)), at(5000)])), r.choice(["s", None]), r.choice(["0", None, None])) for _ in range(n)]
    fs = [filters.data_filter(spark.createDataFrame(rows, "device_id string, start_us long, end_us long, data_spec string, sensor_id string"), n, n != "ex") for n, rows in tables.items()]
    fs = [f for f in fs]

    def hit(p, rows):
        t = us(p[2])
        return any(d == p[1] and d is not None and (a is None or a <= t) and (b is None or t < b) and (s is None or s == p[3]) and (x is None or x == p[4]) for d, a, b, s, x in rows)

    for use in (["in1"], ["ex"], ["in1", "in2", "ex"], ["in1", "in2"]):
        chosen = [f for n, f in zip(tables, fs) if n in use]
        got = sorted(x.i for x in filters.apply_filters(df.drop("covering"), chosen, [n for n in use if n != "ex"]).collect())
        want = [p[0] for p in data if all(hit(p, tables[n]) for n in use if n != "ex") and not any(hit(p, tables[n]) for n in use if n == "ex")]
        assert got == want
    assert filters.apply_filters(df, [], []).count() == 300


def test_join_annotations(spark):
    p = spark.createDataFrame([(1, "d", "p", 1, T0), (2, "d", None, None, T0 + timedelta(milliseconds=10500)), (3, "e", "p", 1, T0)], "i int, device_id string, participant_id string, participant_namespace long, measurement_timestamp_utc timestamp")
    u = int(T0.timestamp() * 10**6)
    a = spark.createDataFrame([("x", "d", "p", 1, u, u + 10_200_000), ("y", "d", "p", 1, u - 5, u + 1), ("y", "d", None, None, u, u + 20_000_000), ("z", "d", "p", 1, u - 9, u + 9)], "annotation_label string, device_id string, participant_id string, participant_namespace long, start_us long, end_us long")
    got = lambda **k: {r.i: r.joined_labels for r in filters.join_annotations(p, a, ["x", "y"], **k).collect()}
    assert got() == {1: ["x", "y"], 2: ["y"]}
    assert got(join_if="ALL") == {1: ["x", "y"]}
    assert got(on_participant=False, join_if="ALL", round_to_second=True) == {1: ["x", "y"], 2: ["x", "y"]}
    with pytest.raises(ValueError):
        got(join_if="SOME")


# keys, metadata, duplicates -----------------------------------------------------------------------------------------


def test_keys(spark):
    df = points(spark, [("d", 1, "p", 1, None, [], datetime(2019, 3, 10, h, 30, tzinfo=UTC)) for h in (7, 8, 9, 10)])
    with pytest.raises(ValueError):
        keys.key_by(df, False, False)
    with pytest.raises(ValueError):
        keys.key_field(df, "Nobody")
    k = keys.key_field(df, "ParticipantID").select(*frames.ENTITY).distinct().collect()
    assert [tuple(x) for x in k] == [(None, "p", 1)]
    local = keys.key_local(df, keys.Fixed("1 hour"), keys.measured(), F.lit("America/New_York"))
    # clocks are put forward at 07:00 UTC, so 02:00 local doesn't exist
    assert sorted(x.s // 3_600_000_000 % 24 for x in local.select(F.col("start_time_range_micros").alias("s")).collect()) == [3, 4, 5, 6]
    fall = points(spark, [("d", 1, "p", 1, None, [], datetime(2019, 11, 3, h, 30, tzinfo=UTC)) for h in (5, 6)])
    assert keys.key_local(fall, keys.Fixed("1 hour"), keys.measured(), F.lit("America/New_York")).select("start_time_range_micros").distinct().count() == 1
    assert keys.key_time(df, keys.Sliding("2 hours", "1 hour"), keys.measured()).count() == 8
    off = spark.createDataFrame([("d", 19800, None), ], "device_id string, utc_offset_seconds long, zone string")
    shifted = keys.with_offsets(keys.key_by(df), off).select(keys.local_time(keys.measured(), offset_seconds=F.col("utc_offset_seconds")).alias("t"))
    assert shifted.orderBy("t").first().t == datetime(2019, 3, 10, 13, 0)
    with pytest.raises(Exception, match="no UTC offset"):
        keys.with_offsets(keys.key_by(df), off.where("false")).collect()


def test_derived_metadata(spark):
    at = lambda h: datetime(2024, 1, 1, h, tzinfo=UTC)
    one = lambda rows: metadata.derived_metadata(points(spark, rows).withColumn("k", F.lit(1)), ["k"]).first().derived_metadata
    m = one([("d", 12345, "p", 1, at(2), ["b"], at(12)), ("d", 12345, None, None, at(5), ["a", "b"], at(13)), ("d", 54321, None, None, None, None, at(11))])
    assert (m.data_source_id, m.device_id, m.participant_id, m.participant_namespace, m.annotation_labels) == (54321, "d", "p", 1, ["a", "b"])
    assert m.sensor_store_metadata.sensor_store_write_time == datetime(2024, 1, 1, 5) and m.echo_metadata is None
    for rows in ([("d", 1, None, None, None, [], T0), ("other", 1, None, None, None, [], T0)], [("d", 1, "p", 1, None, [], T0), ("d", 1, "other", 1, None, [], T0)]):
        with pytest.raises(Exception, match="several"):
            one(rows)
    assert metadata.derived_metadata(points(spark, []).withColumn("k", F.lit(1)), ["k"]).count() == 0


def test_modal_offset_ties(spark):
    df = spark.createDataFrame([("a", 5), ("a", 3), ("a", None), ("b", 7), ("b", 7), ("b", 1), (None, 2)], "d string, o int")
    assert {tuple(r) for r in metadata.modal_offset(df, "d", "o").collect()} == {("a", 3), ("b", 7)}


def test_keep_latest_and_intervals(spark):
    df = spark.createDataFrame([(1, "k", T0, "old"), (2, "k", T0 + timedelta(1), "new"), (3, "k", None, "none"), (4, None, None, "x")], "id long, k string, w timestamp, v string")
    assert {(r.k, r.v) for r in dedup.keep_latest(df, ["k"], F.col("w"), "id").collect()} == {("k", "new"), (None, "x")}
    p = spark.createDataFrame([("d", T0 + timedelta(minutes=5), T0), ("d", T0 + timedelta(hours=2), T0)], "k string, at timestamp, w timestamp")
    span = lambda mode: tuple(dedup.written_intervals(p, ["k"], "at", F.col("w"), F.lit(T0), F.lit(T0 + timedelta(1)), mode).first())[1:]
    n = datetime(2024, 1, 1, 12)
    assert span("TRUNCATE_INTERVALS") == (n, n + timedelta(hours=2))
    assert span("EXPAND_INTERVALS") == (n - timedelta(minutes=55), n + timedelta(hours=3))
    assert span("EXPORT") == (n + timedelta(minutes=5), n + timedelta(hours=2))


# frames -------------------------------------------------------------------------------------------------------------


def test_frames(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, v int")
    g = frames.GroupedFrames(df, ["k"], "v")
    out = lambda f, s="k string, v int": sorted(tuple(r) for r in g.apply(f, s).collect())
    assert out(lambda f: f.assign(v=f.v.cumsum())) == [("a", 1), ("a", 3), ("b", 3)]
    assert out(lambda f: None) == [] and out(lambda f: {"k": f.k[0], "v": len(f)}) == [("a", 2), ("b", 1)]
    assert out(lambda f: [f.head(1), None, {"k": "z", "v": 0}]) == [("a", 1), ("b", 3), ("z", 0), ("z", 0)]
    assert g.filter(lambda f, n: len(f) >= n, n=2).count() == 2
    with pytest.raises(Exception, match="yields|yield"):
        g.flat_map(lambda f: f, "k string, v int").collect()
    with pytest.raises(Exception, match="my own error"):
        g.apply(lambda f: (_ for _ in ()).throw(ValueError("my own error")), "k string").collect()
    with pytest.raises(TypeError):
        frames.build_frames(("not", "a frame"))
    assert frames.map_batches(df, lambda f: f[f.v > 1], "k string, v int").count() == 2


def test_frames_have_metadata(spark):
    at = lambda h: datetime(2024, 1, 1, h, tzinfo=UTC)
    rows = [("d", 12345, "p", 1, at(2), ["b"], at(12)), ("d", 12345, None, None, at(5), ["a", "b"], at(13)), ("d", 54321, None, None, None, None, at(11)), ("e", None, None, None, None, [], at(3))]
    g = frames.build_frames(points(spark, rows), by_participant=False)

    def seen(f):
        m = f.attrs["data_point_metadata"]
        return {"d": f.attrs["device_id"], "s": m["data_source_id"], "p": m["participant_id"], "w": str((m["sensor_store_metadata"] or {}).get("sensor_store_write_time")), "l": m["annotation_labels"]}

    got = {r.d: r for r in g.apply(seen, "d string, s long, p string, w string, l array<string>").collect()}
    assert (got["d"].s, got["d"].p, got["d"].l) == (54321, "p", ["a", "b"]) and got["d"].w.startswith("2024-01-01 05:00:00") and (got["e"].s, got["e"].p, got["e"].l, got["e"].w) == (None, None, [], "None")
    mixed = points(spark, [("d", 1, "p", 1, None, [], T0), ("d", 1, "q", 1, None, [], T0)])
    with pytest.raises(Exception, match="several participants"):
        frames.build_frames(mixed, by_participant=False).apply(seen, "d string").collect()
    with pytest.raises(ValueError):
        frames.build_frames({"a": mixed}, combine="zip")


def test_combine(spark):
    a = spark.createDataFrame([("d", 1, 10), ("d", 2, 20), (None, 1, 5)], "k string, t int, v int")
    b = spark.createDataFrame([("d", 2, 200), ("d", 3, 300), (None, 1, 6)], "k string, t int, v int")
    c = spark.createDataFrame([("d", 3, "x")], "k string, t int, w string")
    rows = {tuple(r) for r in frames.merge_frames({"a": a, "b": b, "c": c}, ["k"], ["t"]).select("k", "t", "v_a", "v_b", "w").collect()}
    assert rows == {("d", 1, 10, None, None), ("d", 2, 20, 200, None), ("d", 3, None, 300, "x"), (None, 1, 5, 6, None)}
    assert frames.union_frames([a, c]).count() == 4
    seen = frames.cogroup_apply({"a": a, "c": c}, ["k"], lambda f: {"k": "all", "n": sum(0 if x is None else len(x) for x in f.values()), "none": sum(x is None for x in f.values())}, "k string, n long, none long")
    assert sorted((r.n, r.none) for r in seen.collect()) == [(1, 1), (3, 0)]


def test_participants(spark):
    df = points(spark, [("d", 1, None, None, None, [], T0), ("d", 1, "q", 2, None, [], T0), ("e", 1, None, None, None, [], T0)])
    users = spark.createDataFrame([("d", "p", 1)], "device_id string, participant_id string, participant_namespace long")
    got = sorted((r.p or "", r.ns or 0) for r in catalog.with_participants(df, users).select(F.col("data_point_metadata.participant_id").alias("p"), F.col("data_point_metadata.participant_namespace").alias("ns")).collect())
    assert got == [("", 0), ("p", 1), ("q", 2)]


