"""Queries of the engine's own operators over the test tables, each with equivalent SQL."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeutil as tu
from ..operators import dedup, filters, frames, keys, metadata, unpack
from ..operators import predicates as pr
from ..schema import metadata as metadata_of
from ..sources.catalog import BatchSource, RunState, SensorTables, StreamSource, filter_rows, with_participants
from ..sources.tables import load, shared_folder

D1, D2 = datetime(2019, 6, 5, tzinfo=timezone.utc), datetime(2019, 6, 9, 12, tzinfo=timezone.utc)
DEVICES = ("pep2HSY2X000", "RLQYAV44B003", "PDVWC3G9C001")
USERS = ("prt9UCZWN6DB0", "prtETKVFDVCK3")
RATES = r"[.](heart|pulse)_rate"
HOUR = 3_600_000_000


def us(t: datetime) -> int:
    return int((t - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def at(t: datetime) -> Column:
    return F.timestamp_micros(F.lit(us(t)))


# SQL parts ---------------------------------------------------------------------------------------------------------

PTS = """pts as (select row_id, data_spec_name, data_point_metadata.device_id as device_id, data_point_metadata.participant_id as participant_id,
  coalesce(data_point_metadata.participant_namespace, -1) as participant_namespace, data_point_metadata.data_source_id as data_source_id, data_point_metadata.annotation_labels as labels,
  epoch_us(measurement_timestamp_utc) as t, epoch_us(data_point_metadata.sensor_store_metadata.sensor_store_write_time) as w, rate, coalesce(confidence, -1) as confidence from datapoint)"""
ANN = """ann as (select annotation_id, annotation_label, epoch_us(start_timestamp_utc) as s, epoch_us(end_timestamp_utc) as e, annotation_metadata.device_id as device_id,
  annotation_metadata.participant_id as participant_id, coalesce(annotation_metadata.participant_namespace, -1) as participant_namespace, annotation_metadata.version_name as version_name,
  annotation_metadata.version_number as version_number, annotation_metadata.input_data_info[1].metric_type.stream_item_type as data_spec from annotation)"""
SRC = """src as (select data_source_id, min(data_spec_name) as data_spec, min(sensor_id) as sensor_id, min(algorithm_name) as algorithm_name, min(algorithm_version) as algorithm_version
  from data_source where data_source_id is not null group by data_source_id)"""
ZONES = """valid as (select device_serial_number as device_id, trim(device_time_zone_name) as zone from data_source
    where device_serial_number is not null and (trim(device_time_zone_name) in (select name from pg_timezone_names()) or regexp_full_match(trim(device_time_zone_name), '[+-](0\\d|1[0-8]):[0-5]\\d'))),
  zones as (select device_id, min(zone) as zone from valid group by device_id)"""
#: The local wall clock in us of t at zone z, as if it were UTC.
LOCAL = """case when z.zone is null then t when z.zone[1] in ('+', '-') then t + (case when z.zone[1] = '-' then -1 else 1 end) * (cast(z.zone[2:3] as bigint) * 60 + cast(z.zone[5:6] as bigint)) * 60000000
  else epoch_us(timezone(z.zone, make_timestamptz(t))) end"""


def simple(where: str) -> str:
    return f"with {PTS} select row_id from pts where coalesce({where}, false)"


Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None):  # noqa: ANN202
    def note(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = f
        if sql is not None:
            S[f.__name__] = sql
        return f

    return note


def pts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "datapoint")


def ids(df: DataFrame) -> DataFrame:
    return df.select("row_id")


# Reads and predicates ----------------------------------------------------------------------------------------------


@query(simple(f"t >= {us(D1)} and t <= {us(D2)} and device_id in {DEVICES} and regexp_matches(data_spec_name, '{RATES}')"))
def read_filtered(spark: SparkSession, d: str) -> DataFrame:
    df = SensorTables(spark, d).read_datapoints(device_ids=DEVICES, start=at(D1), end=at(D2))
    return ids(pr.Where(F.col("data_spec_name").rlike(RATES)).apply(df))


@query(f"with {PTS} select row_id from pts where device_id in {DEVICES} order by t, row_id limit 50")
def read_limit_ordered(spark: SparkSession, d: str) -> DataFrame:
    return ids(SensorTables(spark, d).read_datapoints(device_ids=DEVICES).orderBy("measurement_timestamp_utc", "row_id").limit(50))


@query(simple(f"(device_id in {DEVICES} or participant_id in {USERS}) and not coalesce(list_contains(labels, 'charging'), false)"))
def cond_and_or_not(spark: SparkSession, d: str) -> DataFrame:
    return ids(((pr.Devices(DEVICES) | pr.Users(USERS)) & -pr.Label("charging")).apply(pts(spark, d)))


@query(simple(f"device_id in {DEVICES}"))
def cond_devices(spark: SparkSession, d: str) -> DataFrame:
    return ids(pr.Devices(DEVICES).apply(pts(spark, d)))


@query(f"with {PTS}, {SRC} select row_id from pts join src using (data_source_id) where sensor_id in ('0', '2')")
def cond_sensors(spark: SparkSession, d: str) -> DataFrame:
    return ids(pr.Sensors(("0", "2")).apply(pr.with_sources(pts(spark, d), load(spark, d, "data_source"))))


@query(simple(f"participant_id in {USERS}"))
def cond_users(spark: SparkSession, d: str) -> DataFrame:
    return ids(pr.Users(USERS).apply(pts(spark, d)))


@query(simple("list_contains(labels, 'on_wrist')"))
def cond_annotation_label(spark: SparkSession, d: str) -> DataFrame:
    return ids(pr.Label("on_wrist").apply(pts(spark, d)))


@query(simple(f"t >= {us(D1)} and t < {us(D2)}"))
def cond_time_range(spark: SparkSession, d: str) -> DataFrame:
    return ids(pr.TimeRange(D1, D2).apply(pts(spark, d)))


@query(f"with {ANN} select annotation_id from ann where e > {us(D1)} and s <= {us(D2)}")
def cond_annotation_overlap(spark: SparkSession, d: str) -> DataFrame:
    return pr.TimeRange(D1, D2).apply(load(spark, d, "annotation"), "annotations").select("annotation_id")


@query(simple(f"w >= {us(D1)} and w < {us(D2)}"))
def cond_write_time(spark: SparkSession, d: str) -> DataFrame:
    return ids(pr.WriteTimeRange(D1, D2).apply(pts(spark, d)))


@query(f"""with {PTS}, {SRC} select row_id from pts left join src using (data_source_id)
  where (algorithm_name is null or algorithm_name = 'pulse_tracker') and (algorithm_version is null or algorithm_version in ('2.1', '3.0'))""")
def cond_algorithm(spark: SparkSession, d: str) -> DataFrame:
    return ids(pr.Algorithm("pulse_tracker", ("2.1", "3.0")).apply(pr.with_sources(pts(spark, d), load(spark, d, "data_source"))))


@query(f"with {ANN} select annotation_id from ann where (version_name is null and version_number is null) or (version_name = 'nightpass' and version_number = 2)")
def cond_annotation_algo(spark: SparkSession, d: str) -> DataFrame:
    return pr.AnnotationAlgorithm("nightpass", 2).apply(load(spark, d, "annotation"), "annotations").select("annotation_id")


@query(simple("regexp_matches(device_id, '^(RLQ|QCI)')"))
def cond_device_type(spark: SparkSession, d: str) -> DataFrame:
    return ids(pr.DeviceType("RIALTO").apply(pts(spark, d)))


@query(simple("participant_namespace is distinct from 1"))
def cond_namespace(spark: SparkSession, d: str) -> DataFrame:
    return ids(pr.UserNamespace("GAIA_ID", negate=True).apply(pts(spark, d)))


@query(f"with {PTS} select case when device_id[1:3] = 'C2Q' then 0 else 1 end as branch, count(*) as n from pts group by 1")
def partition_device(spark: SparkSession, d: str) -> DataFrame:
    a, b = pr.split(pts(spark, d), F.col("data_point_metadata.device_id").startswith("C2Q"))
    both = a.select(F.lit(0).alias("branch")).unionByName(b.select(F.lit(1).alias("branch")))
    return both.groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


# Interval filters and annotation joins -----------------------------------------------------------------------------


def flat_points(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("data_point_metadata")
    df = pts(spark, d)
    src = pr.source_dimension(load(spark, d, "data_source")).select("data_source_id", "sensor_id", "algorithm_name", "algorithm_version")
    flat = df.select("row_id", "measurement_timestamp_utc", m["device_id"].alias("device_id"), m["participant_id"].alias("participant_id"), m["participant_namespace"].alias("participant_namespace"), m["data_source_id"].alias("data_source_id"), F.col("data_spec_name").alias("data_spec"))
    return flat.join(src, "data_source_id", "left")


def label_filter(spark: SparkSession, d: str, label: str, inclusive: bool, by_spec: bool = False) -> DataFrame:
    rows = filter_rows(load(spark, d, "annotation").where(F.col("annotation_label") == label))
    return filters.data_filter(rows if by_spec else rows.drop("data_spec"), label, inclusive)


def covers(label: str) -> str:
    return f"exists (select 1 from ann a where a.annotation_label = '{label}' and a.device_id = p.device_id and (a.s is null or a.s <= p.t) and (a.e is null or p.t < a.e))"


@query(f"with {PTS}, {ANN} select row_id from pts p where {covers('on_wrist')}")
def filter_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return ids(filters.apply_filters(flat_points(spark, d), [label_filter(spark, d, "on_wrist", True)], ["on_wrist"]))


@query(f"with {PTS}, {ANN} select row_id from pts p where not {covers('charging')} and not {covers('exercise')}")
def filter_exclusive(spark: SparkSession, d: str) -> DataFrame:
    return ids(filters.apply_filters(flat_points(spark, d), [label_filter(spark, d, x, False) for x in ("charging", "exercise")], []))


@query(f"""with {PTS}, {ANN} select row_id from pts p where {covers("on_wrist")} and not {covers("charging")} and not
  exists (select 1 from ann a where a.annotation_label = 'sleep' and a.device_id = p.device_id and (a.s is null or a.s <= p.t) and (a.e is null or p.t < a.e) and (a.data_spec is null or a.data_spec = p.data_spec_name))""")
def filter_merged(spark: SparkSession, d: str) -> DataFrame:
    fs = [label_filter(spark, d, "on_wrist", True), label_filter(spark, d, "charging", False), label_filter(spark, d, "sleep", False, by_spec=True)]
    return ids(filters.apply_filters(flat_points(spark, d), fs, ["on_wrist"]))


LABELS = ("sleep", "on_wrist")


def annotation_rows(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("annotation_metadata")
    return load(spark, d, "annotation").select("annotation_label", m["device_id"].alias("device_id"), m["participant_id"].alias("participant_id"), m["participant_namespace"].alias("participant_namespace"), F.unix_micros("start_timestamp_utc").alias("start_us"), F.unix_micros("end_timestamp_utc").alias("end_us"))


def joined(spark: SparkSession, d: str, **how: object) -> DataFrame:
    df = filters.join_annotations(flat_points(spark, d), annotation_rows(spark, d), LABELS, **how)
    return df.select("row_id", F.array_join("joined_labels", ",").alias("labels"))


def joined_sql(least: int, participant: bool, rounding: bool) -> str:
    s, e = ("a.s // 1000000 * 1000000", "(a.e + 999999) // 1000000 * 1000000") if rounding else ("a.s", "a.e")
    same = "and a.participant_id is not distinct from p.participant_id and a.participant_namespace is not distinct from p.participant_namespace" if participant else ""
    real = f"and (a.s is null or a.e is null or {e} > {s})"
    return f"""with {PTS}, {ANN}, hits as (select distinct p.row_id, a.annotation_label as label from pts p join ann a on a.device_id = p.device_id
      where a.annotation_label in {LABELS} and (a.s is null or {s} <= p.t) and (a.e is null or p.t < {e}) {real} {same})
      select row_id, string_agg(label, ',' order by label) as labels from hits group by row_id having count(*) >= {least}"""


@query(joined_sql(1, True, False))
def annotation_join_any(spark: SparkSession, d: str) -> DataFrame:
    return joined(spark, d, join_if="ANY")


@query(joined_sql(2, False, False))
def annotation_join_all(spark: SparkSession, d: str) -> DataFrame:
    return joined(spark, d, join_if="ALL", on_participant=False)


@query(joined_sql(1, True, True))
def annotation_join_rounded(spark: SparkSession, d: str) -> DataFrame:
    return joined(spark, d, round_to_second=True)


# Keys and windows --------------------------------------------------------------------------------------------------


def counted(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts and totals by key; a null namespace comes out as -1."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("rate"), 2).alias("total"))
    return g.withColumn("participant_namespace", F.coalesce("participant_namespace", F.lit(-1)))


COUNTS = "count(*) as n, round(sum(rate), 2) as total"
ENTITY = ["device_id", "participant_id", "participant_namespace"]
WINDOW = ["start_time_range_micros", "end_time_range_micros"]


def windowed(expr: str, size: int, extra: str = "", join: str = "", by: str = "device_id, participant_id, participant_namespace") -> str:
    return f"""with {PTS}{extra}, w as (select pts.*, {expr} as s from pts {join})
      select {by}, s as start_time_range_micros, s + {size} as end_time_range_micros, {COUNTS} from w group by {by}, s"""


def null_parts(device: str, participant: str, ns: str) -> str:
    return f"with {PTS} select {device} as device_id, {participant} as participant_id, {ns} as participant_namespace, {COUNTS} from pts group by 1, 2, 3"


@query(null_parts("device_id", "cast(null as varchar)", "cast(-1 as bigint)"))
def key_device(spark: SparkSession, d: str) -> DataFrame:
    return counted(keys.key_field(pts(spark, d)), ENTITY)


@query(null_parts("cast(null as varchar)", "participant_id", "participant_namespace"))
def key_participant(spark: SparkSession, d: str) -> DataFrame:
    return counted(keys.key_field(pts(spark, d), "ParticipantID"), ENTITY)


@query(null_parts("device_id", "participant_id", "participant_namespace"))
def key_both(spark: SparkSession, d: str) -> DataFrame:
    return counted(keys.key_field(pts(spark, d), "Both"), ENTITY)


@query(f"with {PTS}, {SRC} select device_id, participant_id, participant_namespace, sensor_id, {COUNTS} from pts join src using (data_source_id) group by all")
def key_sensor(spark: SparkSession, d: str) -> DataFrame:
    known = pts(spark, d).where("data_point_metadata.data_source_id is not null")
    return counted(keys.key_sensor(known, load(spark, d, "data_source")), [*ENTITY, "sensor_id"])


def by_window(df: DataFrame, window: keys.Fixed | keys.Sliding, *more: str) -> DataFrame:
    return counted(keys.key_time(df, window, keys.measured()), [*ENTITY, *more, *WINDOW])


@query(windowed(f"t // {HOUR} * {HOUR}", HOUR))
def window_fixed(spark: SparkSession, d: str) -> DataFrame:
    return by_window(keys.key_by(pts(spark, d), True, True), keys.Fixed("1 hour"))


@query(windowed(f"unnest([t // {HOUR // 3} * {HOUR // 3} - k * {HOUR // 3} for k in [0::bigint, 1::bigint, 2::bigint]])", HOUR))
def window_sliding(spark: SparkSession, d: str) -> DataFrame:
    return by_window(keys.key_by(pts(spark, d), True, True), keys.Sliding("1 hour", "20 minutes"))


@query(windowed("(t - 120000000) // 420000000 * 420000000 + 120000000", 420_000_000))
def window_offset(spark: SparkSession, d: str) -> DataFrame:
    return by_window(keys.key_by(pts(spark, d), True, True), keys.Fixed("7 minutes", "2 minutes"))


@query(f"""with {PTS}, gaps as (select device_id, t, case when t - lag(t) over (partition by device_id order by t) < {HOUR} then 0 else 1 end as fresh from pts),
  runs as (select *, sum(fresh) over (partition by device_id order by t rows unbounded preceding) as run from (select * from gaps) x)
  select device_id, min(t) as session_start_micros, max(t) + {HOUR} as session_end_micros, count(*) as n from runs group by device_id, run""")
def window_session(spark: SparkSession, d: str) -> DataFrame:
    return keys.session_windows(keys.key_by(pts(spark, d)), ["device_id"], keys.measured(), "1 hour")


def device_zone(spark: SparkSession, d: str) -> DataFrame:
    """device_id and zone: the least valid zone of each device."""
    z = load(spark, d, "data_source").select(F.col("device_serial_number").alias("device_id"), F.trim("device_time_zone_name").alias("zone"))
    return z.where(F.col("device_id").isNotNull() & (tu.zone_type(F.col("zone")) != "INVALID")).groupBy("device_id").agg(F.min("zone").alias("zone"))


@query(windowed(f"({LOCAL}) // {24 * HOUR} * {24 * HOUR}", 24 * HOUR, f", {ZONES}", "left join zones z on z.device_id = pts.device_id", "pts.device_id, participant_id, participant_namespace").replace("pts.device_id, participant_id, participant_namespace, s", "device_id, participant_id, participant_namespace, s").replace("select pts.device_id, participant_id", "select device_id, participant_id"))
def window_local_tz(spark: SparkSession, d: str) -> DataFrame:
    df = keys.key_by(pts(spark, d), True, True).join(device_zone(spark, d), "device_id", "left")
    return counted(keys.key_local(df, keys.Fixed("1 day"), keys.measured(), F.coalesce("zone", F.lit("UTC"))), [*ENTITY, *WINDOW])


@query(windowed(f"epoch_us(timezone('Australia/Adelaide', make_timestamptz(t))) // {HOUR} * {HOUR}", HOUR))
def window_fixed_tz(spark: SparkSession, d: str) -> DataFrame:
    return counted(keys.key_local(keys.key_by(pts(spark, d), True, True), keys.Fixed("1 hour"), keys.measured(), F.lit("Australia/Adelaide")), [*ENTITY, *WINDOW])


@query(windowed(f"t // {HOUR} * {HOUR}", HOUR, f", {SRC}", "join src using (data_source_id)", "device_id, participant_id, participant_namespace, sensor_id").replace("select pts.*,", "select pts.*, sensor_id,"))
def window_sensor(spark: SparkSession, d: str) -> DataFrame:
    known = pts(spark, d).where("data_point_metadata.data_source_id is not null")
    return by_window(keys.key_sensor(known, load(spark, d, "data_source")), keys.Fixed("1 hour"), "sensor_id")


@query(windowed(f"t // {HOUR} * {HOUR}", HOUR, by="cast(null as varchar) as device_id, participant_id, participant_namespace").replace("group by cast(null as varchar) as device_id, participant_id", "group by participant_id"))
def window_participant(spark: SparkSession, d: str) -> DataFrame:
    return by_window(keys.key_by(pts(spark, d), False, True), keys.Fixed("1 hour"))


def annotation_windows(spark: SparkSession, d: str, which: str) -> DataFrame:
    df = keys.key_by(load(spark, d, "annotation"), annotations=True)
    return keys.key_time(df, keys.Fixed("6 hours"), keys.annotation_time(which)).groupBy("device_id", *WINDOW).agg(F.count(F.lit(1)).alias("n"))


def annotation_windows_sql(c: str) -> str:
    return f"with {ANN} select device_id, {c} // {6 * HOUR} * {6 * HOUR} as start_time_range_micros, ({c} // {6 * HOUR} + 1) * {6 * HOUR} as end_time_range_micros, count(*) as n from ann where {c} is not null group by 1, 2, 3"


@query(annotation_windows_sql("s"))
def annotation_window_start(spark: SparkSession, d: str) -> DataFrame:
    return annotation_windows(spark, d, "start")


@query(annotation_windows_sql("e"))
def annotation_window_end(spark: SparkSession, d: str) -> DataFrame:
    return annotation_windows(spark, d, "end")


@query(f"with {PTS} select device_id, participant_id, participant_namespace, strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%S.%f') as ts, {COUNTS} from pts group by all")
def group_timestamp(spark: SparkSession, d: str) -> DataFrame:
    g = frames.build_frames(pts(spark, d), per_timestamp=True)
    return counted(g.df, g.keys)


# Aggregates --------------------------------------------------------------------------------------------------------


@query(f"""with {PTS}, w as (select *, t // {HOUR} * {HOUR} as start_us from pts)
  select device_id, start_us, arg_min(coalesce(data_source_id, -1), (t, coalesce(data_source_id, -1))) as data_source_id, max(participant_id) as participant_id, coalesce(max(w), -1) as written_us,
    coalesce(array_to_string(list_sort(list_distinct(flatten(list(labels)))), ','), '') as labels from w group by device_id, start_us""")
def derived_metadata(spark: SparkSession, d: str) -> DataFrame:
    df = keys.key_time(keys.key_by(pts(spark, d)), keys.Fixed("1 hour"), keys.measured()).withColumnRenamed("start_time_range_micros", "start_us")
    m = F.col("derived_metadata")
    out = metadata.derived_metadata(df, ["device_id", "start_us"])
    return out.select("device_id", "start_us", F.coalesce(m["data_source_id"], F.lit(-1)).alias("data_source_id"), m["participant_id"].alias("participant_id"), F.coalesce(F.unix_micros(m["sensor_store_metadata"]["sensor_store_write_time"]), F.lit(-1)).alias("written_us"), F.array_join(m["annotation_labels"], ",").alias("labels"))


@query("""with o as (select device_serial_number as device_id, cast(case when device_time_zone_name[1] = '-' then -1 else 1 end * (cast(device_time_zone_name[2:3] as int) * 3600 + cast(device_time_zone_name[5:6] as int) * 60) as int) as utc_offset_seconds
    from data_source where regexp_full_match(device_time_zone_name, '[+-](0\\d|1[0-8]):[0-5]\\d')),
  n as (select device_id, utc_offset_seconds, count(*) as n from o group by all),
  r as (select *, row_number() over (partition by device_id order by n desc, utc_offset_seconds) as k from n) select device_id, utc_offset_seconds from r where k = 1""")
def modal_utc_offset(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.zones import fixed_offset

    ds = load(spark, d, "data_source").select(F.col("device_serial_number").alias("device_id"), fixed_offset(F.col("device_time_zone_name")).cast("int").alias("utc_offset_seconds"))
    return metadata.modal_offset(ds, "device_id", "utc_offset_seconds")


def _offset_seconds(text: str) -> int:
    return (1 if text[0] == "+" else -1) * (int(text[1:3]) * 3600 + int(text[4:]) * 60)


ALL_OFFSETS = [(_offset_seconds(o), z) for o, z in tu.ZONE_OF_OFFSET.items()]


@query(f"with t(k, utc_offset_seconds, zone) as (values {', '.join(f'({i}, {o}, {chr(39)}{z}{chr(39)})' for i, (o, z) in enumerate(ALL_OFFSETS))}) select p_partkey, utc_offset_seconds, zone from part join t on p_partkey % {len(ALL_OFFSETS)} = k")
def readable_tz(spark: SparkSession, d: str) -> DataFrame:
    offset = F.element_at(F.array(*[F.lit(o) for o, _ in ALL_OFFSETS]), (F.col("p_partkey") % len(ALL_OFFSETS) + 1).cast("int"))
    return load(spark, d, "part").select("p_partkey", offset.alias("utc_offset_seconds")).withColumn("zone", tu.readable_zone(F.col("utc_offset_seconds")))


DUP = ["device_id", "data_spec", "measured_us"]


def flat_readings(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("data_point_metadata")
    return pts(spark, d).select("row_id", m["device_id"].alias("device_id"), F.col("data_spec_name").alias("data_spec"), F.unix_micros("measurement_timestamp_utc").alias("measured_us"), m["sensor_store_metadata"]["sensor_store_write_time"].alias("written"), "rate", F.coalesce("confidence", F.lit(-1)).alias("confidence"))


@query(f"with {PTS} select distinct device_id, data_spec_name as data_spec, t as measured_us, rate, confidence from pts")
def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    return dedup.remove_duplicates(flat_readings(spark, d).drop("row_id", "written"), [*DUP, "rate", "confidence"])


@query(f"""with {PTS}, r as (select *, row_number() over (partition by device_id, data_spec_name, t order by coalesce(w, -4611686018427387904) desc, row_id desc) as k from pts)
  select row_id, device_id, data_spec_name as data_spec, t as measured_us, rate, confidence from r where k = 1""")
def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    return dedup.keep_latest(flat_readings(spark, d), DUP, F.col("written"), "row_id").drop("written")


def incremental(spark: SparkSession, d: str, mode: str) -> DataFrame:
    df = flat_readings(spark, d).withColumn("at", F.timestamp_micros("measured_us"))
    return ids(dedup.incremental_points(df, ["device_id"], "at", F.col("written"), at(D1), at(D1 + timedelta(hours=6)), mode))


def incremental_sql(lo: str, hi: str) -> str:
    a, b = us(D1), us(D1 + timedelta(hours=6))
    return f"""with {PTS}, g as (select device_id, min(t) as a, max(t) as b from pts where w >= {a} and w < {b} group by device_id)
      select row_id from pts join g using (device_id) where t >= {lo} and t <= {hi}"""


@query(incremental_sql(f"a // {HOUR} * {HOUR}", f"(b + {HOUR - 1}) // {HOUR} * {HOUR}"))
def incremental_truncate(spark: SparkSession, d: str) -> DataFrame:
    return incremental(spark, d, "TRUNCATE_INTERVALS")


@query(incremental_sql(f"a - {HOUR}", f"b + {HOUR}"))
def incremental_expand(spark: SparkSession, d: str) -> DataFrame:
    return incremental(spark, d, "EXPAND_INTERVALS")


@query(simple(f"w >= {us(D1)} and w < {us(D1 + timedelta(hours=6))}"))
def incremental_export(spark: SparkSession, d: str) -> DataFrame:
    return incremental(spark, d, "EXPORT")


# Frames and user functions -----------------------------------------------------------------------------------------

SENSORS = {"imu": ("unpacked_imu", "acceleration_x"), "ppg": ("unpacked_ppg", "green"), "eda": ("unpacked_eda", "raw_adc")}


def sensor_frames(spark: SparkSession, d: str, *tags: str) -> dict[str, DataFrame]:
    out = {}
    for tag in tags:
        table, c = SENSORS[tag]
        out[tag] = load(spark, d, table).select(F.col("data_point_metadata.device_id").alias("device_id"), F.unix_micros("measurement_timestamp_utc").alias("at_us"), F.col(c).alias("value"))
    return out


def tag_sql(tag: str) -> str:
    table, c = SENSORS[tag]
    return f"select '{tag}' as tag, data_point_metadata.device_id as device_id, epoch_us(measurement_timestamp_utc) as at_us, {c} as value from {table}"


ALL_TAGS = " union all ".join(map(tag_sql, SENSORS))


@query(f"with u as ({ALL_TAGS}) select device_id, at_us // {HOUR} as hour, count(*) as n, cast(sum(coalesce(value, 0)) as bigint) as total from u group by 1, 2")
def cogroup_concat(spark: SparkSession, d: str) -> DataFrame:
    u = frames.union_frames(list(sensor_frames(spark, d, *SENSORS).values()))
    return u.groupBy("device_id", F.floor(F.col("at_us") / HOUR).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).cast("long").alias("total"))


@query(f"""with a as ({tag_sql("imu")}), b as ({tag_sql("ppg")}), a1 as (select device_id, at_us // 1000000 as s, max(value) as value from a group by all), b1 as (select device_id, at_us // 1000000 as s, max(value) as value from b group by all)
  select coalesce(a1.device_id, b1.device_id) as device_id, coalesce(a1.s, b1.s) as s, a1.value as value_imu, b1.value as value_ppg from a1 full outer join b1 on a1.device_id is not distinct from b1.device_id and a1.s = b1.s""")
def cogroup_merge(spark: SparkSession, d: str) -> DataFrame:
    parts = {t: df.groupBy("device_id", F.floor(F.col("at_us") / 1_000_000).alias("s")).agg(F.max("value").alias("value")) for t, df in sensor_frames(spark, d, "imu", "ppg").items()}
    return frames.merge_frames(parts, ["device_id"], ["s"])


@query(f"with u as ({ALL_TAGS}) select device_id, at_us // {HOUR} as hour, count(*) filter (where tag = 'imu') as n_imu, count(*) filter (where tag = 'ppg') as n_ppg, count(*) filter (where tag = 'eda') as n_eda from u group by 1, 2")
def cogroup_tagged(spark: SparkSession, d: str) -> DataFrame:
    parts = {t: df.withColumn("hour", F.floor(F.col("at_us") / HOUR)) for t, df in sensor_frames(spark, d, *SENSORS).items()}
    return frames.cogroup_counts(parts, ["device_id", "hour"])


def hourly(spark: SparkSession, d: str, tag: str) -> frames.GroupedFrames:
    df = sensor_frames(spark, d, tag)[tag].where("device_id is not null and value is not null").groupBy("device_id", "at_us").agg(F.max("value").alias("value"))
    return frames.GroupedFrames(df.withColumn("hour", F.floor(F.col("at_us") / HOUR)), ["device_id", "hour"], "at_us")


HOURLY = f"h as (select device_id, at_us, at_us // {HOUR} as hour, max(value) as value from ({{}}) x where device_id is not null and value is not null group by all)"


def rolling(f: pd.DataFrame, width: int) -> pd.DataFrame:
    r = f["value"].rolling(width)
    return pd.DataFrame({"device_id": f["device_id"], "at_us": f["at_us"], "mean": r.mean().round(3)})


@query(f"""with {HOURLY.format(tag_sql("imu"))}, w as (select *, count(*) over v as k, avg(value) over v as m from h window v as (partition by device_id, hour order by at_us rows 19 preceding))
  select device_id, at_us, case when k = 20 then round(m, 3) end as mean from w""")
def udf_rolling_features(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d, "imu").apply(rolling, "device_id string, at_us long, mean double", width=20)


def peak_rate(f: pd.DataFrame, least: int) -> dict | None:
    """Local maxima above the mean, as beats a minute, if they are plausible."""
    if len(f) < least:
        return None
    v, m = f["value"].to_numpy(), f["value"].mean()
    peaks = int(((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]) & (v[1:-1] > m)).sum())
    return {"device_id": f["device_id"].iloc[0], "hour": f["hour"].iloc[0], "samples": len(f), "peaks": peaks}


@query(f"""with {HOURLY.format(tag_sql("ppg"))}, w as (select *, lag(value) over v as a, lead(value) over v as b, avg(value) over (partition by device_id, hour) as m from h window v as (partition by device_id, hour order by at_us))
  select device_id, hour, count(*) as samples, count(*) filter (where value > a and value > b and value > m) as peaks from w group by device_id, hour having count(*) >= 60""")
def udf_heart_rate(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d, "ppg").apply(peak_rate, "device_id string, hour long, samples long, peaks long", least=60)


@query(f"with {HOURLY.format(tag_sql('eda'))}, g as (select device_id, hour from h group by all having max(value) - min(value) > 1000) select device_id, at_us, hour, value from h join g using (device_id, hour)")
def udf_filter_groups(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d, "eda").filter(lambda f: f["value"].max() - f["value"].min() > 1000)


def runs_of_ten(f: pd.DataFrame):  # noqa: ANN201
    for i in range(0, len(f), 10):
        part = f.iloc[i : i + 10]
        yield {"device_id": part["device_id"].iloc[0], "first_us": part["at_us"].iloc[0], "n": len(part)}


@query(f"with {HOURLY.format(tag_sql('ppg'))}, w as (select *, (row_number() over (partition by device_id, hour order by at_us) - 1) // 10 as k from h) select device_id, min(at_us) as first_us, count(*) as n from w group by device_id, hour, k")
def udf_flatmap(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d, "ppg").flat_map(runs_of_ten, "device_id string, first_us long, n long")


class Spread:
    def __init__(self, scale: float):
        self.scale = scale

    def process(self, f: pd.DataFrame) -> dict:
        return {"device_id": f["device_id"].iloc[0], "hour": f["hour"].iloc[0], "spread": float(round((f["value"].max() - f["value"].min()) * self.scale, 3))}


@query(f"with {HOURLY.format(tag_sql('eda'))} select device_id, hour, round((max(value) - min(value)) * 0.5, 3) as spread from h group by device_id, hour")
def udf_algorithm(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d, "eda").apply_algorithm(Spread, "device_id string, hour long, spread double", init_args={"scale": 0.5})


# Unpacking ---------------------------------------------------------------------------------------------------------

START_MS = us(datetime(2024, 1, 1, tzinfo=timezone.utc)) // 1000
SHIFT_MS = START_MS + 0.0123  # keeps times that are exact halves off the borders of rounding


def packets(spark: SparkSession, d: str, true: bool = True, gaps: bool = True) -> DataFrame:
    """Packets of 64 samples at 64 Hz, one a second for each label; every 37th was lost if `gaps`."""
    from pyspark.sql import Window

    e = load(spark, d, "embeddings").withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    start = F.lit(float(START_MS)) + F.col("rank") * 1000.0
    t, i = start + 500.0 + (F.col("vec_id") % 7) / 10.0, F.lit(32).cast("long")
    df = e.select(F.col("label").alias("device"), start.alias("start_ms"), F.lit(64.0).alias("sampling_rate"), "vec_id", (t if true else F.lit(None).cast("double")).alias("true_ms"), (i if true else F.lit(None).cast("long")).alias("true_index"), F.col("embedding").cast("array<double>").alias("value"))
    return df.where("vec_id % 37 != 0") if gaps else df


def packets_sql(gaps: bool = True) -> str:
    return f"""ranked as (select *, row_number() over (partition by label order by vec_id) - 1 as rank from embeddings),
      p as (select label as device, {START_MS} + rank * 1000.0::double as start_ms, {START_MS} + rank * 1000.0::double + 500.0::double + (vec_id % 7) / 10.0::double as t, vec_id, embedding as value,
        row_number() over (partition by label order by rank) - 1 as k from ranked {"where vec_id % 37 != 0" if gaps else ""})"""


def summary(df: DataFrame) -> DataFrame:
    return df.groupBy("device").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_real"), F.round(F.min("timestamp_ms") - SHIFT_MS, 1).alias("first"), F.round(F.max("timestamp_ms") - SHIFT_MS, 1).alias("last"),
        F.round(F.avg(F.col("timestamp_ms") - SHIFT_MS), 1).alias("middle"), F.round(F.sum(F.col("value") * (F.col("timestamp_ms") - START_MS)) / 1000 + 0.0123, 1).alias("weighted"),
    )


SUMMARY = f"""select device, count(*) as n, count(value) as n_real, round(min(ts) - {SHIFT_MS}, 1) as first, round(max(ts) - {SHIFT_MS}, 1) as last, round(avg(ts - {SHIFT_MS}), 1) as middle,
  round(sum(value * (ts - {START_MS})) / 1000 + 0.0123, 1) as weighted from o group by device"""


def unpack_sql(true: str, index: int, gaps: bool, fill: str) -> str:
    """fill: 'rows' for null samples in gaps, 'skip' to count their places only."""
    rows = """select device, pt + j * 1000 / med as raw, pt as block, j as place, 1 as places, true as real, null as value from (select *, unnest(range(cast(ceil((t - pt) * med / 1000) as bigint))) as j from lost) x"""
    if fill == "skip":
        rows = "select device, null as raw, pt as block, 0 as place, floor((t - pt) * med / 1000) as places, false as real, null as value from lost"
    return f"""with {packets_sql(gaps)},
      a as (select device, k, start_ms, 64 * k + {index} as g, {true} as t, value from p),
      r as (select *, 1000.0 * (g - coalesce(lag(g) over w, 0)) / (t - coalesce(lag(t) over w, 0)) as fs, lag(g) over w as pg, lag(t) over w as pt from a window w as (partition by device order by k)),
      m as (select *, quantile_cont(fs, 0.5) over (partition by device) as med from r),
      v as (select *, abs(fs - med) / med <= 0.05 as ok from m),
      e as (select *, avg(case when ok then fs end) over (partition by device) as mean, lead(g) over w as ng, lead(t) over w as nt, lead(fs) over w as nfs, lead(ok) over w as nok from v window w as (partition by device order by k)),
      s as (select *, unnest(range(64)) as pos, unnest(value) as x from e where mean is not null),
      q as (select device, 64 * k + pos as si, mean, cast(x as double) as value, case when pos >= {index} then g else pg end as fg, case when pos >= {index} then t else pt end as ft,
        case when pos >= {index} then ng else g end as tg, case when pos >= {index} then nt else t end as tt, case when pos >= {index} then nfs else fs end as tfs, case when pos >= {index} then nok else ok end as tok from s),
      samples as (select device, case when ft is null then tt - (tg - si) * 1000 / mean when tt is null then ft + (si - fg) * 1000 / mean else ft + (si - fg) * 1000 / tfs end as raw,
        coalesce(ft, -1e300) as block, si as place, 1 as places, true as real, value from q where ft is null or tt is null or tok),
      lost as (select * from e where pt is not null and not ok and mean is not null),
      filled as ({rows}),
      u as (select * from samples union all select * from filled),
      i as (select *, sum(places) over (partition by device order by block, place rows unbounded preceding) - places as i from u),
      b as (select *, raw - min(raw) over (partition by device) as y, min(raw) over (partition by device) as base from i where real),
      f as (select device, regr_slope(y, i) as slope, regr_intercept(y, i) as cut from b group by device),
      o as (select device, base + cut + slope * i as ts, value from b join f using (device))
      {SUMMARY}"""


@query(f"""with {packets_sql()}, l as (select *, lead(start_ms) over (partition by device order by start_ms) as next_ms from p),
  s as (select device, start_ms + pos * 1000.0 / 64 as ts, next_ms, value from (select device, start_ms, next_ms, unnest(range(64)) as pos, cast(unnest(value) as double) as value from l) x),
  o as (select * from s where next_ms is null or ts < next_ms) {SUMMARY}""")
def unpack_legacy(spark: SparkSession, d: str) -> DataFrame:
    return summary(unpack.unpack_legacy(packets(spark, d), ["device"], ["value"]))


@query(unpack_sql("t", 32, False, "rows"))
def unpack_native(spark: SparkSession, d: str) -> DataFrame:
    return summary(unpack.unpack(packets(spark, d, gaps=False), ["device"], ["value"]))


@query(unpack_sql("t", 32, True, "rows"))
def unpack_gaps(spark: SparkSession, d: str) -> DataFrame:
    return summary(unpack.unpack(packets(spark, d), ["device"], ["value"]))


@query(unpack_sql("t", 32, True, "skip"))
def unpack_drop_nan(spark: SparkSession, d: str) -> DataFrame:
    return summary(unpack.unpack(packets(spark, d), ["device"], ["value"], drop_gaps=True))


@query(unpack_sql("start_ms + 63 * 1000.0 / 64", 63, True, "rows"))
def unpack_default_truets(spark: SparkSession, d: str) -> DataFrame:
    return summary(unpack.unpack(packets(spark, d, true=False), ["device"], ["value"]))


@query(unpack_sql("t", 32, True, "rows").replace("cast(x as double) as value", "cast(x as double) * 2 as value"))
def unpack_two_channel(spark: SparkSession, d: str) -> DataFrame:
    p = packets(spark, d).withColumn("second", F.transform("value", lambda x: x * 2))
    out = unpack.unpack(p, ["device"], ["value", "second"])
    return summary(out.select("device", "timestamp_ms", F.col("second").alias("value")))


# Scalar functions and streams --------------------------------------------------------------------------------------


@query(f"""with {PTS}, {ZONES} select row_id, case when z.zone is null then strftime(make_timestamp(t), '%Y-%m-%d') else strftime(make_timestamp({LOCAL}), '%Y-%m-%d') end as day from pts left join zones z on z.device_id = pts.device_id""")
def date_in_timezone(spark: SparkSession, d: str) -> DataFrame:
    df = keys.key_by(pts(spark, d)).join(device_zone(spark, d), "device_id", "left")
    return df.select("row_id", tu.date_in_zone(keys.measured(), F.coalesce("zone", F.lit("none"))).alias("day"))


@query("select row_id, cast(start_time as bigint) as start_ms from filter_range where regexp_full_match(start_time, '\\d{13}')")
def parse_timestamps(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "filter_range").where(F.col("start_time").rlike(r"^\d{13}\z"))
    return r.select("row_id", tu.millis(tu.parse_store(F.col("start_time"))).alias("start_ms"))


@query(f"with {PTS} select row_id, t // 1000000 * 1000000 as floor_us, (t + 999999) // 1000000 * 1000000 as ceil_us from pts")
def floor_ceil_second(spark: SparkSession, d: str) -> DataFrame:
    t = keys.measured()
    return pts(spark, d).select("row_id", F.unix_micros(tu.floor_second(t)).alias("floor_us"), F.unix_micros(tu.ceil_second(t)).alias("ceil_us"))


@query("select s_suppkey, regexp_replace(lower('Job ' || s_name || '.run!' || repeat('x', 60)), '[^a-z0-9_-]', '_', 'g')[1:63] as label from supplier")
def job_label_escape(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Job "), F.col("s_name"), F.lit(".run!"), F.repeat(F.lit("x"), 60))
    return load(spark, d, "supplier").select("s_suppkey", tu.job_label(text).alias("label"))


@query("select 'imu' as signal, row_id from unpacked_imu union all select 'ppg', row_id from unpacked_ppg union all select 'eda', row_id from unpacked_eda")
def union_flatten(spark: SparkSession, d: str) -> DataFrame:
    return frames.union_frames([load(spark, d, t).select(F.lit(tag).alias("signal"), "row_id") for tag, (t, _) in SENSORS.items()])


@query(f"""with {PTS}, known as (select data_point_metadata.device_id as device_id, min(data_point_metadata.participant_id) as p from datapoint where data_point_metadata.participant_id is not null group by 1)
  select row_id, coalesce(participant_id, known.p) as participant_id from pts left join known using (device_id)""")
def participant_enrichment(spark: SparkSession, d: str) -> DataFrame:
    df = pts(spark, d)
    m = F.col("data_point_metadata")
    users = df.where(m["participant_id"].isNotNull()).groupBy(m["device_id"].alias("device_id")).agg(F.min(m["participant_id"]).alias("participant_id"), F.min(m["participant_namespace"]).alias("participant_namespace"))
    return with_participants(df, users).select("row_id", F.col("data_point_metadata.participant_id").alias("participant_id"))


@query(f"with {PTS} select device_id, t // {HOUR} * {HOUR} as start_us, count(*) as n from pts group by 1, 2")
def stream_window_count(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.replay import replay, run_to_end
    from ..streaming.windows import hourly_counts, last_rows

    stream = replay(pts(spark, d), F.coalesce(F.col("data_point_metadata.sensor_store_metadata.sensor_store_write_time"), F.col("measurement_timestamp_utc")), 4)
    return last_rows(run_to_end(hourly_counts(stream), "hours", "update"), ["device_id", "start_us"])


# More of each part ------------------------------------------------------------------------------------------------


@query("select 'all' as which, count(*) as n from datapoint union all select 'none', 0")
def cond_constants(spark: SparkSession, d: str) -> DataFrame:
    parts = [c.apply(pts(spark, d)).agg(F.lit(name).alias("which"), F.count(F.lit(1)).alias("n")) for name, c in (("all", pr.Everything()), ("none", pr.Nothing()))]
    return frames.union_frames(parts)


@query(simple(f"t > {us(D1)} and t <= {us(D2)} and device_id in {DEVICES}"))
def cond_messages(spark: SparkSession, d: str) -> DataFrame:
    m = pts(spark, d).select("row_id", "data_point_metadata.device_id", "data_point_metadata.participant_id", F.col("measurement_timestamp_utc").alias("start_time"))
    return ids((pr.TimeRange(D1, D2) & pr.Devices(DEVICES)).apply(m, "messages"))


@query(f"with {ANN} select annotation_id from ann where s >= {us(D1)} and e <= {us(D2)}")
def cond_annotation_contained(spark: SparkSession, d: str) -> DataFrame:
    return pr.TimeRange(D1, D2, contained=True).apply(load(spark, d, "annotation"), "annotations").select("annotation_id")


VENDOR = "[a-z]+"


@query(f"with {PTS}, types as (select * from (values " + ", ".join(f"('{k}', '^(?:{v.replace('{vendor}', VENDOR)})')" for k, v in pr.DEVICE_TYPES.items()) + ") as t(kind, pattern)) select kind, row_id from pts join types on regexp_matches(device_id, pattern)")
def cond_device_types(spark: SparkSession, d: str) -> DataFrame:
    return frames.union_frames([pr.DeviceType(k).apply(pts(spark, d)).select(F.lit(k).alias("kind"), "row_id") for k in pr.DEVICE_TYPES])


TABLES = ("annotation", "data_source", "datapoint", "filter_range", "incremental_run", "unpacked_eda", "unpacked_imu", "unpacked_ppg")


@query(f"select table_name as name, count(*) as fields from information_schema.columns where table_name in {TABLES} group by 1")
def tables_and_schemas(spark: SparkSession, d: str) -> DataFrame:
    t = SensorTables(spark, d)
    return spark.createDataFrame([(n, len(t.schema(n))) for n in t.tables() if n in TABLES], "name string, fields long")


@query("select data_spec_name, 2 * count(*) as n from datapoint group by 1")
def sink_append(spark: SparkSession, d: str) -> DataFrame:
    t = SensorTables(spark, shared_folder(spark, "sink"))
    for _ in range(2):
        t.append(pts(spark, d), "datapoint")
    return t.table("datapoint").groupBy("data_spec_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {PTS} select distinct device_id, data_source_id, data_spec_name, t as measured_us, rate, confidence from pts")
def source_without_duplicates(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("data_point_metadata")
    df = BatchSource().read(SensorTables(spark, d))
    return df.select(m["device_id"].alias("device_id"), m["data_source_id"].alias("data_source_id"), "data_spec_name", F.unix_micros("measurement_timestamp_utc").alias("measured_us"), "rate", F.coalesce("confidence", F.lit(-1)).alias("confidence"))


@query("select row_id from datapoint")
def source_stream(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.replay import run_to_end

    folder = shared_folder(spark, "topic")
    pts(spark, d).write.parquet(folder)
    return run_to_end(StreamSource(topic=folder).read(spark, pts(spark, d).schema).select("row_id"), "rows").drop("batch")


@query(f"select registry, epoch_us(max(write_end_time)) as start_us, {us(D2)} as end_us from incremental_run where registry is not null and write_end_time is not null group by registry")
def run_state(spark: SparkSession, d: str) -> DataFrame:
    """The next range of each registry once the end of its last window is committed (a row for each registry)."""
    folder = shared_folder(spark, "state")
    log = load(spark, d, "incremental_run").where("registry is not null and write_end_time is not null").groupBy("registry").agg(F.unix_micros(F.max("write_end_time")).alias("us"))
    rows = []
    for r in log.collect():  # bounded by the registries
        state = RunState(spark, folder, f"r{abs(us(D1))}-{len(rows)}")
        state.commit(D1)
        state.commit(datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=r["us"]))
        a, b = state.next_range(D2)
        rows.append((r["registry"], us(a), us(b)))
    return spark.createDataFrame(rows, "registry string, start_us long, end_us long")


@query(f"""with {PTS}, {ANN}, {SRC}, f as (select device_id, s, e, case when annotation_id % 2 = 0 then '0' end as sensor from ann where annotation_label = 'on_wrist')
  select row_id from pts p left join src using (data_source_id) where exists (select 1 from f where f.device_id = p.device_id and (f.s is null or f.s <= p.t) and (f.e is null or p.t < f.e) and (f.sensor is null or f.sensor = src.sensor_id))""")
def filter_supplemental(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "annotation").where("annotation_label = 'on_wrist'").withColumn("supplemental_source_sensor_id", F.when(F.col("annotation_id") % 2 == 0, "0"))
    return ids(filters.apply_filters(flat_points(spark, d), [filters.data_filter(filter_rows(a).drop("data_spec"), "f", True)], ["f"]))


@query(f"with {PTS}, {ANN} select count(*) as rows_removed from pts p where not {covers('on_wrist')}")
def filter_counter(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Observation

    o = Observation("filter")
    filters.apply_filters(flat_points(spark, d), [label_filter(spark, d, "on_wrist", True)], ["on_wrist"], o).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(o.get["rows_removed"],)], "rows_removed long")


@query(f"with {PTS} select data_spec_name as spec, device_id, participant_id, participant_namespace, {COUNTS} from pts group by 1, 2, 3, 4")
def key_additional(spark: SparkSession, d: str) -> DataFrame:
    return counted(keys.key_by(pts(spark, d), True, True, additional={"spec": F.col("data_spec_name")}), [*ENTITY, "spec"])


OFFSETS = """offs as (select device_id, cast(case when zone[1] = '-' then -1 else 1 end * (cast(zone[2:3] as int) * 3600 + cast(zone[5:6] as int) * 60) as int) as off from
  (select device_serial_number as device_id, max(device_time_zone_name) as zone from data_source where regexp_full_match(device_time_zone_name, '[+-](0\\d|1[0-8]):[0-5]\\d') group by 1) x)"""


@query(f"with {PTS}, {OFFSETS} select row_id, t + coalesce(off, 0)::bigint * 1000000 as local_us from pts left join offs using (device_id) where device_id is not null")
def local_by_offset(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.zones import fixed_offset

    df = keys.key_by(pts(spark, d)).where("device_id is not null")
    own = load(spark, d, "data_source").where(F.col("device_time_zone_name").rlike(tu.OFFSET)).groupBy(F.col("device_serial_number").alias("device_id")).agg(fixed_offset(F.max("device_time_zone_name")).alias("o"))
    every = df.select("device_id").distinct().join(own, "device_id", "left").select("device_id", F.coalesce("o", F.lit(0)).alias("utc_offset_seconds"))
    return keys.with_offsets(df, every).select("row_id", F.unix_micros(keys.local_time(keys.measured(), offset_seconds=F.col("utc_offset_seconds"))).alias("local_us"))


def annotation_local_sql(c: str, zone: str) -> str:
    return f"""with {ANN}, {ZONES}, a as (select device_id, {c} as t from ann where {c} is not null), l as (select a.device_id, {zone} as t from a left join zones z on z.device_id = a.device_id)
      select device_id, t // {6 * HOUR} * {6 * HOUR} as start_time_range_micros, (t // {6 * HOUR} + 1) * {6 * HOUR} as end_time_range_micros, count(*) as n from l group by 1, 2, 3"""


def annotation_local(df: DataFrame, which: str, zone: Column) -> DataFrame:
    g = frames.build_frames(df, keys.Fixed("6 hours"), zone, annotations=which, by_participant=False)
    return g.df.groupBy("device_id", *WINDOW).agg(F.count(F.lit(1)).alias("n"))


@query(annotation_local_sql("s", "epoch_us(timezone('Australia/Adelaide', make_timestamptz(t)))"))
def annotation_window_fixed_tz(spark: SparkSession, d: str) -> DataFrame:
    return annotation_local(load(spark, d, "annotation"), "start", F.lit("Australia/Adelaide"))


@query(annotation_local_sql("e", LOCAL))
def annotation_window_local_tz(spark: SparkSession, d: str) -> DataFrame:
    zones = device_zone(spark, d).withColumnRenamed("device_id", "_d")
    df = load(spark, d, "annotation")
    return annotation_local(df.join(zones, F.col("annotation_metadata.device_id") == F.col("_d"), "left"), "end", F.coalesce("zone", F.lit("UTC")))


# Frames


def frame_sizes(f: pd.DataFrame) -> dict:
    """The key of a frame, from its attrs, and its size."""
    a = f.attrs
    return {"device_id": a["device_id"], "participant_id": a["participant_id"], "participant_namespace": -1 if a["participant_namespace"] is None else a["participant_namespace"], **{k: a[k] for k in WINDOW if k in a}, "n": len(f)}


SIZES = "device_id string, participant_id string, participant_namespace long, n long"
WINDOW_SIZES = SIZES + ", start_time_range_micros long, end_time_range_micros long"
FRAMES = "device_id, participant_id, participant_namespace"


def frame_windows_sql(expr: str, size: int, extra: str = "", join: str = "") -> str:
    return f"""with {PTS}{extra}, w as (select pts.device_id, participant_id, participant_namespace, {expr} as s from pts {join})
      select {FRAMES}, s as start_time_range_micros, s + {size} as end_time_range_micros, count(*) as n from w group by {FRAMES}, s"""


def slim_points(spark: SparkSession, d: str) -> DataFrame:
    return pts(spark, d).select("row_id", "data_point_metadata", "measurement_timestamp_utc", "rate").withColumn("data_point_metadata", F.col("data_point_metadata").withField("annotation_labels", F.array().cast("array<string>")))


@query(frame_windows_sql(f"t // {HOUR} * {HOUR}", HOUR))
def frames_window(spark: SparkSession, d: str) -> DataFrame:
    return frames.build_frames(slim_points(spark, d), keys.Fixed("1 hour")).apply(frame_sizes, WINDOW_SIZES)


@query(frame_windows_sql(f"epoch_us(timezone('Asia/Tokyo', make_timestamptz(t))) // {24 * HOUR} * {24 * HOUR}", 24 * HOUR))
def frames_window_in_zone(spark: SparkSession, d: str) -> DataFrame:
    return frames.build_frames(slim_points(spark, d), keys.Fixed("1 day"), F.lit("Asia/Tokyo")).apply(frame_sizes, WINDOW_SIZES)


@query(frame_windows_sql(f"({LOCAL}) // {24 * HOUR} * {24 * HOUR}", 24 * HOUR, f", {ZONES}", "left join zones z on z.device_id = pts.device_id"))
def frames_window_local(spark: SparkSession, d: str) -> DataFrame:
    zones = device_zone(spark, d).withColumnRenamed("device_id", "_d")
    df = slim_points(spark, d).join(zones, F.col("data_point_metadata.device_id") == F.col("_d"), "left").drop("_d")
    return frames.build_frames(df, keys.Fixed("1 day"), F.coalesce("zone", F.lit("UTC"))).apply(frame_sizes, WINDOW_SIZES)


@query(f"with {PTS} select {FRAMES}, count(*) as n from pts group by all")
def frames_entity(spark: SparkSession, d: str) -> DataFrame:
    """Rows by participant and device, as the builder keys them; the groups aren't gathered."""
    g = frames.build_frames(pts(spark, d))
    return g.df.groupBy(*g.keys).agg(F.count(F.lit(1)).alias("n")).withColumn("participant_namespace", F.coalesce("participant_namespace", F.lit(-1)))


@query(f"with {ANN} select {FRAMES}, count(*) as n from ann group by all")
def frames_annotations(spark: SparkSession, d: str) -> DataFrame:
    g = frames.build_frames(load(spark, d, "annotation"), annotations="start")
    return g.df.groupBy(*g.keys).agg(F.count(F.lit(1)).alias("n")).withColumn("participant_namespace", F.coalesce("participant_namespace", F.lit(-1)))


def frame_metadata(f: pd.DataFrame) -> dict:
    a, m = f.attrs, f.attrs["data_point_metadata"]
    written = (m["sensor_store_metadata"] or {}).get("sensor_store_write_time")
    return {"device_id": a["device_id"], "start_us": a["start_time_range_micros"], "data_source_id": -1 if m["data_source_id"] is None else m["data_source_id"], "participant_id": m["participant_id"], "written_us": -1 if written is None else pd.Timestamp(written).value // 1000, "labels": ",".join(m["annotation_labels"])}


@query(S["derived_metadata"])
def frames_metadata(spark: SparkSession, d: str) -> DataFrame:
    """derived_metadata as the frames of user functions have it."""
    g = frames.build_frames(pts(spark, d), keys.Fixed("1 hour"), by_participant=False)
    return g.apply(frame_metadata, "device_id string, start_us long, data_source_id long, participant_id string, written_us long, labels string")


def tagged_points(spark: SparkSession, d: str, *tags: str) -> dict[str, DataFrame]:
    out = {}
    for tag in tags:
        table, c = SENSORS[tag]
        df = load(spark, d, table).groupBy(F.col("data_point_metadata.device_id").alias("dev"), F.date_trunc("second", "measurement_timestamp_utc").alias("measurement_timestamp_utc")).agg(F.max(c).alias("value"))
        out[tag] = df.select(metadata_of(F.col("dev")).alias("data_point_metadata"), "measurement_timestamp_utc", "value")
    return out


COMBINED = f"a as (select device_id, at_us // 1000000 as s, max(value) as value from ({tag_sql('imu')}) x group by all), b as (select device_id, at_us // 1000000 as s, max(value) as value from ({tag_sql('eda')}) x group by all)"


@query(f"with {COMBINED}, u as (select * from a union all select * from b) select device_id, s // 3600 * {HOUR} as start_us, count(*) as n, count(value) as n_value from u group by 1, 2")
def frames_concat(spark: SparkSession, d: str) -> DataFrame:
    g = frames.build_frames(tagged_points(spark, d, "imu", "eda"), keys.Fixed("1 hour"), combine="concat")
    return g.apply(lambda f: {"device_id": f.attrs["device_id"], "start_us": f.attrs["start_time_range_micros"], "n": len(f), "n_value": f["value"].count()}, "device_id string, start_us long, n long, n_value long")


@query(f"with {COMBINED}, u as (select coalesce(a.device_id, b.device_id) as device_id, coalesce(a.s, b.s) as s, a.value as x, b.value as y from a full join b on a.device_id is not distinct from b.device_id and a.s = b.s) select device_id, s // 3600 * {HOUR} as start_us, count(*) as n, count(x) as n_imu, count(y) as n_eda from u group by 1, 2")
def frames_merge(spark: SparkSession, d: str) -> DataFrame:
    g = frames.build_frames(tagged_points(spark, d, "imu", "eda"), keys.Fixed("1 hour"), combine="merge")
    return g.apply(lambda f: {"device_id": f.attrs["device_id"], "start_us": f.attrs["start_time_range_micros"], "n": len(f), "n_imu": f["value_imu"].count(), "n_eda": f["value_eda"].count()}, "device_id string, start_us long, n long, n_imu long, n_eda long")


@query(f"with {PTS} select row_id, rate * 2 as doubled from pts where rate > 60")
def batches_mapped(spark: SparkSession, d: str) -> DataFrame:
    return frames.map_batches(pts(spark, d).select("row_id", "rate"), lambda f: f[f["rate"] > 60].assign(doubled=lambda x: x["rate"] * 2)[["row_id", "doubled"]], "row_id long, doubled double")


@query("""with m as (select row_id, data_point_metadata.device_id as device_id, epoch_us(measurement_timestamp_utc) as at_us, sqrt(acceleration_x ** 2 + acceleration_y ** 2 + acceleration_z ** 2) as g from unpacked_imu where acceleration_x is not null),
  w as (select *, count(*) over v as k, avg(g) over v as m, stddev_samp(g) over v as sd from m window v as (partition by device_id, at_us // 3600000000 order by at_us, row_id rows 99 preceding))
  select row_id, case when k = 100 then round(m, 2) end as mean, case when k = 100 then round(sd, 2) end as sd from w""")
def rolling_magnitude(spark: SparkSession, d: str) -> DataFrame:
    """The mean and deviation of the last 100 magnitudes of acceleration within an hour, by a window function."""
    from pyspark.sql import Window

    g = F.sqrt(sum((F.col(f"acceleration_{x}") ** 2 for x in "yz"), F.col("acceleration_x") ** 2))
    df = load(spark, d, "unpacked_imu").where("acceleration_x is not null").select("row_id", F.col("data_point_metadata.device_id").alias("device_id"), F.unix_micros("measurement_timestamp_utc").alias("at_us"), g.alias("g"))
    w = Window.partitionBy("device_id", F.floor(F.col("at_us") / HOUR)).orderBy("at_us", "row_id").rowsBetween(-99, 0)
    full = lambda c: F.when(F.count(F.lit(1)).over(w) == 100, F.round(c.over(w), 2))
    return df.select("row_id", full(F.avg("g")).alias("mean"), full(F.stddev_samp("g")).alias("sd"))


# Unpacking of signals


def signal_packets(spark: SparkSession, d: str, signal: str, rate: float = 64.0, prefix: str | None = None) -> DataFrame:
    """The packets as a packed spec's table, each also from another sensor."""
    spec = unpack.SIGNALS[signal]
    p = packets(spark, d)
    device = p["device"].cast("string") if prefix is None else F.concat(F.when(p["device"] % 2 == 0, prefix).otherwise("dev"), p["device"].cast("string"))
    true = F.timestamp_micros(F.round(p["true_ms"] * 1000).cast("long")) if spec.true_is_timestamp else p["true_ms"]
    value = F.transform("value", lambda x: x * 100)
    rows = p.select(metadata_of(device).alias("data_point_metadata"), F.timestamp_millis(F.col("start_ms").cast("long")).alias("measurement_timestamp_utc"), F.lit(rate).alias("sampling_rate"), true.alias("true_timestamp_millis"), F.col("true_index").alias("true_timestamp_sample_index"), *[value.alias(c) for c in (*spec.channels, *spec.optional)])
    return rows.withColumn("sensor_id", F.lit("0")).unionByName(rows.withColumn("sensor_id", F.lit("2")))


def signal_summary(spark: SparkSession, d: str, signal: str, channel: str, prefix: str | None = None, **how: object) -> DataFrame:
    out = unpack.unpack_signal(signal_packets(spark, d, signal, prefix=prefix, **{k: v for k, v in how.items() if k == "rate"}), signal, "0", load(spark, d, "data_source"), **{k: v for k, v in how.items() if k != "rate"})
    return summary(out.select(F.col("data_point_metadata.device_id").alias("device"), (F.unix_micros("measurement_timestamp_utc") / 1000.0).alias("timestamp_ms"), (F.col(channel) / 100).alias("value")))


def signal_sql(sql: str, value: str = "cast(x as double)", device: str = "cast(label as varchar)") -> str:
    return sql.replace("cast(x as double) as value", f"{value} as value").replace("cast(unnest(value) as double) as value", "unnest(value) as value").replace("label as device", f"{device} as device")


GAPS_SQL = S["unpack_gaps"]


@query(signal_sql(GAPS_SQL))
def unpack_imu_gyro(spark: SparkSession, d: str) -> DataFrame:
    return signal_summary(spark, d, "imu", "gyro_x")


@query(signal_sql(GAPS_SQL))
def unpack_ppg(spark: SparkSession, d: str) -> DataFrame:
    return signal_summary(spark, d, "ppg", "green")


@query(signal_sql(GAPS_SQL))
def unpack_two_channel_ppg(spark: SparkSession, d: str) -> DataFrame:
    return signal_summary(spark, d, "two_channel_ppg", "green_2")


@query(signal_sql(GAPS_SQL))
def unpack_picard_eda(spark: SparkSession, d: str) -> DataFrame:
    return signal_summary(spark, d, "picard_eda", "z2_adc")


@query(signal_sql(GAPS_SQL, "trunc(cast(x as double) * 100) / 100"))
def unpack_ecg(spark: SparkSession, d: str) -> DataFrame:
    return signal_summary(spark, d, "ecg", "raw_adc")


C2Q = "case when label % 2 = 0 then 'C2Q' else 'dev' end || label"


@query(f"select * from ({signal_sql(GAPS_SQL, device=C2Q)}) x where device like 'dev%' union all select * from ({signal_sql(S['unpack_legacy'], device=C2Q)}) y where device like 'C2Q%'")
def unpack_eda_with_legacy(spark: SparkSession, d: str) -> DataFrame:
    return signal_summary(spark, d, "eda", "raw_adc", "C2Q")


@query(signal_sql(GAPS_SQL))
def unpack_rate_ignored(spark: SparkSession, d: str) -> DataFrame:
    return signal_summary(spark, d, "ppg", "green", rate=32.0, on_rate="ignore")


@query(signal_sql(S["unpack_legacy"].replace("1000.0 / 64", "1000.0 / 32")))
def unpack_rate_legacy(spark: SparkSession, d: str) -> DataFrame:
    return signal_summary(spark, d, "ppg", "green", rate=32.0, on_rate="legacy")


@query("select count(distinct label) as median_fs_error from embeddings")
def unpack_rate_counter(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Observation

    o = Observation("rates")
    unpack.unpack(packets(spark, d).withColumn("sampling_rate", F.lit(32.0)), ["device"], ["value"], on_rate="ignore", observation=o).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(o.get["median_fs_error"],)], "median_fs_error long")


@query("select label as device, vec_id, 64 as n from embeddings")
def unpack_kept_columns(spark: SparkSession, d: str) -> DataFrame:
    return unpack.unpack(packets(spark, d, gaps=False), ["device"], ["value"], keep=["vec_id"]).groupBy("device", "vec_id").agg(F.count(F.lit(1)).alias("n"))


# Scalars


@query(f"with {PTS} select row_id, t // 1000 as ms, t // 1000 * 1000 as from_ms, t // 1000 as text_ms, case when row_id % 10 = 0 then 9223372036854775 else t end as warehouse_us, t // 1000 * 1000 as filter_us from pts")
def scalar_times(spark: SparkSession, d: str) -> DataFrame:
    t = keys.measured()
    ms = tu.millis(t)
    text = F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC"))
    stored = F.when(F.col("row_id") % 10 == 0, tu.UNBOUNDED_US).otherwise(F.unix_micros(t))
    return pts(spark, d).select("row_id", tu.required(ms, "time").alias("ms"), F.unix_micros(tu.from_millis(ms)).alias("from_ms"), tu.time_text_millis(text).alias("text_ms"), F.unix_micros(tu.parse_warehouse(stored)).alias("warehouse_us"), F.unix_micros(tu.filter_time(ms, "bigint")).alias("filter_us"))


@query("select row_id, data_point_metadata.device_id as device_id, data_point_metadata.participant_id as participant_id, coalesce(array_to_string(list_sort(list_distinct(data_point_metadata.annotation_labels)), ','), '') as labels, coalesce(epoch_us(data_point_metadata.sensor_store_metadata.sensor_store_write_time), -1) as written_us, rate from datapoint")
def raw_to_datapoints(spark: SparkSession, d: str) -> DataFrame:
    from ..schema import metadata as built

    m = F.col("data_point_metadata")
    made = built(m["device_id"], m["data_source_id"], m["participant_id"], m["participant_namespace"], m["sensor_store_metadata"]["sensor_store_write_time"], F.coalesce(m["annotation_labels"], F.array().cast("array<string>")))
    x = F.col("made")
    return pts(spark, d).select("row_id", made.alias("made"), "rate").select("row_id", x["device_id"].alias("device_id"), x["participant_id"].alias("participant_id"), F.array_join(x["annotation_labels"], ",").alias("labels"), F.coalesce(F.unix_micros(x["sensor_store_metadata"]["sensor_store_write_time"]), F.lit(-1)).alias("written_us"), "rate")


@query("select s_suppkey, 'https://console.example.org/jobs/eu-west/job-' || s_suppkey as url from supplier")
def job_urls(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "supplier").select("s_suppkey", tu.job_url("https://console.example.org/jobs/", F.lit("eu-west"), F.concat(F.lit("job-"), F.col("s_suppkey").cast("string"))).alias("url"))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(S)
