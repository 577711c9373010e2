"""Queries of the general data problems, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeparse import range_bounds
from ..operators import grid, incremental, intervals, panes, readings, spikes
from ..sources.tables import load, shared_folder
from ..streaming import groups
from ..streaming import panes as stream_panes
from ..streaming.replay import replay, run_to_end

LONGEST_GAP_US = 72 * 3_600_000_000


def _effective(spark: SparkSession, d: str) -> DataFrame:
    return readings.effective_rows(load(spark, d, "datapoint"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return panes.period_outcomes(panes.corrected_periods(_effective(spark, d)))


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    p = panes.corrected_periods(_effective(spark, d))
    return p.select("device_id", "window_start_us", "n_initial", F.round("total_initial", 2).alias("total_initial"), "n_final", F.round("total_final", 2).alias("total_final"), "late_events", "dropped_events")


def p1_stream_periods(spark: SparkSession, d: str) -> DataFrame:
    """p1_periods from a stream of the effective rows in the order of their arrival, through the store of panes."""
    rows = panes.period_events(_effective(spark, d))
    periods = stream_panes.stream_to_end(replay(rows, F.col("arrival_us"), 5), shared_folder(spark, "panes"), ["device_id"], panes.PaneSpec(), "measured_us", "arrival_us", F.col("total"), F.col("n"))
    return periods.withColumns({c: F.round(c, 2) for c in ("total_initial", "total_final")})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.unread_rows(_effective(spark, d), load(spark, d, "incremental_run")).select("registry", "row_id")


def p2_processed(spark: SparkSession, d: str) -> DataFrame:
    return incremental.processed_intervals(load(spark, d, "incremental_run"))


def p2_ledger(spark: SparkSession, d: str) -> DataFrame:
    """p2_found through the ledger: runs over what is pending, of which the first dies between output and commit."""
    log = load(spark, d, "incremental_run")
    at = shared_folder(spark, "effective")
    incremental.registry_rows(_effective(spark, d), log).select("registry", "row_id", "arrival_us").write.parquet(at)
    rows = spark.read.parquet(at)
    ledger = incremental.IntervalLedger(spark, shared_folder(spark, "ledger"), ["registry"])
    ledger.seed(incremental.processed_intervals(log))
    b = rows.agg(F.min("arrival_us").alias("a"), F.max("arrival_us").alias("b")).first()  # two numbers
    a, z = (b["a"], b["b"] + 1) if b["a"] is not None else (0, 1)

    def available(until: int) -> DataFrame:
        return rows.select("registry").distinct().select("registry", F.lit(a).alias("start_us"), F.lit(until).alias("end_us"))

    def work(new: DataFrame) -> DataFrame:
        return new.select("registry", "row_id")

    def dies() -> None:
        raise InterruptedError("between output and commit")

    try:
        ledger.run(rows, "arrival_us", available((a + z) // 2), work, dies)
    except InterruptedError:
        pass
    for until in ((a + z) // 2, z):
        ledger.run(rows, "arrival_us", available(until), work)
    out = ledger.output()
    return out if out is not None else work(rows).where("false")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return range_bounds(load(spark, d, "filter_range"), load(spark, d, "data_source"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = intervals.annotation_intervals(load(spark, d, "annotation"))
    return intervals.periods_and_gaps(rows, ["device_id", "annotation_label"], LONGEST_GAP_US)


def p4_stream(spark: SparkSession, d: str) -> DataFrame:
    """p4_found from a stream of the intervals, up to twelve hours out of order, through interval maps in keyed state."""
    rows = load(spark, d, "annotation").select(F.col("annotation_metadata.device_id").alias("device_id"), "annotation_label", F.col("start_timestamp_utc").alias("start"), F.col("end_timestamp_utc").alias("end"), "annotation_id")
    mixed = F.unix_micros("start") + F.pmod(F.xxhash64("annotation_id"), F.lit(12 * 3_600_000_000))
    keys = ["device_id", "annotation_label"]
    told = groups.last_revisions(run_to_end(groups.stream_intervals(replay(rows, mixed, 5), keys), "intervals"), keys)
    return told.where((F.col("kind") == "period") | (F.col("end_us") - F.col("start_us") <= LONGEST_GAP_US))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.filled_slots(load(spark, d, "unpacked_ppg"))


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole five-second series with imputed values."""
    return grid.regular_grid(grid.ppg_readings(load(spark, d, "unpacked_ppg")), "device_id", "at_us", "green")


def p5_real_slots(spark: SparkSession, d: str) -> DataFrame:
    """The slots of the series that hold readings, with their means."""
    return p5_grid(spark, d).where("not filled").select("device_id", "slot_start_us", F.round("value", 4).alias("value"))


def p5_held_out(spark: SparkSession, d: str) -> DataFrame:
    """By device: how far imputed values are from those of slots held out, and how far a straight line is."""
    x = grid.held_out(grid.ppg_readings(load(spark, d, "unpacked_ppg")), "device_id", "at_us", "green")
    off = lambda c: F.avg(F.abs(F.col(c) - F.col("true")))
    return x.where("line is not null").groupBy("device_id").agg(F.count(F.lit(1)).alias("slots"), off("imputed").alias("error"), off("line").alias("line_error"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(spikes.sensor_rows(load(spark, d, "unpacked_imu"), load(spark, d, "unpacked_eda")))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_periods, p1_stream_periods, p2_found, p2_processed, p2_ledger, p3_found, p4_found, p4_stream, p5_found, p5_grid, p5_real_slots, p5_held_out, p6_found)}


EFFECTIVE = """
rows_in as (
  select row_id, data_point_metadata.device_id as device_id, data_spec_name, epoch_us(measurement_timestamp_utc) as measured_us,
    epoch_us(coalesce(data_point_metadata.sensor_store_metadata.sensor_store_write_time, data_point_metadata.echo_metadata.bucket_write_time)) as arrival_us,
    rate, confidence
  from datapoint where data_point_metadata.echo_metadata.deleted_time is null),
ordered as (
  select *, row_number() over w as rn, lag(rate) over w as previous_rate, lag(confidence) over w as previous_confidence
  from rows_in where arrival_us is not null and measured_us is not null
  window w as (partition by device_id, data_spec_name, measured_us order by arrival_us, row_id)),
effective as (
  select *, rn = 1 as is_first from ordered
  where rn = 1 or rate is distinct from previous_rate or confidence is distinct from previous_confidence)"""

PERIODS = f"""{EFFECTIVE},
events as (
  select *, measured_us // 3600000000 as hour, arrival_us >= (measured_us // 3600000000 + 2) * 3600000000 as late,
    arrival_us >= (measured_us // 3600000000 + 49) * 3600000000 as dropped
  from effective where device_id is not null),
deltas as (
  select *, case when is_first then 1 else 0 end as n,
    coalesce(rate, 0) - case when is_first then 0 else coalesce(previous_rate, 0) end as total from events)"""

MERGED = """
marked as (
  select *, case when start_us <= max(end_us) over (partition by {keys} order by start_us, end_us rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh
  from intervals),
numbered as (select *, sum(fresh) over (partition by {keys} order by start_us, end_us rows unbounded preceding) as island from marked),
merged as (select {keys}, min(start_us) as start_us, max(end_us) as end_us from numbered group by {keys}, island)"""

PROCESSED = """
last_rows as (
  select registry, run_id, run_status, epoch_us(write_start_time) as start_us, epoch_us(write_end_time) as end_us,
    row_number() over (partition by registry, run_id order by coalesce(epoch_us(logged_at), -4611686018427387904) desc, log_id desc) as rn
  from incremental_run where registry is not null),
intervals as (select registry, start_us, end_us from last_rows where rn = 1 and run_status = 'SUCCEEDED' and start_us is not null and end_us > start_us),
""" + MERGED.format(keys="registry")


def oracle_sql() -> dict[str, str]:
    sql = {
        "p1_found": f"""with {PERIODS}
            select distinct device_id, hour * 3600000 as period_start_ms, 'corrected' as outcome from events where late and not dropped
            union all select distinct device_id, hour * 3600000, 'dropped' from events where dropped""",
        "p1_periods": f"""with {PERIODS}
            select device_id, hour * 3600000000 as window_start_us, cast(sum(case when late then 0 else n end) as bigint) as n_initial,
              round(sum(case when late then 0 else total end), 2) as total_initial, cast(sum(case when dropped then 0 else n end) as bigint) as n_final,
              round(sum(case when dropped then 0 else total end), 2) as total_final,
              cast(count(*) filter (where late and not dropped) as bigint) as late_events, cast(count(*) filter (where dropped) as bigint) as dropped_events
            from deltas group by device_id, hour""",
        "p2_found": f"""with {EFFECTIVE}, {PROCESSED},
            specs as (select distinct registry, data_spec_name from incremental_run where registry is not null)
            select s.registry, e.row_id from effective e join specs s on e.data_spec_name = s.data_spec_name
            where not exists (select 1 from merged m where m.registry = s.registry and e.arrival_us >= m.start_us and e.arrival_us < m.end_us)""",
        "p2_processed": f"with {PROCESSED} select registry, start_us, end_us from merged",
        "p5_found": """with usable as (
              select data_point_metadata.device_id as device_id, epoch_us(measurement_timestamp_utc) as t from unpacked_ppg
              where data_point_metadata.device_id is not null and measurement_timestamp_utc is not null and green is not null and not isnan(green)),
            pairs as (select device_id, t, lag(t) over (partition by device_id order by t) as before from usable)
            select device_id, unnest(range(before // 5000000 + 1, t // 5000000)) * 5000 as slot_start_ms from pairs where t - before <= 120000000""",
        "p5_real_slots": """select data_point_metadata.device_id as device_id, epoch_us(measurement_timestamp_utc) // 5000000 * 5000000 as slot_start_us, round(avg(green), 4) as value from unpacked_ppg
            where data_point_metadata.device_id is not null and measurement_timestamp_utc is not null and green is not null and not isnan(green) group by 1, 2""",
        "p4_found": f"""with intervals as (
              select annotation_metadata.device_id as device_id, annotation_label, epoch_us(start_timestamp_utc) as start_us, epoch_us(end_timestamp_utc) as end_us
              from annotation where annotation_metadata.device_id is not null and annotation_label is not null and end_timestamp_utc > start_timestamp_utc),
            {MERGED.format(keys="device_id, annotation_label")},
            nexts as (select *, lead(start_us) over (partition by device_id, annotation_label order by start_us) as next_us from merged)
            select device_id, annotation_label, 'period' as kind, start_us, end_us from merged
            union all select device_id, annotation_label, 'gap', end_us, next_us from nexts where next_us - end_us <= {LONGEST_GAP_US}""",
    }
    return sql | {"p1_stream_periods": sql["p1_periods"], "p2_ledger": sql["p2_found"], "p4_stream": sql["p4_found"]}
