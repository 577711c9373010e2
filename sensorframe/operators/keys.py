"""Keys by entity, sensor and event-time window."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeutil import shift_seconds, to_local
from .predicates import with_sources

POINT_KEYS = {"device_id": "data_point_metadata.device_id", "participant_id": "data_point_metadata.participant_id", "participant_namespace": "data_point_metadata.participant_namespace"}
ANNOTATION_KEYS = {"device_id": "annotation_metadata.device_id", "participant_id": "annotation_metadata.participant_id", "participant_namespace": "annotation_metadata.participant_namespace"}


@dataclass(frozen=True)
class Fixed:
    """Windows of a fixed size, aligned to the epoch plus `offset`. Sizes are interval texts, e.g. '1 hour'."""

    size: str
    offset: str | None = None

    def assign(self, df: DataFrame, at: Column) -> DataFrame:
        return df.withColumn("_w", F.window(at, self.size, startTime=self.offset))


@dataclass(frozen=True)
class Sliding:
    """Windows of `size` every `slide`; a row comes out once for each window that holds it."""

    size: str
    slide: str
    offset: str | None = None

    def assign(self, df: DataFrame, at: Column) -> DataFrame:
        return df.withColumn("_w", F.window(at, self.size, self.slide, self.offset))


def key_by(df: DataFrame, by_device: bool = True, by_participant: bool = False, annotations: bool = False, additional: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds key columns: device_id, participant_id, participant_namespace and those of `additional`. Parts not asked for
    are null. ValueError if nothing is asked for."""
    if not (by_device or by_participant or additional):
        raise ValueError("a key needs a device, a participant or an additional column")
    names = ANNOTATION_KEYS if annotations else POINT_KEYS
    on = {"device_id": by_device, "participant_id": by_participant, "participant_namespace": by_participant}
    kinds = {"device_id": "string", "participant_id": "string", "participant_namespace": "bigint"}
    return df.withColumns({k: F.col(names[k]) if on[k] else F.lit(None).cast(kinds[k]) for k in names} | dict(additional or {}))


def key_field(df: DataFrame, field: str = "DeviceID", annotations: bool = False) -> DataFrame:
    """key_by through one of the names DeviceID, ParticipantID and Both."""
    parts = {"DeviceID": (True, False), "ParticipantID": (False, True), "Both": (True, True)}
    if field not in parts:
        raise ValueError(f"the key field must be one of {sorted(parts)}")
    return key_by(df, *parts[field], annotations=annotations)


def key_sensor(points: DataFrame, data_source: DataFrame) -> DataFrame:
    """key_by device and participant, with the sensor_id of the data source; an unknown source is an error."""
    return key_by(with_sources(points, data_source, ["sensor_id"], strict=True), True, True)


def key_time(df: DataFrame, window: Fixed | Sliding, at: Column) -> DataFrame:
    """Adds start_time_range_micros and end_time_range_micros of each window that holds `at`. Rows with null `at` are left out."""
    out = window.assign(df.withColumn("_at", at), F.col("_at"))
    return out.withColumns({"start_time_range_micros": F.unix_micros("_w.start"), "end_time_range_micros": F.unix_micros("_w.end")}).drop("_w", "_at")


def measured() -> Column:
    return F.col("measurement_timestamp_utc")


def annotation_time(which: str) -> Column:
    """An annotation's 'start' or 'end'."""
    if which not in ("start", "end"):
        raise ValueError("an annotation is windowed by its start or its end")
    return F.col(f"{which}_timestamp_utc")


def with_offsets(df: DataFrame, offsets: DataFrame, device: str = "device_id") -> DataFrame:
    """Adds utc_offset_seconds and zone from a table device_id, utc_offset_seconds?, zone?; an error for a device without."""
    o = offsets.select(F.col("device_id").alias("_device"), *[c for c in ("utc_offset_seconds", "zone") if c in offsets.columns])
    df = df.join(o, F.col(device) == F.col("_device"), "left")
    check = lambda c: F.when(F.col("_device").isNotNull(), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("no UTC offset for device "), F.coalesce(F.col(device), F.lit("null")))))
    return df.withColumns({c: check(c) for c in ("utc_offset_seconds", "zone") if c in offsets.columns}).drop("_device")


def local_time(at: Column, zone: Column | None = None, offset_seconds: Column | None = None) -> Column:
    """The wall clock as if it were UTC, by the zone's rules at that time, or by a fixed offset in seconds."""
    if zone is None and offset_seconds is None:
        raise ValueError("local time needs a zone or an offset")
    if zone is None:
        return shift_seconds(at, offset_seconds)
    return to_local(at, zone) if offset_seconds is None else F.coalesce(to_local(at, F.when(zone.isNotNull(), zone)), shift_seconds(at, offset_seconds))


def key_local(df: DataFrame, window: Fixed | Sliding, at: Column, zone: Column) -> DataFrame:
    """key_time by the wall clock at `zone` (a column, or F.lit of one zone): bounds are local times written as UTC, and
    an hour that the clock repeats is one window. Unknown zones count as UTC."""
    return key_time(df, window, local_time(at, zone))


def session_windows(df: DataFrame, keys: list[str], at: Column, gap: str) -> DataFrame:
    """keys, session_start_micros, session_end_micros and n of sessions without a pause of `gap` or longer."""
    g = df.groupBy(*keys, F.session_window(at, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.unix_micros("s.start").alias("session_start_micros"), F.unix_micros("s.end").alias("session_end_micros"), "n")
