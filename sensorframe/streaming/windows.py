"""Windowed counts over streams of data points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(points: DataFrame, lateness: str = "365 days") -> DataFrame:
    """device_id, start_us and n of each device's hours of measurement time; rows later than `lateness` are dropped.

    Works on streams and tables alike. Hours come out when the watermark passes their end, and all of them where the
    output mode is complete.
    """
    p = points.select(F.col("data_point_metadata.device_id").alias("device_id"), "measurement_timestamp_utc").withWatermark("measurement_timestamp_utc", lateness)
    g = p.groupBy("device_id", F.window("measurement_timestamp_utc", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("device_id", F.unix_micros("w.start").alias("start_us"), "n")


def last_rows(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the rows of a stream in update mode (see replay.run_to_end), the last of each key."""
    rest = [c for c in batches.columns if c not in (*keys, "batch")]
    return batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
