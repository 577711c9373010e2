"""Metadata derived from groups of data points, and the usual UTC offset of devices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def derived_metadata(points: DataFrame, keys: Sequence[str], meta: str = "data_point_metadata", at: str = "measurement_timestamp_utc") -> DataFrame:
    """keys and derived_metadata of each group, by mergeable aggregates.

    The data source is that of the least point by (time, data_source_id); participant and namespace the only ones there
    are beside nulls; the write time the latest; labels the union, sorted. More than one device, or more than one
    participant, in a group is an error when derived_metadata is read. Echo metadata is null. Groups of no points don't
    exist, so an empty table gives no rows.
    """
    m = F.col(meta)
    who = F.when(m["participant_id"].isNotNull() | m["participant_namespace"].isNotNull(), F.struct(m["participant_id"].alias("id"), m["participant_namespace"].alias("ns")))
    g = points.groupBy(*keys).agg(
        F.min_by(F.struct(m["data_source_id"]), F.struct(F.col(at), m["data_source_id"])).alias("source"),
        F.min(m["device_id"]).alias("device"), F.max(m["device_id"]).alias("device_2"), F.min(who).alias("who"), F.max(who).alias("who_2"),
        F.max(m["sensor_store_metadata"]["sensor_store_write_time"]).alias("written"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(m["annotation_labels"])))).alias("labels"),
    )
    one = lambda a, b, what: F.when(F.col(a).eqNullSafe(F.col(b)), F.col(a)).otherwise(F.raise_error(F.lit(f"several {what} in a group")))
    out: Column = F.struct(
        F.col("source.data_source_id").alias("data_source_id"), one("device", "device_2", "devices").alias("device_id"), one("who", "who_2", "participants")["id"].alias("participant_id"),
        one("who", "who_2", "participants")["ns"].alias("participant_namespace"), F.lit(None).cast(points.schema[meta].dataType["echo_metadata"].dataType).alias("echo_metadata"),
        F.when(F.col("written").isNotNull(), F.struct(F.col("written").alias("sensor_store_write_time"))).alias("sensor_store_metadata"), F.col("labels").alias("annotation_labels"),
    )
    return g.select(*keys, out.alias("derived_metadata"))


def modal_offset(df: DataFrame, device: str, offset: str) -> DataFrame:
    """device and offset: the commonest non-null offset of each device, the smallest among equally common ones."""
    counts = df.where(F.col(device).isNotNull() & F.col(offset).isNotNull()).groupBy(device, offset).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(device).agg(F.max_by(offset, F.struct("n", -F.col(offset))).alias(offset))
