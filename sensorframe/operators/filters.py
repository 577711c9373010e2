"""Interval filters and annotation joins: which labelled intervals cover a data point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .intervals import merge_intervals

EVER = 1 << 60  # us; stands for an unbounded end
BUCKET_US = 3_600_000_000
#: Buckets of an interval: the first of these multiples of the bucket size of which it spans at most SPAN, else all time.
LEVELS, SPAN = (1, 32), 48
TOP_US = 1 << 61
KEYS = ("data_spec", "sensor_id", "algorithm_name", "algorithm_version")


def attach_covering(points: DataFrame, at: Column, intervals: DataFrame, keys: Sequence[str], payload: Sequence[str], bucket_us: int = BUCKET_US) -> DataFrame:
    """Points with `covering`: an array of structs (payload) of the intervals of the same keys that hold the time `at`.

    Both sides have the columns `keys`. Intervals have start_us and end_us (null: unbounded), half open; those with equal
    keys and payload are merged first, so what covers a point many times over comes once. They are then cut to buckets of
    time, the larger the longer they are, so that none makes more than about SPAN rows; what is longer than SPAN of the
    largest buckets (64 days by default, so at most six intervals a year for each key and payload) is kept by key alone.
    A point meets one row of each size of bucket, however the joins are done: all sizes share one table, which Spark
    broadcasts where its own size check allows. No pairs of points and intervals are formed, and no row holds more than
    disjoint intervals of each payload. A null key meets nothing.
    """
    slim = intervals.select(*keys, *payload, F.coalesce("start_us", F.lit(-EVER)).alias("start_us"), F.coalesce("end_us", F.lit(EVER)).alias("end_us"))
    merged = merge_intervals(slim, list(keys), also=list(payload))
    sizes = [bucket_us * n for n in LEVELS] + [TOP_US]

    def cells(level: int) -> tuple[Column, Column]:
        """The interval's buckets of a size, and whether they are few enough."""
        first, last = F.floor(F.col("start_us") / sizes[level]).cast("long"), F.floor((F.col("end_us") - 1) / sizes[level]).cast("long")
        return F.transform(F.sequence(first, last), lambda b: F.struct(F.lit(level).alias("_level"), b.alias("_bucket"))), last - first <= SPAN

    where = cells(len(LEVELS))[0]
    for level in reversed(range(len(LEVELS))):
        own, few = cells(level)
        where = F.when(few, own).otherwise(where)
    item = F.struct("start_us", "end_us", F.struct(*payload).alias("_p"))
    cover = merged.select(*keys, item.alias("_x"), F.inline(where)).groupBy(*keys, "_level", "_bucket").agg(F.collect_list("_x").alias("_parts"))
    df, t = points.withColumn("_at", F.unix_micros(at)), F.col("_at")
    for level, size in enumerate(sizes):
        found = cover.withColumnsRenamed({"_parts": f"_parts_{level}"})
        df = df.withColumns({"_level": F.lit(level), "_bucket": F.floor(t / size).cast("long")}).join(found, [*keys, "_level", "_bucket"], "left").drop("_level", "_bucket")
    none = F.array().cast(cover.schema["_parts"].dataType)
    hit = F.filter(F.concat(*[F.coalesce(f"_parts_{i}", none) for i in range(len(sizes))]), lambda x: (x["start_us"] <= t) & (t < x["end_us"]))
    return df.withColumn("covering", F.transform(hit, lambda x: x["_p"])).drop("_at", *[f"_parts_{i}" for i in range(len(sizes))])


def data_filter(intervals: DataFrame, filter_id: str, inclusive: bool) -> DataFrame:
    """Rows of a filter table (device_id, start_us, end_us and any of KEYS) as one filter; missing keys match anything."""
    extra = [(F.col(k) if k in intervals.columns else F.lit(None)).cast("string").alias(k) for k in KEYS]
    return intervals.select(F.lit(filter_id).alias("filter_id"), F.lit(inclusive).alias("is_inclusive"), "device_id", "start_us", "end_us", *extra)


def apply_filters(points: DataFrame, filters: Sequence[DataFrame], inclusive_ids: Sequence[str], observation: Observation | None = None) -> DataFrame:
    """Points that every inclusive filter covers and no exclusive one does.

    Points have columns device_id, measurement_timestamp_utc and KEYS; filters come from data_filter. A null key of a
    filter row matches any value. An inclusive filter counts once, by however many of its rows it covers a point; one
    without rows covers nothing. Without inclusive filters all points pass that test. After the result has been used, an
    `observation` has the number of points left out as rows_removed.
    """
    if not filters:
        return points
    table = filters[0]
    for f in filters[1:]:
        table = table.unionByName(f)
    df = attach_covering(points, F.col("measurement_timestamp_utc"), table.where("device_id is not null"), ["device_id"], ["filter_id", "is_inclusive", *KEYS])

    def fits(x: Column) -> Column:
        out = F.lit(True)
        for k in KEYS:
            out = out & (x[k].isNull() | x[k].eqNullSafe(F.col(k)))
        return out

    hit = F.filter("covering", fits)
    within = F.array_distinct(F.transform(F.filter(hit, lambda x: x["is_inclusive"]), lambda x: x["filter_id"]))
    ok = (F.size(within) == len(set(inclusive_ids))) & ~F.exists(hit, lambda x: ~x["is_inclusive"])
    if observation is not None:
        df = df.withColumn("_ok", ok).observe(observation, F.count(F.when(~F.col("_ok"), 1)).alias("rows_removed"))
        return df.where("_ok").drop("covering", "_ok")
    return df.where(ok).drop("covering")


def rounded(intervals: DataFrame) -> DataFrame:
    """start_us down and end_us up to whole seconds."""
    return intervals.withColumns({"start_us": F.floor(F.col("start_us") / 1_000_000) * 1_000_000, "end_us": F.ceil(F.col("end_us") / 1_000_000) * 1_000_000})


def join_annotations(points: DataFrame, annotations: DataFrame, labels: Sequence[str], join_if: str = "ANY", on_participant: bool = True, round_to_second: bool = False) -> DataFrame:
    """Points within an annotation of their device, with the sorted distinct labels of these as joined_labels.

    Points have device_id, participant_id, participant_namespace and measurement_timestamp_utc; annotations also
    annotation_label, start_us and end_us. ANY: at least one of `labels` covers the point; ALL: each does. With
    `on_participant` the participant must be the same (null equals null).
    """
    if join_if not in ("ANY", "ALL"):
        raise ValueError("join_if must be ANY or ALL")
    wanted = sorted(set(labels))
    rows = annotations.where(F.col("annotation_label").isin(wanted) & F.col("device_id").isNotNull())
    rows = rounded(rows) if round_to_second else rows
    a = rows.select("device_id", "annotation_label", "start_us", "end_us", F.col("participant_id").alias("p"), F.col("participant_namespace").alias("ns"))
    df = attach_covering(points, F.col("measurement_timestamp_utc"), a, ["device_id"], ["annotation_label", "p", "ns"])
    same = (lambda x: x["p"].eqNullSafe(F.col("participant_id")) & x["ns"].eqNullSafe(F.col("participant_namespace"))) if on_participant else (lambda x: F.lit(True))
    df = df.withColumn("joined_labels", F.array_sort(F.array_distinct(F.transform(F.filter("covering", same), lambda x: x["annotation_label"])))).drop("covering")
    return df.where(F.size("joined_labels") >= (len(wanted) if join_if == "ALL" else 1))
