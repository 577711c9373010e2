"""Duplicate removal and the measurement intervals of newly written data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeutil import UNITS, unit_interval

MODES = ("TRUNCATE_INTERVALS", "EXPORT", "EXPAND_INTERVALS")


def remove_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One of the rows with equal `keys` (null equals null); which one is not fixed where the other columns differ."""
    return df.dropDuplicates(list(keys))


def keep_latest(df: DataFrame, keys: Sequence[str], written: Column, tie: str) -> DataFrame:
    """The row of each key written last; the greatest `tie` among those, null write times first.

    An aggregate that combines before the shuffle, so copies of a hot row never meet in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(F.unix_micros(written), F.lit(-(1 << 62))), F.col(tie)))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def written_intervals(points: DataFrame, keys: Sequence[str], at: str, written: Column, start: Column, end: Column, mode: str = "TRUNCATE_INTERVALS", unit: str = "HOUR") -> DataFrame:
    """keys, min_time and max_time of what was written in [start, end): its measurement times, floored and raised to
    whole units (TRUNCATE_INTERVALS) or widened by one unit (EXPAND_INTERVALS)."""
    if mode not in MODES or unit not in UNITS:
        raise ValueError(f"mode must be one of {MODES}, unit one of {UNITS}")
    g = points.where((written >= start) & (written < end)).groupBy(*keys).agg(F.min(at).alias("a"), F.max(at).alias("b"))
    if mode == "EXPAND_INTERVALS":
        lo, hi = F.col("a") - unit_interval(unit), F.col("b") + unit_interval(unit)
    elif mode == "TRUNCATE_INTERVALS":
        floor = lambda c: F.date_trunc(unit.lower(), F.col(c))
        lo, hi = floor("a"), F.when(floor("b") == F.col("b"), F.col("b")).otherwise(floor("b") + unit_interval(unit))
    else:
        lo, hi = F.col("a"), F.col("b")
    return g.select(*keys, lo.alias("min_time"), hi.alias("max_time"))


def incremental_points(points: DataFrame, keys: Sequence[str], at: str, written: Column, start: Column, end: Column, mode: str = "TRUNCATE_INTERVALS", unit: str = "HOUR") -> DataFrame:
    """EXPORT: the points written in [start, end). Other modes: all points, whenever written, whose time lies in
    [min_time, max_time] of their key's written_intervals. Points with a null key belong to no interval."""
    if mode == "EXPORT":
        return points.where((written >= start) & (written < end))
    spans = written_intervals(points, keys, at, written, start, end, mode, unit)
    return points.join(spans, list(keys)).where((F.col(at) >= F.col("min_time")) & (F.col(at) <= F.col("max_time"))).select(points.columns)
