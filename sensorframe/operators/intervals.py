"""Interval sets: continuous periods, gaps, cover tables and interval joins, safe against hot keys."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.groups import whole_groups

DAY_US = 86_400_000_000


class IntervalMap:
    """Disjoint intervals in order. `insert` finds what overlaps or touches by binary search and merges it."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts: Sequence[int] = (), ends: Sequence[int] = ()):
        self.starts, self.ends = list(starts), list(ends)

    def insert(self, start: int, end: int) -> None:
        if end <= start:
            return
        i = bisect_left(self.ends, start)  # the first that ends at or after start
        j = bisect_right(self.starts, end)  # behind the last that starts at or before end
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]

    def evict(self, before: int) -> list[tuple[int, int]]:
        """Takes out and returns the intervals that end before `before`."""
        i = bisect_left(self.ends, before)
        out = list(zip(self.starts[:i], self.ends[:i]))
        del self.starts[:i], self.ends[:i]
        return out

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:]))

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return iter(zip(self.starts, self.ends))

    def __len__(self) -> int:
        return len(self.starts)


def _fold(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows come clustered by (keys, slice), first a slice's border row: no start, how far earlier slices reach as its end.

    Each slice's intervals go through its IntervalMap. The periods that start in the slice come out, each with the end of
    the period before it; the last one is marked as open, with what the slice's first start has before it: that is where
    the last period of the slices before ends.
    """
    for table, heads in whole_groups(batches, [*keys, "_slice"]):
        starts, ends = table.column("start_us").to_pylist(), table.column("end_us").to_pylist()
        out: dict[str, list] = {c: [] for c in ("at", "start_us", "end_us", "gap_start_us", "_open", "_first_before")}
        for a, b in zip(heads.tolist(), [*heads.tolist()[1:], len(starts)]):
            held = IntervalMap()
            if ends[a] is not None:
                held.insert(_BEFORE, ends[a])
            for i in range(a + 1, b):
                held.insert(starts[i], ends[i])
            own = [x for x in zip(held.starts, held.ends, [None, *held.ends[:-1]]) if x[0] != _BEFORE]
            for n, (s, e, before) in enumerate(own):
                last = n == len(own) - 1
                for c, x in zip(out, (a, s, e, before, last, own[0][2] if last else None)):
                    out[c].append(x)
        rows = pa.array(out.pop("at"), pa.int64())
        columns = [table.column(c).combine_chunks().take(rows) for c in (*keys, "_slice", "_last_end")]
        kinds = {"_open": pa.bool_()}
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items())], [*keys, "_slice", "_last_end", *out])


_BEFORE = -(1 << 62)  # us; before anything


def merge_intervals(df: DataFrame, keys: Sequence[str], slice_us: int = DAY_US, also: Sequence[str] = ()) -> DataFrame:
    """Maximal continuous periods of each key from its intervals [start_us, end_us), and the gap before each.

    Columns: keys, also, start_us, end_us, gap_start_us (where the key's earlier period ends; null for the first).
    Intervals that overlap, nest or touch belong together. Rows with a null key, a null bound or end <= start don't count;
    columns in `also` belong to the key but may be null (null equals null). Repeated rows change nothing; an empty table
    gives no rows.

    Each (key, slice of starts) keeps an ordered interval map, so a hot key is worked on by one task for each slice. How
    far all earlier slices reach comes from an aggregate of one row a slice, and goes into the map first; so all but the
    last period of a slice are final as they leave it, and only one row a slice goes through the window that ends these.
    """
    by = [*keys, *also]
    clean = df.where(F.col("start_us").isNotNull() & F.col("end_us").isNotNull() & (F.col("end_us") > F.col("start_us")))
    for k in keys:
        clean = clean.where(F.col(k).isNotNull())
    names = [f"_k{i}" for i in range(len(by))]  # callers' names can't clash with those used in between
    none = F.lit(None).cast("long")
    slim = clean.select(*[F.col(k).alias(n) for k, n in zip(by, names)], F.floor(F.col("start_us") / slice_us).alias("_slice"), F.col("start_us").cast("long").alias("start_us"), F.col("end_us").cast("long").alias("end_us"))

    w = Window.partitionBy(*names).orderBy("_slice")
    reach = slim.groupBy(*names, "_slice").agg(F.max("end_us").alias("_reach"))
    borders = reach.select(*names, "_slice", none.alias("start_us"), F.max("_reach").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("end_us"), F.max("_reach").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_last_end"))

    both = slim.withColumn("_last_end", none).unionByName(borders).repartition(*names, "_slice").sortWithinPartitions(*names, "_slice", F.col("start_us").asc_nulls_first())
    kinds = ", ".join(f"{n} {slim.schema[n].dataType.simpleString()}" for n in names)
    folded = both.mapInArrow(lambda b: _fold(b, names), f"{kinds}, _slice long, _last_end long, start_us long, end_us long, gap_start_us long, _open boolean, _first_before long")
    # periods that are final have a window group of their own slice; the open ones of a key meet in one
    order = Window.partitionBy(*names, F.when(~F.col("_open"), F.col("_slice"))).orderBy("_slice", "start_us")
    end = F.when(F.col("_open"), F.coalesce(F.lead("_first_before").over(order), F.col("_last_end"))).otherwise(F.col("end_us"))
    return folded.select(*[F.col(n).alias(k) for k, n in zip(by, names)], "start_us", end.alias("end_us"), "gap_start_us")


def periods_and_gaps(df: DataFrame, keys: Sequence[str], longest_gap_us: int, slice_us: int = DAY_US) -> DataFrame:
    """Columns: keys, kind ('period' or 'gap'), start_us, end_us. Gaps longer than `longest_gap_us` are left out."""
    m = merge_intervals(df, keys, slice_us)
    gap = F.when(F.col("start_us") - F.col("gap_start_us") <= longest_gap_us, F.struct(F.lit("gap").alias("kind"), F.col("gap_start_us").alias("start_us"), F.col("start_us").alias("end_us")))
    period = F.struct(F.lit("period").alias("kind"), "start_us", "end_us")
    return m.select(*keys, F.explode(F.filter(F.array(period, gap), lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*")


def annotation_intervals(annotation: DataFrame) -> DataFrame:
    """device_id, annotation_label, start_us and end_us of the rows of an annotation table."""
    return annotation.select(
        F.col("annotation_metadata.device_id").alias("device_id"), "annotation_label", F.unix_micros("start_timestamp_utc").alias("start_us"), F.unix_micros("end_timestamp_utc").alias("end_us")
    )


def cover_table(merged: DataFrame, keys: Sequence[str], bucket_us: int) -> DataFrame:
    """For each key and time bucket the parts of disjoint intervals in it: columns keys, _bucket, _parts (array of s, e).

    Many narrow rows in place of few wide ones: a point meets one row at most, whichever way Spark joins them.
    """
    b = F.explode(F.sequence(F.floor(F.col("start_us") / bucket_us), F.floor((F.col("end_us") - 1) / bucket_us))).alias("_bucket")
    return merged.select(*keys, "start_us", "end_us", b).groupBy(*keys, "_bucket").agg(F.collect_list(F.struct(F.col("start_us").alias("s"), F.col("end_us").alias("e"))).alias("_parts"))


def _with_cover(points: DataFrame, merged: DataFrame, keys: Sequence[str], at: str, bucket_us: int, how: str) -> tuple[DataFrame, Column]:
    cover = cover_table(merged, keys, bucket_us)
    df = points.withColumn("_bucket", F.floor(F.col(at) / bucket_us)).join(cover, [*keys, "_bucket"], how)
    return df, F.exists("_parts", lambda p: (F.col(at) >= p["s"]) & (F.col(at) < p["e"]))


def outside(points: DataFrame, merged: DataFrame, keys: Sequence[str], at: str, bucket_us: int) -> DataFrame:
    """Points (with a time column `at`, us) that lie in no interval of their keys."""
    df, hit = _with_cover(points, merged, keys, at, bucket_us, "left")
    return df.where(F.col("_parts").isNull() | ~hit).drop("_bucket", "_parts")


def inside(points: DataFrame, merged: DataFrame, keys: Sequence[str], at: str, bucket_us: int) -> DataFrame:
    """Points (with a time column `at`, us) that lie in an interval of their keys."""
    df, hit = _with_cover(points, merged, keys, at, bucket_us, "inner")
    return df.where(hit).drop("_bucket", "_parts")
