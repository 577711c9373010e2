"""Stateful operators over streams: interval maps, and whole groups handed on when their window closes."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.intervals import IntervalMap


def stream_intervals(intervals: DataFrame, keys: Sequence[str] = ("key",), lateness: str = "1 day") -> DataFrame:
    """Continuous periods and gaps of a stream of intervals with columns keys, start and end (timestamps).

    Each key keeps an ordered map of disjoint intervals; an insertion finds its overlaps by binary search and merges
    them. After each batch that changes a key, the periods and gaps that have become true come out with live = true and
    those that no longer hold with live = false: keys, kind, start_us, end_us, live, revision. The last revision of each
    (key, kind, start, end) tells whether it holds.

    Rows with a null key or bound, with end <= start, or that start before the watermark are left out. Periods that end
    before the watermark are final and leave the state, but for the last one, from which the next gap is counted; so a
    key's state is bounded by what `lateness` spans.
    """
    valid = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    rows = intervals.where(valid & F.col("start").isNotNull() & (F.col("end") > F.col("start"))).select(*keys, "start", "end").withWatermark("start", lateness)

    def step(key, frames, state):  # noqa: ANN001, ANN202
        starts, ends, revision = pickle.loads(state.get[0]) if state.exists else ((), (), 0)
        held, mark = IntervalMap(starts, ends), state.getCurrentWatermarkMs() * 1000
        before = _told(held)
        for f in frames:
            s, e = (f[c].to_numpy().astype("datetime64[us]").astype("int64") for c in ("start", "end"))
            for a, b in zip(s[s >= mark].tolist(), e[s >= mark].tolist()):
                held.insert(a, b)
        after = _told(held)
        out = [(*x, False) for x in sorted(before - after)] + [(*x, True) for x in sorted(after - before)]
        final = held.evict(mark)
        if final:
            held.insert(*final[-1])
        state.update((pickle.dumps((held.starts, held.ends, revision + 1)),))
        yield pd.DataFrame([(*key, *o, revision + 1) for o in out], columns=[*keys, "kind", "start_us", "end_us", "live", "revision"])

    kinds = ", ".join(f"`{k}` {intervals.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, kind string, start_us long, end_us long, live boolean, revision int"
    return rows.groupBy(*keys).applyInPandasWithState(step, schema, "state binary", "append", "NoTimeout")


def _told(held: IntervalMap) -> set[tuple[str, int, int]]:
    return {("period", a, b) for a, b in held} | {("gap", a, b) for a, b in held.gaps()}


def last_revisions(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, kind, start_us and end_us of what holds after all rows of stream_intervals."""
    by = [*keys, "kind", "start_us", "end_us"]
    return rows.groupBy(*by).agg(F.max_by("live", "revision").alias("live")).where("live").select(*by)


def stream_groups(rows: DataFrame, keys: Sequence[str], at: str, window: str, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType, lateness: str = "10 minutes") -> DataFrame:
    """func on each group of keys and fixed window of `at` once the watermark has passed the window's end.

    The way to unpack packets or to run other functions that need whole groups on a stream. A group's rows are kept in
    state until then; later rows are dropped. func gets a frame with all columns of `rows` and a window_end column.
    """
    df = rows.withWatermark(at, lateness).withColumn("window_end", F.window(at, window)["end"])
    by = [*keys, "window_end"]

    def step(key, frames, state):  # noqa: ANN001, ANN202
        if state.hasTimedOut:
            kept = pd.concat(pickle.loads(state.get[0]), ignore_index=True)
            state.remove()
            yield func(kept)
            return
        parts = pickle.loads(state.get[0]) if state.exists else []
        parts += list(frames)
        state.update((pickle.dumps(parts),))
        state.setTimeoutTimestamp(int(pd.Timestamp(key[-1]).value // 1_000_000))

    return df.groupBy(*by).applyInPandasWithState(step, schema, "state binary", "append", "EventTimeTimeout")
