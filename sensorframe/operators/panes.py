"""Per-period aggregates by event time, corrected as late records arrive, up to a cut-off.

Stream slicing: events fall into panes, the non-overlapping slices between the borders of all windows. A pane holds
partial aggregates, split by whether the event came before or after publication and closing of each window over it. A
late event thus touches one pane, and only the windows that cover this pane are put together again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


@dataclass(frozen=True)
class PaneSpec:
    """Windows of `size` every `slide`, published `publish` after their end, closed `close` after their end (all us)."""

    size: int = HOUR_US
    slide: int = HOUR_US
    publish: int = HOUR_US
    close: int = 48 * HOUR_US

    def __post_init__(self) -> None:
        if min(self.size, self.slide) <= 0 or not 0 <= self.publish <= self.close:
            raise ValueError("size and slide must be positive, and publication must not follow closing")

    @property
    def pane(self) -> int:
        return math.gcd(self.size, self.slide)


def pane_partials(events: DataFrame, keys: Sequence[str], spec: PaneSpec, event: str, arrival: str, count: Column, total: Column, gone: int | None = None) -> DataFrame:
    """One row for each key, pane and class of lateness: columns _pane, _first, _last (covering windows' numbers), _published
    and _closed (the highest window number already published or closed when the events came), _events, _n, _total and _seen
    (the greatest arrival). Windows up to number `gone` count as closed whenever the events came."""
    df = events.select(*keys, F.col(event).alias("_event"), F.col(arrival).alias("_arrival"), count.alias("_n"), total.alias("_total"))
    start = F.floor(F.col("_event") / spec.pane) * spec.pane
    df = df.withColumns({"_last": F.floor(start / spec.slide), "_first": F.floor((start - spec.size) / spec.slide) + 1, "_pane": start})

    def reached(delay: int) -> Column:  # bounded by the windows over the pane, so few classes exist
        m = F.floor((F.col("_arrival") - spec.size - delay) / spec.slide)
        return F.greatest(F.col("_first") - 1, F.least(F.col("_last"), m))

    closed = reached(spec.close)
    df = df.withColumns({"_published": reached(spec.publish), "_closed": closed if gone is None else F.greatest(closed, F.least(F.col("_last"), F.lit(gone).cast("long")))})
    by = [*keys, "_pane", "_first", "_last", "_published", "_closed"]
    return df.where("_first <= _last").groupBy(*by).agg(F.count(F.lit(1)).alias("_events"), F.sum("_n").alias("_n"), F.sum("_total").alias("_total"), F.max("_arrival").alias("_seen"))


def compose_windows(partials: DataFrame, keys: Sequence[str], spec: PaneSpec) -> DataFrame:
    """Windows from panes. Columns: keys, window_start_us, n_initial, total_initial (as published), n_final, total_final
    (as closed), late_events (that corrected the window) and dropped_events (past the cut-off)."""
    df = partials.withColumn("_window", F.explode(F.sequence("_first", "_last")))
    late, dropped = F.col("_published") >= F.col("_window"), F.col("_closed") >= F.col("_window")

    def total(c: str, keep: Column) -> Column:
        return F.sum(F.when(keep, F.col(c)).otherwise(F.lit(0)))

    return (
        df.groupBy(*keys, "_window")
        .agg(
            total("_n", ~late).alias("n_initial"), total("_total", ~late).alias("total_initial"), total("_n", ~dropped).alias("n_final"), total("_total", ~dropped).alias("total_final"),
            total("_events", late & ~dropped).alias("late_events"), total("_events", dropped).alias("dropped_events"),
        )
        .select(*keys, (F.col("_window") * spec.slide).alias("window_start_us"), "n_initial", "total_initial", "n_final", "total_final", "late_events", "dropped_events")
    )


def late_corrected(events: DataFrame, keys: Sequence[str], spec: PaneSpec, event: str, arrival: str, count: Column, total: Column) -> DataFrame:
    """Aggregates of each window of `spec` by event time, as published and as corrected until closing.

    `count` and `total` are what an event adds, so a redelivered reading can take back its former value. Events with a
    null time are left out; null keys form their own group; a null `total` adds nothing. An empty table gives no rows.
    Two shuffles of partial aggregates; a hot key is combined on the map side and never gathered.
    """
    events = events.where(F.col(event).isNotNull() & F.col(arrival).isNotNull())
    return compose_windows(pane_partials(events, keys, spec, event, arrival, count, F.coalesce(total, F.lit(0.0))), keys, spec)


def period_events(effective: DataFrame) -> DataFrame:
    """device_id, measured_us, arrival_us, n and total: what each effective row with a device adds to its period; a changed
    reading takes back its former value."""
    total = F.coalesce("rate", F.lit(0.0)) - F.when(F.col("is_first"), 0.0).otherwise(F.coalesce("previous_rate", F.lit(0.0)))
    return effective.where("device_id is not null").select("device_id", "measured_us", "arrival_us", F.when(F.col("is_first"), 1).otherwise(0).alias("n"), total.alias("total"))


def corrected_periods(effective: DataFrame, spec: PaneSpec = PaneSpec()) -> DataFrame:
    """Hourly counts and totals of `rate` per device over effective rows."""
    return late_corrected(period_events(effective), ["device_id"], spec, "measured_us", "arrival_us", F.col("n"), F.col("total"))


def period_outcomes(periods: DataFrame) -> DataFrame:
    """device_id, period_start_ms and outcome of each period that late rows corrected or missed."""
    kinds = F.array(F.when(F.col("late_events") > 0, F.lit("corrected")), F.when(F.col("dropped_events") > 0, F.lit("dropped")))
    return periods.select("device_id", F.floor(F.col("window_start_us") / 1000).alias("period_start_ms"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("outcome"))
