"""Spikes, stuck values and impossible readings, judged by each source's own behaviour."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.groups import sliced, whole_groups

SLICE_US = 2 * 3_600_000_000
NEAR_US = 180_000_000  # "shortly before and after"
#: Periods a source may repeat itself in, s: cycles of sampling, reporting and breathing by the clock.
PERIODS = (10, 15, 20, 30, 45, 60, 90, 120, 180, 300, 600, 900)
PHASES = 12  # of a period
SIDE = 5  # readings on either side that make the trend
ROUNDS = 3
ALPHA = 0.05  # level of the outlier test
RATIO = 10.0  # a case departs by more than so many usual variations
STUCK = 8  # successive distinct times with the same value
#: The sensors' ranges.
RANGES = {"imu": (-32768.0, 32767.0), "eda": (0.0, 1048575.0)}
#: The median of |difference of neighbours| of normal noise, in units of its standard deviation.
MEDIAN_DIFFERENCE = 0.6744897501960817 * math.sqrt(2)


@lru_cache(maxsize=1 << 14)
def esd_limits(n: int, most: int, alpha: float = ALPHA) -> np.ndarray:
    """Critical values of the generalised extreme studentised deviate test for the 1st to `most`-th outlier of n.

    Student's quantiles come from the normal ones by the Cornish-Fisher expansion.
    """
    i = np.arange(1, most + 1)
    v = np.maximum(n - i - 1, 5).astype(float)
    z = np.array([NormalDist().inv_cdf(1 - alpha / (2 * max(n - k + 1, 2))) for k in i])
    t = z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2)
    m = np.maximum(n - i, 5)
    return m * t / np.sqrt((v + t**2) * (m + 1))


def esd_outliers(rest: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Which residuals are outliers by the generalised ESD test with a robust scale.

    The greatest residual goes first; the scale (the median absolute residual, as residuals centre on 0 by construction)
    is taken again of what is left after each removal, up to half of them. The outliers are all up to the last one beyond
    its limit. A scale of 0 puts every other residual beyond.
    """
    flags = np.zeros(len(rest), bool)
    n = len(rest)
    if n < 5:
        return flags
    order = np.argsort(np.abs(rest), kind="stable")
    size = np.abs(rest)[order]
    most = n // 2
    left = n - np.arange(most)  # how many are left before each removal
    scale = 1.4826 * (size[(left - 1) // 2] + size[left // 2]) / 2
    top = size[left - 1]
    beyond = np.flatnonzero((top > 0) & (top > esd_limits(n, most, alpha) * scale))
    if len(beyond):
        flags[order[n - 1 - beyond[-1] :]] = True
    return flags


def level_beside(at: np.ndarray, v: np.ndarray, group: np.ndarray, usable: np.ndarray, direction: int) -> np.ndarray:
    """The median of up to SIDE usable readings at times before (direction -1) or after (1) each reading, within NEAR_US;
    NaN if none. Of usable readings each time has one."""
    idx = np.flatnonzero(usable)
    if not len(idx):
        return np.full(len(v), np.nan)
    here = np.arange(len(v))
    new = np.r_[True, (at[1:] != at[:-1]) | (group[1:] != group[:-1])]
    head = np.maximum.accumulate(np.where(new, here, 0))  # the first reading of the same time
    tail = np.append(np.flatnonzero(new)[1:], len(v))[np.cumsum(new) - 1] - 1
    base = np.searchsorted(idx, head, "left") - 1 if direction < 0 else np.searchsorted(idx, tail, "right")
    near = np.full((SIDE, len(v)), np.nan)
    for k in range(SIDE):
        j = base + direction * k
        ok = (j >= 0) & (j < len(idx))
        p = idx[np.clip(j, 0, len(idx) - 1)]
        ok &= (group[p] == group) & (np.abs(at[p] - at) <= NEAR_US)
        near[k, ok] = v[p[ok]]
    count = (~np.isnan(near)).sum(0)
    near.sort(0)  # NaNs go last
    low, high = np.maximum((count - 1) // 2, 0), np.maximum(count // 2, 0)
    out = (near[np.minimum(low, SIDE - 1), here] + near[np.minimum(high, SIDE - 1), here]) / 2
    return np.where(count > 0, out, np.nan)


def medians(code: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes in order, median of the values of each, how many)."""
    order = np.lexsort((v, code))
    c, r = code[order], v[order]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, int)
    n = np.diff(np.append(first, len(c)))
    return c[first], (r[first + (n - 1) // 2] + r[first + n // 2]) / 2, n


def season(at: np.ndarray, v: np.ndarray, group: np.ndarray, usable: np.ndarray, period: np.ndarray) -> np.ndarray:
    """A robust seasonal part: by phase of the source's period (us; 0: none), the median of the readings less the median
    of their own cycle, joined by straight lines; 0 in groups whose pattern doesn't stand out of the error of its medians."""
    out = np.zeros(len(v))
    ok = usable & (period > 0)
    if not ok.any():
        return out
    long = np.maximum(period, 1)
    _, where = np.unique(np.stack([group[ok], at[ok] // long[ok]]), axis=1, return_inverse=True)
    where = where.ravel()
    rest = v[ok] - medians(where, v[ok])[1][where]
    place = at % long / long * PHASES
    table, counts = np.zeros((group.max() + 1) * PHASES), np.zeros((group.max() + 1) * PHASES)
    c, middle, n = medians(group[ok] * PHASES + place[ok].astype(int), rest)
    table[c], counts[c] = middle, n
    table, counts = table.reshape(-1, PHASES), counts.reshape(-1, PHASES)
    unit = np.zeros(len(table))
    g, spread, _ = medians(group[ok], np.abs(rest))
    unit[g] = 1.4826 * spread
    seen = counts > 0
    error2 = (1.5708 * unit[:, None] ** 2 / np.maximum(counts, 1) * seen).sum(1)  # of all phases' medians together
    table[~(((table**2).sum(1) > 9 * error2) & (seen.sum(1) > PHASES // 2))] = 0
    left = np.floor(place - 0.5).astype(int)
    part = place - 0.5 - left
    return np.where(period > 0, (1 - part) * table[group, left % PHASES] + part * table[group, (left + 1) % PHASES], 0)


def decompose(at: np.ndarray, v: np.ndarray, group: np.ndarray, usable: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rest, between): the residuals of a robust seasonal-trend decomposition, and which lie between the levels beside.

    The season is taken off first; then each reading's rest is its distance from the nearer of the levels before and
    after it, so a lasting change of level leaves none.
    """
    plain = v - season(at, v, group, usable, period)
    before, after = level_beside(at, plain, group, usable, -1), level_beside(at, plain, group, usable, 1)
    low, high = np.fmin(before, after), np.fmax(before, after)
    a, b = np.abs(plain - before), np.abs(plain - after)
    rest = np.where(np.isnan(b) | (a <= b), plain - before, plain - after)
    return rest, (plain >= low) & (plain <= high)


def spike_flags(at: np.ndarray, v: np.ndarray, group: np.ndarray, scale: np.ndarray, usable: np.ndarray, again: np.ndarray, period: np.ndarray, ratio: float | None = RATIO) -> np.ndarray:
    """Which readings are spikes. at ascends within each group; scale is the source's usual variation.

    Residuals beyond the ESD limits of their group are outliers, unless they lie between the levels beside them. They
    leave the levels and the season, and the decomposition is repeated. Of the outliers those are spikes that depart by
    more than `ratio` usual variations (None: all), alone or two in a row. `again` marks further values of a time: they
    are judged like others, but levels and rows of outliers go by the first value of each time.
    """
    flags = np.zeros(len(v), bool)
    series = usable & ~again
    with np.errstate(all="ignore"):
        for _ in range(ROUNDS):
            rest, between = decompose(at, v, group, series & ~flags, period)
            judged = usable & ~np.isnan(rest)
            idx = np.flatnonzero(judged)
            new = np.zeros(len(v), bool)
            cut = np.flatnonzero(np.r_[True, group[idx][1:] != group[idx][:-1]]) if len(idx) else []
            for a, b in zip(cut, np.append(cut, len(idx))[1:]):
                own = idx[a:b]
                new[own] = esd_outliers(rest[own])
            new &= ~between
            if ratio is not None:
                size = np.abs(rest) / scale
                new &= np.nan_to_num(size, nan=0.0, posinf=0.0) > ratio
            if (new == flags).all():
                break
            flags = new
    idx = np.flatnonzero(series)
    f = flags[idx]
    cut = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (group[idx][1:] != group[idx][:-1])]) if len(idx) else np.zeros(0, int)
    length = np.diff(np.append(cut, len(idx)))
    flags[idx] = f & np.repeat(length <= 2, length)
    return flags


_OUT = pa.schema([("signal", pa.string()), ("device_id", pa.string()), ("slice", pa.int64()), ("kind", pa.int32()), ("value", pa.float64()), ("length", pa.int64()), ("times", pa.list_(pa.int64()))])
OUT = "signal string, device_id string, slice long, kind int, value double, length long, times array<long>"
FLAGGED, FIRST, LAST, WHOLE = 0, 1, 2, 3


def _judge(batches: Iterator[pa.RecordBatch], ranges: Mapping[str, tuple[float, float]], ratio: float | None) -> Iterator[pa.RecordBatch]:
    for table, starts in whole_groups(batches, ["signal", "device_id", "slice"]):
        at, v = table.column("at_us").to_numpy(), table.column("value").to_numpy()
        own, scale = table.column("own").to_numpy(), table.column("scale").to_numpy()
        signal, device = table.column("signal").combine_chunks(), table.column("device_id").combine_chunks()
        number = table.column("slice").to_numpy()
        n = len(v)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        lo, hi = (np.array([ranges[s][k] for s in signal.take(pa.array(starts)).to_pylist()])[group] for k in (0, 1))
        inside = (v >= lo) & (v <= hi)
        again = np.r_[False, (at[1:] == at[:-1]) & (group[1:] == group[:-1])]  # another value at the same time
        flags = spike_flags(at, v, group, scale, inside, again, table.column("period").to_numpy(), ratio)
        rows = [(i, FLAGGED, v[i], 1, [at[i]]) for i in np.flatnonzero(flags & own)]
        # runs, over own readings; the halo belongs to other slices
        mine = np.flatnonzero(own & ~again)
        if len(mine):
            g, x = group[mine], v[mine]
            cut = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (x[1:] != x[:-1])])
            size = np.diff(np.append(cut, len(mine)))
            opens = np.r_[True, g[cut][1:] != g[cut][:-1]]
            closes = np.r_[opens[1:], True]
            for k in np.flatnonzero((size >= STUCK) | opens | closes):
                i, times = mine[cut[k]], at[mine[cut[k] : cut[k] + size[k]]]
                if size[k] >= STUCK:
                    rows.append((i, FLAGGED, x[cut[k]], size[k], times))
                if opens[k] or closes[k]:
                    rows.append((i, WHOLE if opens[k] and closes[k] else FIRST if opens[k] else LAST, x[cut[k]], size[k], times if size[k] < STUCK else []))
        if rows:
            at_row = pa.array([r[0] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [signal.take(at_row).cast(pa.string()), device.take(at_row).cast(pa.string()), pa.array(number[[r[0] for r in rows]]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64()), pa.array([int(r[3]) for r in rows], pa.int64()), pa.array([[int(x) for x in r[4]] for r in rows], pa.list_(pa.int64()))],
                schema=_OUT,
            )


def source_behaviour(series: DataFrame, periods: Sequence[int] = PERIODS) -> DataFrame:
    """signal, device_id, scale and period: each source's usual variation, and the period (us; 0: none) it repeats itself in.

    The scale comes from the median change between neighbouring readings of a slice, by a mergeable sketch; equal
    neighbours are left out, so stuck sensors don't look quiet. The period is that of `periods` (s) in which the directions
    of change have the greatest power, if that is beyond three times what it is without any period; the power of each
    slice is added up over the source. Both are combined before the shuffle.
    """
    w = Window.partitionBy("signal", "device_id", "slice").orderBy("at_us", "value")
    d = series.where("own").select("signal", "device_id", "slice", "at_us", (F.col("value") - F.lag("value").over(w)).alias("d"), (F.col("at_us") - F.lag("at_us").over(w)).alias("dt"))
    d = d.where("d <> 0 and dt > 0").withColumn("_t", (F.col("at_us") - F.col("dt") / 2) / 1_000_000)
    sums = []
    for p in periods:
        angle = F.col("_t") * (2 * math.pi / p)
        sums += [F.sum(F.signum("d") * F.cos(angle)).alias(f"c{p}"), F.sum(F.signum("d") * F.sin(angle)).alias(f"s{p}")]
    slices = d.groupBy("signal", "device_id", "slice").agg(F.count(F.lit(1)).alias("n"), *sums)
    power = [F.struct((F.sum(F.col(f"c{p}") ** 2 + F.col(f"s{p}") ** 2) / F.sum("n")).alias("power"), F.lit(p * 1_000_000).cast("long").alias("period")) for p in periods]
    by_source = slices.groupBy("signal", "device_id").agg(F.array_max(F.array(*power)).alias("best"))
    scale = d.groupBy("signal", "device_id").agg((F.percentile_approx(F.abs("d"), 0.5, 1000) / MEDIAN_DIFFERENCE).alias("scale"))
    period = F.when(F.col("best.power") > 3, F.col("best.period")).otherwise(F.lit(0).cast("long"))
    return scale.join(by_source.select("signal", "device_id", period.alias("period")), ["signal", "device_id"])


def implausible(rows: DataFrame, ranges: Mapping[str, tuple[float, float]] = RANGES, slice_us: int = SLICE_US, ratio: float | None = RATIO) -> DataFrame:
    """signal and row_id of implausible readings. `rows`: signal, row_id, device_id, at_us, value.

    Cases: values outside the signal's range (infinite ones too); all rows of STUCK or more successive distinct times
    with the same value; spikes (see spike_flags), with ratio None all outliers of the test. Rows with null device, time
    or value, or NaN, don't count. Rows that repeat a time and value are judged alike, however many they are; of several
    values at one time the least makes the series, and each is judged. A source without two differing readings has no
    usual variation and no spikes beyond `ratio` of it; one sampled less often than every NEAR_US has nothing shortly
    before and after, so no spikes. Empty tables give no rows.

    Copies are combined before the shuffle; a source is worked on in slices of time with the readings around them, and
    runs across slices are put together from the first and last run of each slice.
    """
    rows = rows.select("signal", "row_id", "device_id", "at_us", "value")
    ok = rows.where("signal is not null and device_id is not null and at_us is not null and value is not null and not isnan(value)")
    series = sliced(ok.groupBy("signal", "device_id", "at_us", "value").agg(F.count(F.lit(1)).alias("copies")).drop("copies"), "at_us", slice_us, NEAR_US * (ROUNDS + 1))
    series = series.repartition("signal", "device_id", "slice")
    scaled = series.join(source_behaviour(series), ["signal", "device_id"], "left").withColumns({"scale": F.coalesce("scale", F.lit(float("inf"))), "period": F.coalesce("period", F.lit(0).cast("long"))})
    parts = scaled.select("signal", "device_id", "slice", "at_us", "value", "own", "scale", "period").repartition("signal", "device_id", "slice").sortWithinPartitions("signal", "device_id", "slice", "at_us", "value")
    judged = parts.mapInArrow(lambda b: _judge(b, ranges, ratio), OUT)

    # Border runs of a device in order; FLAGGED rows get a window group of their own.
    loose = F.when(F.col("kind") == FLAGGED, F.xxhash64("slice", "times")).otherwise(F.lit(None))
    side = F.when(F.col("kind") == LAST, 1).otherwise(0)
    w = Window.partitionBy("signal", "device_id", "loose").orderBy("slice", "side")
    joined = (F.lag("value").over(w) == F.col("value")) & (F.col("side") == 0)
    runs = judged.withColumns({"loose": loose, "side": side}).withColumn("fresh", F.when(joined & (F.col("kind") != FLAGGED), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("fresh").over(w)).withColumn("total", F.sum("length").over(Window.partitionBy("signal", "device_id", "loose", "run")))
    found = runs.where((F.col("kind") == FLAGGED) | (F.col("total") >= STUCK)).select("signal", "device_id", F.explode("times").alias("at_us"), "value").distinct()
    # found is distinct, so an inner join is a semi join; Spark would run a semi join once for each part of a union
    by_series = ok.join(found, ["signal", "device_id", "at_us", "value"]).select("signal", "row_id")

    out_of_range = F.lit(False)
    for s, (lo, hi) in ranges.items():
        out_of_range |= (F.col("signal") == s) & ((F.col("value") < lo) | (F.col("value") > hi))
    return by_series.union(ok.where(out_of_range).select("signal", "row_id")).distinct()


def sensor_rows(imu: DataFrame, eda: DataFrame) -> DataFrame:
    """acceleration_x of IMU samples and raw_adc of EDA samples as rows for `implausible`."""
    parts = [df.select(F.lit(s).alias("signal"), "row_id", F.col("data_point_metadata.device_id").alias("device_id"), F.unix_micros("measurement_timestamp_utc").alias("at_us"), F.col(c).cast("double").alias("value")) for df, s, c in ((imu, "imu", "acceleration_x"), (eda, "eda", "raw_adc"))]
    return parts[0].unionByName(parts[1])
