"""Irregular readings on a regular grid, with missing slots imputed and marked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.groups import sliced, whole_groups

SLOT_US, PAUSE_US = 5_000_000, 120_000_000
SLICE_SLOTS, CONTEXT_SLOTS = 720, 60


def ssa_impute(values: np.ndarray, window: int = 24, rank: int = 3, tolerance: float = 1e-3, rounds: int = 200) -> tuple[np.ndarray, bool]:
    """A copy of `values` with its NaNs imputed by iterative singular-spectrum analysis, and whether it has converged.

    The series is embedded in a Hankel matrix of up to `window` rows (half the series where it is shorter); its `rank`
    leading singular vectors, at most half of the rows and no more than stand out of noise (by the hard threshold on the
    median singular value, but at least one), give a smooth version (by averaging along antidiagonals), whose values replace the missing ones until they change by less than `tolerance` of the series' spread. It starts from
    linear interpolation. After `rounds` the values so far come out as not converged. Series without any value stay as
    they are; so do those of fewer than four slots after their interpolation, which have no trajectory of two rows.
    """
    missing = np.isnan(values)
    if not missing.any() or missing.all():
        return values.copy(), True
    at = np.arange(len(values))
    x = values.copy()
    x[missing] = np.interp(at[missing], at[~missing], values[~missing])
    n, w = len(x), min(window, len(x) // 2)
    centre, spread = x[~missing].mean(), x[~missing].std()
    if w < 2 or spread == 0:
        return x, True
    index = np.arange(w)[:, None] + np.arange(n - w + 1)[None, :]
    flat = index.ravel()
    times = np.bincount(flat, minlength=n)
    b = w / (n - w + 1)
    cut = (0.56 * b**3 - 0.95 * b**2 + 1.82 * b + 1.43) ** 2  # of the squared median singular value
    for _ in range(rounds):
        h = (x - centre)[index]
        squares, vectors = np.linalg.eigh(h @ h.T)  # of the singular values of h, ascending, and its left singular vectors
        clear = int((squares > cut * max(np.median(squares), 0)).sum())
        vectors = vectors[:, -max(1, min(rank, (w + 1) // 2, clear)) :]
        smooth = np.bincount(flat, (vectors @ (vectors.T @ h)).ravel(), minlength=n) / times + centre
        change = np.abs(smooth[missing] - x[missing]).max()
        x[missing] = smooth[missing]
        if change < tolerance * spread:
            return x, True
    return x, False


def _impute(batches: Iterator[pa.RecordBatch], pause: int, slice_slots: int) -> Iterator[pa.RecordBatch]:
    for table, starts in whole_groups(batches, ["key", "slice"]):
        slot, first, last = (table.column(c).to_numpy() for c in ("slot", "first_us", "last_us"))
        mean, number = table.column("mean").to_numpy(), table.column("slice").to_numpy()
        keys = table.column("key").combine_chunks()
        ends = np.append(starts[1:], len(slot))
        group = np.repeat(np.arange(len(starts)), ends - starts)
        joined = np.zeros(len(slot), bool)  # to the reading slot before
        joined[1:] = (group[1:] == group[:-1]) & (first[1:] - last[:-1] <= pause)
        heads = np.flatnonzero(~joined)
        tails = np.append(heads[1:], len(slot))
        out_key, out_slot, out_value, out_filled, out_ok = [], [], [], [], []
        for a, b in zip(heads, tails):
            s0 = slot[a]
            series = np.full(slot[b - 1] - s0 + 1, np.nan)
            series[slot[a:b] - s0] = mean[a:b]
            lo, hi = number[a] * slice_slots - s0, (number[a] + 1) * slice_slots - s0  # the slice's own slots
            lo, hi = max(lo, 0), min(hi, len(series))
            if lo >= hi:
                continue
            filled, converged = np.isnan(series), True
            if filled[lo:hi].any():
                series, converged = ssa_impute(series)
            out_key.append(np.full(hi - lo, a))
            out_slot.append(np.arange(lo, hi) + s0)
            out_value.append(series[lo:hi])
            out_filled.append(filled[lo:hi])
            out_ok.append(np.full(hi - lo, converged))
        if out_key:
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(np.concatenate(out_key))), pa.array(np.concatenate(out_slot)), pa.array(np.concatenate(out_value)), pa.array(np.concatenate(out_filled)), pa.array(np.concatenate(out_ok))], ["key", "slot", "value", "filled", "converged"]
            )


def regular_grid(readings: DataFrame, key: str, at: str, value: str, slot_us: int = SLOT_US, pause_us: int = PAUSE_US) -> DataFrame:
    """A regular series per `key`: columns key, slot_start_us, value, filled, converged.

    Slots of `slot_us`, aligned to the epoch, hold the mean of their readings. Between consecutive readings at most
    `pause_us` apart, slots without reading are imputed (see ssa_impute) and marked filled; a longer pause ends the
    series. converged is false where the imputation of the slot's slice had not settled. Readings with null key, time or value, or NaN, don't count; repeated readings only weigh more in a mean; an
    empty table gives no rows.

    Readings are combined into slots before the shuffle. Slices of an hour, with the slots around them, go through
    numpy, so no key is ever gathered.
    """
    ok = readings.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    slots = ok.groupBy(F.col(key).alias("key"), F.floor(F.col(at) / slot_us).alias("slot")).agg(F.avg(value).alias("mean"), F.min(at).alias("first_us"), F.max(at).alias("last_us"))
    halo = max(CONTEXT_SLOTS, pause_us // slot_us + 1)
    size = max(SLICE_SLOTS, halo)
    parts = sliced(slots, "slot", size, halo).drop("own").repartition("key", "slice").sortWithinPartitions("key", "slice", "slot")
    grid = parts.mapInArrow(lambda b: _impute(b, pause_us, size), f"key {slots.schema['key'].dataType.simpleString()}, slot long, value double, filled boolean, converged boolean")
    return grid.select(F.col("key").alias(key), (F.col("slot") * slot_us).alias("slot_start_us"), "value", "filled", "converged")


def ppg_readings(ppg: DataFrame) -> DataFrame:
    """device_id, at_us and green of unpacked PPG samples."""
    return ppg.select(F.col("data_point_metadata.device_id").alias("device_id"), F.unix_micros("measurement_timestamp_utc").alias("at_us"), "green")


def filled_slots(ppg: DataFrame) -> DataFrame:
    """device_id and slot_start_ms of the imputed slots of each device's five-second series."""
    g = regular_grid(ppg_readings(ppg), "device_id", "at_us", "green")
    return g.where("filled").select("device_id", F.floor(F.col("slot_start_us") / 1000).alias("slot_start_ms"))


def held_out(readings: DataFrame, key: str, at: str, value: str, share: int = 10, slot_us: int = SLOT_US) -> DataFrame:
    """Readings without those of about one slot in `share` (by hash), and these slots' true means beside the imputed ones:
    columns key, slot_start_us, true, imputed, line (the straight line between the slots beside it)."""
    ok = readings.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value)).withColumn("_slot", F.floor(F.col(at) / slot_us))
    out = F.pmod(F.xxhash64(key, "_slot"), F.lit(share)) == 0
    truth = ok.where(out).groupBy(key, (F.col("_slot") * slot_us).alias("slot_start_us")).agg(F.avg(value).alias("true"))
    g = regular_grid(ok.where(~out).drop("_slot"), key, at, value, slot_us)
    w = Window.partitionBy(key, F.floor(F.col("slot_start_us") / (SLICE_SLOTS * slot_us))).orderBy("slot_start_us")
    real = F.when(~F.col("filled"), F.struct("slot_start_us", "value"))
    g = g.withColumns({"_a": F.last(real, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_b": F.first(real, True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    line = F.col("_a.value") + (F.col("_b.value") - F.col("_a.value")) * (F.col("slot_start_us") - F.col("_a.slot_start_us")) / (F.col("_b.slot_start_us") - F.col("_a.slot_start_us"))
    return g.where("filled").select(key, "slot_start_us", F.col("value").alias("imputed"), line.alias("line")).join(truth, [key, "slot_start_us"])
