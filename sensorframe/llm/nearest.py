"""Pairing records of two tables by nearest time for the same entity, within a tolerance."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.groups import sliced, whole_groups
from ..streaming.replay import replay, run_to_end

SLICE_US = 3_600_000_000
STEP = 64  # rows of a slice between two watermarks
NONE = np.iinfo(np.int64).min


class NearestBuffer:
    """The state of one entity: left rows that wait and right rows that may still be nearest to one.

    `advance(watermark)` promises that no later row is earlier than the watermark. It returns the left rows whose
    horizon (time + tolerance) the watermark has passed, each with the nearest right row, and evicts right rows that no
    waiting or future left row can reach. Of equally near right rows the earlier time counts, then the smaller id.
    """

    def __init__(self, tolerance: int):
        self.tolerance = tolerance
        self.lt = self.li = self.rt = self.ri = np.zeros(0, np.int64)

    def add_left(self, times: np.ndarray, ids: np.ndarray) -> None:
        self.lt, self.li = np.concatenate([self.lt, times]), np.concatenate([self.li, ids])

    def add_right(self, times: np.ndarray, ids: np.ndarray) -> None:
        t, i = np.concatenate([self.rt, times]), np.concatenate([self.ri, ids])
        order = np.lexsort((i, t))
        t, i = t[order], i[order]
        first = np.r_[True, t[1:] != t[:-1]] if len(t) else np.zeros(0, bool)  # the smallest id of each time
        self.rt, self.ri = t[first], i[first]

    def advance(self, watermark: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(left ids, right ids) of the rows now decided that have a partner; None: no more rows come."""
        ripe = np.ones(len(self.lt), bool) if watermark is None else self.lt + self.tolerance < watermark
        t, ids = self.lt[ripe], self.li[ripe]
        self.lt, self.li = self.lt[~ripe], self.li[~ripe]
        right = nearest(t, self.rt, self.ri, self.tolerance)
        if watermark is not None:
            keep = self.rt >= min(watermark, self.earliest(watermark)) - self.tolerance
            self.rt, self.ri = self.rt[keep], self.ri[keep]
        found = right != NONE
        return ids[found], right[found]

    def earliest(self, default: int) -> int:
        """The time of the first row that waits."""
        return int(self.lt.min()) if len(self.lt) else default

    def dump(self) -> bytes:
        return pickle.dumps((self.lt, self.li, self.rt, self.ri))

    def restore(self, state: bytes) -> NearestBuffer:
        self.lt, self.li, self.rt, self.ri = pickle.loads(state)
        return self


def nearest(t: np.ndarray, rt: np.ndarray, ri: np.ndarray, tolerance: int) -> np.ndarray:
    """For each time the id of the nearest right time (ascending, distinct) within the tolerance, NONE if there is none."""
    out = np.full(len(t), NONE, np.int64)
    if not len(rt) or not len(t):
        return out
    after = np.searchsorted(rt, t, "left")
    before = after - 1
    far = np.int64(1) << 62
    da = np.where(after < len(rt), rt[np.minimum(after, len(rt) - 1)] - t, far)
    db = np.where(before >= 0, t - rt[np.maximum(before, 0)], far)
    pick = np.where(db <= da, np.maximum(before, 0), np.minimum(after, len(rt) - 1))
    ok = np.minimum(da, db) <= tolerance
    out[ok] = ri[pick[ok]]
    return out


def _pair(batches: Iterator[pa.RecordBatch], tolerance: int) -> Iterator[pa.RecordBatch]:
    """Rows come in order of time within (key, slice); each such group runs through a buffer of its own, STEP rows at a
    time, with the time of the next row as the watermark."""
    for table, starts in whole_groups(batches, ["key", "slice"]):
        at, right, rid = (table.column(c).to_numpy() for c in ("at_us", "is_right", "right_id"))
        ends = np.append(starts[1:], len(at))
        lefts, rights = [], []
        for a, b in zip(starts, ends):
            r = right[a:b]
            if r.all() or not r.any():
                continue
            buffer = NearestBuffer(tolerance)
            for p in range(a, b, STEP):
                q = min(p + STEP, b)
                r = right[p:q]
                buffer.add_left(at[p:q][~r], np.arange(p, q)[~r])
                buffer.add_right(at[p:q][r], rid[p:q][r])
                i, j = buffer.advance(int(at[q]) if q < b else None)
                lefts.append(i)
                rights.append(j)
        if lefts:
            i = np.concatenate(lefts)
            yield pa.RecordBatch.from_arrays([table.column("key").combine_chunks().take(pa.array(i)), pa.array(at[i]), pa.array(np.concatenate(rights))], ["key", "at_us", "right_id"])


def join_nearest(left: DataFrame, right: DataFrame, tolerance_us: int, slice_us: int = SLICE_US) -> DataFrame:
    """left_id and right_id: each left row with the right row of the same key nearest in time, at most `tolerance_us` away.

    Both sides have columns key, id and at_us. Ties: the earlier time, then the smaller id. Rows with a null key, id or
    time have no partner; left rows without one are left out; a right row may serve many. Copies of a time are combined
    before anything else, so they cost one row each and may be any number; left rows get their result by a join in which
    Spark splits skewed keys. Keys are worked on in slices of time, with right rows of `tolerance_us` around them.
    """
    ok = "key is not null and id is not null and at_us is not null"
    left = left.select("key", "id", "at_us")  # extra columns stay out
    times = left.where(ok).groupBy("key", "at_us").agg(F.count(F.lit(1)).alias("n")).select("key", "at_us", F.lit(False).alias("is_right"), F.lit(0).cast("long").alias("right_id"))
    rights = right.where(ok).groupBy("key", "at_us").agg(F.min("id").alias("right_id")).select("key", "at_us", F.lit(True).alias("is_right"), "right_id")
    lefts = times.withColumn("slice", F.floor(F.col("at_us") / slice_us))
    rights = sliced(rights, "at_us", slice_us, tolerance_us, min(tolerance_us + 1, slice_us)).drop("own")
    both = lefts.unionByName(rights).repartition("key", "slice").sortWithinPartitions("key", "slice", "at_us")
    kind = left.schema["key"].dataType.simpleString()
    pairs = both.mapInArrow(lambda b: _pair(b, tolerance_us), f"key {kind}, at_us long, right_id long")
    return left.where(ok).join(pairs, ["key", "at_us"]).select(F.col("id").alias("left_id"), "right_id")


def sensor_side(samples: DataFrame) -> DataFrame:
    """key, id and at_us of unpacked samples."""
    return samples.select(F.col("data_point_metadata.device_id").alias("key"), F.col("row_id").alias("id"), F.unix_micros("measurement_timestamp_utc").alias("at_us"))


def stream_nearest(left: DataFrame, right: DataFrame, tolerance_us: int, lateness: str = "10 minutes", slice_us: int = SLICE_US) -> DataFrame:
    """The same pairing over two streams with columns key, id and at (timestamp)."""
    tag = lambda df, side: df.select("key", "id", "at", F.lit(side).alias("is_right"))
    return stream_pairs(tag(left, False).unionByName(tag(right, True)), tolerance_us, lateness, slice_us)


def stream_pairs(both: DataFrame, tolerance_us: int, lateness: str = "10 minutes", slice_us: int = SLICE_US) -> DataFrame:
    """left_id and right_id over a stream of both sides: key, id, at and is_right.

    Each (key, slice of time) keeps a buffer in state; right rows within the tolerance of a border go to both slices, so a
    hot key is worked on by as many tasks as it has slices. A left row is emitted once the watermark has passed its
    horizon; a timer at the earliest one wakes slices that get no more rows, and a slice leaves the state once no left row
    waits and none can come. Rows behind the watermark are left out. Rows whose horizon the watermark never passes, as
    the last ones of a stream, aren't emitted.
    """
    ok = both.where("key is not null and id is not null and at is not null").select("key", "id", "at", "is_right").withWatermark("at", lateness)
    at, s = F.unix_micros("at"), F.floor(F.unix_micros("at") / slice_us)
    rest = at - s * slice_us
    more = lambda hit, n: F.when(F.col("is_right") & hit, F.array(n)).otherwise(F.array().cast("array<bigint>"))
    rows = ok.withColumn("slice", F.explode(F.concat(F.array(s), more(rest >= slice_us - tolerance_us, s + 1), more(rest <= tolerance_us, s - 1))))

    def step(key, frames, state):  # noqa: ANN001, ANN202
        buffer, mark = NearestBuffer(tolerance_us), state.getCurrentWatermarkMs() * 1000
        if state.exists:
            buffer.restore(state.get[0])
        for f in frames:
            t = f["at"].to_numpy().astype("datetime64[us]").astype(np.int64)
            r, ids = f["is_right"].to_numpy().astype(bool), f["id"].to_numpy()
            fresh = t >= mark
            buffer.add_left(t[~r & fresh], ids[~r & fresh])
            buffer.add_right(t[r & fresh], ids[r & fresh])
        i, j = buffer.advance(mark)
        end = (int(key[1]) + 1) * slice_us  # no left row of the slice is later
        if len(buffer.lt) or (mark < end and len(buffer.rt)):
            state.update((buffer.dump(),))
            horizon = buffer.earliest(end) + tolerance_us
            state.setTimeoutTimestamp(max(horizon // 1000 + 1, mark // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"left_id": i, "right_id": j})

    return rows.groupBy("key", "slice").applyInPandasWithState(step, "left_id long, right_id long", "state binary", "append", "EventTimeTimeout")


def replay_nearest(left: DataFrame, right: DataFrame, tolerance_us: int, steps: int = 4) -> DataFrame:
    """join_nearest by stream_pairs over both tables (key, id, at_us) replayed in order of time. A row of no entity a day
    after all others lets the watermark pass the last horizons."""
    tag = lambda df, side: df.select("key", "id", F.timestamp_micros("at_us").alias("at"), F.lit(side).alias("is_right"))
    both = tag(left, False).unionByName(tag(right, True)).where("key is not null and id is not null and at is not null")
    last = both.agg(F.max("at").alias("at")).where("at is not null")
    end = last.select(F.lit("").cast(both.schema["key"].dataType).alias("key"), F.lit(-1).cast("long").alias("id"), (F.col("at") + F.expr("interval 1 day")).alias("at"), F.lit(True).alias("is_right"))
    return run_to_end(stream_pairs(replay(both.unionByName(end), F.col("at"), steps), tolerance_us), "nearest").drop("batch")
