"""Pairing by nearest time against brute force, in batch and as a stream."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sensorframe.llm import nearest as N

SIDE = "key string, id long, at_us long, right_id int"


def brute(left, right, tolerance):
    out = {}
    for k, i, t, *_ in left:
        near = [(abs(t - u), u, j) for q, j, u, *_ in right if None not in (k, i, t, q, j, u) and q == k and abs(t - u) <= tolerance] if t is not None else []
        if near:
            out[i] = min(near)[2]
    return out


@pytest.mark.parametrize("slice_us", [60, 61, 1000])
def test_join_nearest(spark, slice_us):
    r = random.Random(slice_us)
    side = lambda n, base: [(r.choice(["a", "a", "b", None]), base + i, r.choice([None, *range(-50, 400)]), 7) for i in range(n)]
    left, right = side(300, 0), side(200, 1000)
    right += [(k, i + 500, t, x) for k, i, t, x in right[:40]]  # same times, greater ids
    left += [(k, i + 500, t, x) for k, i, t, x in left[:40]]
    got = {x.left_id: x.right_id for x in N.join_nearest(spark.createDataFrame(left, SIDE), spark.createDataFrame(right, SIDE), 20, slice_us).collect()}
    assert got == brute(left, right, 20)


def test_empty_and_copies(spark):
    none, some = spark.createDataFrame([], SIDE), spark.createDataFrame([("a", i, 5, 1) for i in range(3000)], SIDE)
    assert N.join_nearest(none, some, 5).count() == 0 and N.join_nearest(some, none, 5).count() == 0
    assert {x.right_id for x in N.join_nearest(some, some, 5).collect()} == {0} and N.join_nearest(some, some, 5).count() == 3000


@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60)), max_size=60), st.integers(0, 9), st.integers(1, 15))
@settings(max_examples=150, deadline=None)
def test_buffer_decides_as_a_whole_table_does(rows, tolerance, step):
    """Rows come up to `step` late; the watermark follows. Each left row comes out once, with its true partner."""
    rows = [(side, t, i) for i, (side, t) in enumerate(rows)]
    arrivals = sorted(rows, key=lambda x: (x[1] // step, x[2]))
    buffer, out = N.NearestBuffer(tolerance), {}
    for n, (side, t, i) in enumerate(arrivals):
        (buffer.add_right if side else buffer.add_left)(np.array([t]), np.array([i]))
        left, right = buffer.advance(min([x[1] for x in arrivals[n + 1 :]], default=t))
        assert not set(left) & out.keys()
        out.update(zip(left.tolist(), right.tolist()))
        buffer = N.NearestBuffer(tolerance).restore(buffer.dump())
    left, right = buffer.advance(None)
    out.update(zip(left.tolist(), right.tolist()))
    assert out == brute([("k", i, t) for side, t, i in rows if not side], [("k", i, t) for side, t, i in rows if side], tolerance)


def test_stream_nearest(spark, tmp_path):
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    at = lambda s: t0 + timedelta(seconds=s)
    left = [[("d", 1, at(10)), ("e", 2, at(11))], [("d", 3, at(12)), (None, 9, at(12))], [("d", 4, at(5000))], [("d", 5, at(9000))]]
    right = [[("d", 101, at(13))], [("d", 102, at(11.5)), ("e", 103, at(11.9))], [("d", 104, at(5001))], [("z", 105, at(9000))]]
    schema = "key string, id long, at timestamp"
    for name, parts in (("l", left), ("r", right)):
        for i, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/b{i}")
    read = lambda n: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{n}")
    out = []
    q = N.stream_nearest(read("l"), read("r"), 2_000_000, "1 minute").writeStream.option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda df, n: out.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(out)[:4] == [(1, 102), (2, 103), (3, 102), (4, 104)]


def test_slices_pass_a_watermark(monkeypatch):
    import pyarrow as pa

    r = np.random.default_rng(11)
    at = np.sort(r.integers(0, 5000, 800))
    side = r.random(800) < 0.5
    batch = pa.RecordBatch.from_pydict({"key": ["d"] * 800, "slice": [0] * 800, "at_us": at, "is_right": side, "right_id": np.where(side, np.arange(800), 0)})
    pairs = lambda: sorted(x for b in N._pair(iter([batch]), 20) for x in zip(b["at_us"].to_pylist(), b["right_id"].to_pylist()))
    whole, held, advance = pairs(), [], N.NearestBuffer.advance

    def watched(self, watermark):
        out = advance(self, watermark)
        held.append((watermark, len(self.lt) + len(self.rt)))
        return out

    monkeypatch.setattr(N, "STEP", 7)
    monkeypatch.setattr(N.NearestBuffer, "advance", watched)
    assert pairs() == whole and len(whole) > 300
    assert len(held) == 115 and held[-1][0] is None and max(n for _, n in held) < 40
