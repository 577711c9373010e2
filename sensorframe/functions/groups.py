"""Whole groups out of Arrow batches, and time slices that make hot keys divisible."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Indexes at which a new group of equal, neighbouring keys begins."""
    n = table.num_rows
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for k in keys:
        c = table.column(k).combine_chunks()
        x = c.to_numpy(zero_copy_only=False) if pa.types.is_integer(c.type) and not c.null_count else c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], least: int = 50_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of at least about `least` rows that hold whole groups only, with the groups' starts.

    The rows must come clustered by `keys`. A group is held in memory, so keys should include a slice of bounded size.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held)
        starts = group_starts(t, keys)
        cut = int(starts[-1])
        if cut:
            yield t.slice(0, cut), starts[:-1]
            rest = t.slice(cut)
            held, rows = rest.to_batches(), rest.num_rows
    if held:
        t = pa.Table.from_batches(held)
        if t.num_rows:
            yield t, group_starts(t, keys)


def sliced(df: DataFrame, at: str, slice_len: int, halo: int, halo_after: int | None = None) -> DataFrame:
    """Adds `slice` (at // slice_len) and `own`; rows within `halo` of a border also appear, not own, in the slice beyond.

    A slice sees `halo` before its start and `halo_after` (default: as much) after its end. Both must not exceed
    slice_len. Slices, not keys, bound what a task holds, so a key that owns a third of all rows is split in time.
    """
    after = halo if halo_after is None else halo_after
    if max(halo, after) > slice_len:
        raise ValueError("a halo must not exceed the slice")
    c, s = F.col(at), F.floor(F.col(at) / slice_len)
    rest: Column = c - s * slice_len
    own = F.array(F.struct(s.alias("slice"), F.lit(True).alias("own")))
    up = F.when(rest >= slice_len - halo, F.array(F.struct((s + 1).alias("slice"), F.lit(False).alias("own")))).otherwise(F.array().cast("array<struct<slice:bigint,own:boolean>>"))
    down = F.when(rest < after, F.array(F.struct((s - 1).alias("slice"), F.lit(False).alias("own")))).otherwise(F.array().cast("array<struct<slice:bigint,own:boolean>>"))
    return df.select("*", F.inline(F.concat(own, up, down)))
