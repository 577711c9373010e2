"""Groups as pandas frames for user functions, and relational co-groups."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import Fixed, Sliding, annotation_time, key_by, key_local, key_time, measured

META = "data_point_metadata"
ENTITY = ["device_id", "participant_id", "participant_namespace"]
WINDOW = ["start_time_range_micros", "end_time_range_micros"]


class GroupedFrames:
    """Rows with key columns, to be handed to user functions as one pandas frame a group, sorted by `order` if given.

    A frame's attrs hold its key columns by name, and as data_point_metadata what a data point derived from all its rows
    has (see derived_attrs), if the rows have such a column (or several, with suffixes, after a merge).
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: str | None = None):
        self.df, self.keys, self.order = df, list(keys), order

    def _grouped(self):  # noqa: ANN202
        return self.df.groupBy(*self.keys)

    def _sorted(self) -> Callable[[pd.DataFrame], pd.DataFrame]:
        order, keys = self.order, self.keys
        metas = [c for c in self.df.columns if c == META or c.startswith(f"{META}_")]

        def arranged(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values(order, kind="stable", ignore_index=True) if order else f
            f.attrs.update({k: _plain(f[k].iloc[0]) for k in keys if len(f)})
            if metas and len(f):
                f.attrs[META] = derived_attrs(f, metas, order)
            return f

        return arranged

    def apply(self, func: Callable, schema: str | T.StructType, **kwargs: object) -> DataFrame:
        """func(frame, **kwargs) for each group: None gives no rows, a frame its rows, a mapping one row, a list or tuple
        of these all of them. Errors fail the job with the function's own traceback."""
        names = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fieldNames()
        arrange = self._sorted()
        return self._grouped().applyInPandas(lambda f: _rows(func(arrange(f), **kwargs), names), schema)

    def flat_map(self, func: Callable[..., Iterable], schema: str | T.StructType, **kwargs: object) -> DataFrame:
        """As apply, for functions that yield results. A frame as such is an error, as iterating it gives column names."""

        def each(frame: pd.DataFrame, **kw: object) -> list:
            out = func(frame, **kw)
            if isinstance(out, pd.DataFrame):
                raise TypeError("flat_map needs a function that yields frames or mappings")
            return list(out)

        return self.apply(each, schema, **kwargs)

    def filter(self, predicate: Callable[..., bool], **kwargs: object) -> DataFrame:
        """The rows of groups for which predicate(frame, **kwargs) holds."""
        arrange, schema = self._sorted(), self.df.schema
        return self._grouped().applyInPandas(lambda f: f if predicate(arrange(f), **kwargs) else f.iloc[:0], schema)

    def apply_algorithm(self, cls: type, schema: str | T.StructType, method: str = "process", init_args: Mapping[str, object] | None = None) -> DataFrame:
        """A method of a fresh instance of `cls` for each group."""
        return self.apply(lambda f: getattr(cls(**dict(init_args or {})), method)(f), schema)


def _plain(x: object) -> object:
    return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x.item() if hasattr(x, "item") else x


def derived_attrs(frame: pd.DataFrame, columns: Sequence[str] = (META,), at: str | None = None) -> dict:
    """The metadata of a data point derived from all rows of a frame, as metadata.derived_metadata has it for groups.

    The data source is the first row's by time and id; more than one device or participant is a ValueError.
    """
    rows = []
    for c in columns:
        for i, m in enumerate(frame[c]):
            if m is not None and m is not pd.NaT and m == m:
                m = m if isinstance(m, Mapping) else m.asDict(recursive=True)
                rows.append((frame[at].iloc[i] if at in frame.columns else i, m))
    one = lambda what, xs: (_ for _ in ()).throw(ValueError(f"several {what} in a group")) if len(xs) > 1 else next(iter(xs), None)
    first = min(rows, key=lambda r: (r[0], r[1]["data_source_id"] is not None, r[1]["data_source_id"] or 0), default=(None, {}))[1]
    who = one("participants", {(m["participant_id"], m["participant_namespace"]) for _, m in rows if m["participant_id"] is not None or m["participant_namespace"] is not None}) or (None, None)
    written = [m["sensor_store_metadata"]["sensor_store_write_time"] for _, m in rows if m.get("sensor_store_metadata") and m["sensor_store_metadata"].get("sensor_store_write_time") is not None]
    labels = sorted({x for _, m in rows for x in (m["annotation_labels"] if m["annotation_labels"] is not None else ()) if x is not None})
    return {
        "data_source_id": first.get("data_source_id"), "device_id": one("devices", {m["device_id"] for _, m in rows}), "participant_id": who[0], "participant_namespace": who[1],
        "echo_metadata": None, "sensor_store_metadata": {"sensor_store_write_time": max(written)} if written else None, "annotation_labels": labels,
    }


def _rows(result: object, names: list[str]) -> pd.DataFrame:
    if result is None:
        return pd.DataFrame({n: pd.Series(dtype=object) for n in names})
    if isinstance(result, pd.DataFrame):
        return result
    if isinstance(result, Mapping):
        return pd.DataFrame([result], columns=names)
    parts = [_rows(r, names) for r in result if r is not None]
    return pd.concat(parts, ignore_index=True) if parts else _rows(None, names)


def map_batches(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """func on Arrow batches of rows, in no particular grouping; spark.sql.execution.arrow.maxRecordsPerBatch bounds them."""
    return df.mapInPandas(lambda batches: (func(b) for b in batches), schema)


def union_frames(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows, columns by name; missing ones become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_frames(parts: Mapping[str, DataFrame], keys: Sequence[str], on: Sequence[str] = ("measurement_timestamp_utc",)) -> DataFrame:
    """Full outer join of any number of tagged tables on keys and times (null keys equal): columns present in several
    get the suffix _tag."""
    by = [*keys, *on]
    seen = [c for df in parts.values() for c in df.columns if c not in by]
    out: DataFrame | None = None
    for tag, df in parts.items():
        df = df.select(*by, *[F.col(c).alias(f"{c}_{tag}" if seen.count(c) > 1 else c) for c in df.columns if c not in by])
        if out is None:
            out = df
            continue
        same = reduce(lambda a, b: a & b, [out[c].eqNullSafe(df[c]) for c in by])
        out = out.join(df, same, "full_outer").select(*[F.coalesce(out[c], df[c]).alias(c) for c in by], *[out[c] for c in out.columns if c not in by], *[df[c] for c in df.columns if c not in by])
    if out is None:
        raise ValueError("nothing to merge")
    return out


def cogroup_counts(parts: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """keys and, for each tag, how many rows (n_tag): a full outer group over all tables, by one shuffle of partial counts."""
    tagged = union_frames([df.select(*keys, F.lit(tag).alias("_tag")) for tag, df in parts.items()])
    return tagged.groupBy(*keys).agg(*[F.count(F.when(F.col("_tag") == tag, 1)).alias(f"n_{tag}") for tag in parts])


def cogroup_apply(parts: Mapping[str, DataFrame], keys: Sequence[str], func: Callable[[dict[str, pd.DataFrame | None]], object], schema: str | T.StructType) -> DataFrame:
    """func({tag: frame or None}) for each key of any of the tables, in one grouping; a table without rows gives None."""
    columns = {tag: [c for c in df.columns if c not in keys] for tag, df in parts.items()}
    tagged = union_frames([df.select(*keys, F.lit(tag).alias("_tag"), F.struct(*columns[tag]).alias(tag)) for tag, df in parts.items()])
    names = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fieldNames()

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        key = frame[list(keys)].iloc[0].to_dict()
        by_tag: dict[str, pd.DataFrame | None] = {}
        for tag in columns:
            own = frame.loc[frame["_tag"] == tag, tag]
            by_tag[tag] = pd.DataFrame(own.map(lambda r: r if isinstance(r, dict) else r.asDict()).tolist()).assign(**key) if len(own) else None
        return _rows(func(by_tag), names)

    return tagged.groupBy(*keys).applyInPandas(each, schema)


def build_frames(source: DataFrame | Mapping[str, DataFrame], window: Fixed | Sliding | None = None, zone: Column | None = None, per_timestamp: bool = False, annotations: str | None = None, by_device: bool = True, by_participant: bool = True, combine: str | None = None) -> GroupedFrames | dict[str, GroupedFrames]:
    """Rows keyed by participant and device, and by window (in UTC, or by the wall clock of `zone`) or timestamp if asked.

    `annotations` ('start' or 'end') takes annotations, windowed by that time. A mapping of tables gives a mapping of
    groups, for merge_frames and cogroup_apply; with `combine` it gives one group: 'concat' has the rows of all tables,
    'merge' joins them on keys and times (columns of several get the suffix _tag). Anything else is a TypeError.
    """
    if combine not in (None, "concat", "merge"):
        raise ValueError("combine must be concat or merge")
    if isinstance(source, Mapping):
        parts = {tag: build_frames(df, window, zone, per_timestamp, annotations, by_device, by_participant) for tag, df in source.items()}
        if combine is None or not parts:
            return parts
        first = next(iter(parts.values()))
        times = ["start_timestamp_utc", "end_timestamp_utc"] if annotations else ["measurement_timestamp_utc"]
        frames = {tag: g.df for tag, g in parts.items()}
        return GroupedFrames(union_frames(list(frames.values())) if combine == "concat" else merge_frames(frames, first.keys, times), first.keys, first.order)
    if not isinstance(source, DataFrame):
        raise TypeError("frames are built from a DataFrame or a mapping of them")
    df = key_by(source, by_device, by_participant, annotations=annotations is not None)
    at = annotation_time(annotations) if annotations else measured()
    keys = list(ENTITY)
    if window is not None:
        df = key_time(df, window, at) if zone is None else key_local(df, window, at, zone)
        keys += WINDOW
    if per_timestamp:
        df = df.withColumn("ts", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        keys.append("ts")
    return GroupedFrames(df, keys, "start_timestamp_utc" if annotations else "measurement_timestamp_utc")
