"""Corrected per-period aggregates over a stream: a store of panes, and the windows that each batch changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panes import PaneSpec, compose_windows, pane_partials
from ..sources.tables import file_system

DAY_US = 86_400_000_000
WINDOW = ("window_start_us", "n_initial", "total_initial", "n_final", "total_final", "late_events")


class PaneStore:
    """Open panes of a stream in a shared folder, by batch and by bucket of event time.

    A batch adds only the partial aggregates of the panes its own events fall into, split as in pane_partials by the
    windows that had been published or closed when each of them came: an event counts in the windows that were open at its
    own arrival, whatever else its batch holds. Then the windows over these panes, and no others, are put together again
    from the buckets they lie in, and handed on with their totals as published and so far; `closed` tells those that the
    greatest arrival so far has closed.

    Events count as dropped in each window that had closed (see `late`), and by number where all their windows had (see
    `dropped`). Panes stay in the store a second closing delay after their last window has closed, so that events that
    arrived before and are delivered later still meet the whole total; those delivered after that are dropped, too. Every
    `compact` batches the panes that are left are added up to one table. A batch that is run again replaces its own rows.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], spec: PaneSpec, bucket: int = DAY_US, compact: int = 20):
        self.spark, self.folder, self.keys, self.spec, self.bucket, self.compact = spark, folder.rstrip("/"), list(keys), spec, bucket, compact

    def _at(self, kind: str, n: int) -> str:
        return f"{self.folder}/{kind}/batch={n:010d}"

    def _there(self, kind: str, n: int) -> bool:
        path, fs = file_system(self.spark, f"{self._at(kind, n)}/_SUCCESS")
        return fs.exists(path)

    def _last(self, kind: str, n: int) -> int | None:
        return next((k for k in range(n, -1, -1) if self._there(kind, k)), None)

    def _mark(self, n: int) -> tuple[int | None, int]:
        """(greatest arrival, events dropped so far) of the batches up to `n`."""
        k = self._last("marks", n)
        if k is None:
            return None, 0
        m = self.spark.read.parquet(self._at("marks", k)).first()  # one row
        return m["mark"], m["dropped"]

    def dropped(self, number: int) -> int:
        """How many events of the batches up to `number` came after the closing of all windows they fall into."""
        return self._mark(number)[1]

    def late(self, number: int) -> DataFrame | None:
        """keys, window_start_us and dropped_events of all batches up to `number`."""
        found = [self._explode(self.spark.read.parquet(self._at("dropped", k))) for k in range(number + 1) if self._there("dropped", k)]
        if not found:
            return None
        rows = reduce(DataFrame.unionByName, found).where("_window <= _closed")
        return rows.groupBy(*self.keys, "_window").agg(F.sum("_events").alias("dropped_events")).select(*self.keys, (F.col("_window") * self.spec.slide).alias("window_start_us"), "dropped_events")

    @staticmethod
    def _explode(panes: DataFrame) -> DataFrame:
        return panes.withColumn("_window", F.explode(F.sequence("_first", "_last")))

    def _panes(self, number: int) -> DataFrame:
        """The partial aggregates of all batches up to `number` that are still in the store."""
        base = self._last("base", number)
        paths = ([self._at("base", base)] if base is not None else []) + [self._at("panes", k) for k in range((-1 if base is None else base) + 1, number + 1) if self._there("panes", k)]
        return reduce(lambda a, b: a.unionByName(b), [self.spark.read.schema(self._schema).parquet(p) for p in paths])

    def add(self, batch: DataFrame, number: int, event: str, arrival: str, value: Column, count: Column | None = None) -> DataFrame:
        """Adds batch `number` and returns the windows it changed: keys, the columns of WINDOW, closed.

        `count` (default 1) and `value` are what an event adds. Events with a null time are left out; a null value adds 0.
        """
        s = self.spec
        mark, dropped = self._mark(number - 1)
        gone = None if mark is None else (mark - s.size - 2 * s.close) // s.slide  # windows that have left the store
        events = batch.where(F.col(event).isNotNull() & F.col(arrival).isNotNull())
        one = F.lit(1) if count is None else count
        partials = pane_partials(events, self.keys, s, event, arrival, one.cast("long"), F.coalesce(value.cast("double"), F.lit(0.0)), gone).withColumn("_bucket", F.floor(F.col("_pane") / self.bucket).cast("long"))
        self._schema = partials.schema
        self._write(partials, "panes", number)
        own = self.spark.read.schema(self._schema).parquet(self._at("panes", number))
        all_gone = F.sum(F.when(F.col("_closed") >= F.col("_last"), F.col("_events")).otherwise(0))
        live = F.col("_closed") < F.col("_last")
        first = F.floor(F.col("_pane") / self.bucket) - (s.size // self.bucket + 1)  # of the windows over the pane
        spans = F.collect_set(F.when(live, F.struct(first.alias("a"), F.floor((F.col("_last") * s.slide + s.size - 1) / self.bucket).alias("b"))))
        seen = own.agg(F.max("_seen").alias("m"), all_gone.alias("gone"), spans.alias("spans"), F.max(F.col("_closed") >= F.col("_first")).alias("late")).first()  # bounded by the buckets of open windows
        if seen["late"]:
            self._write(own.where("_closed >= _first").drop("_bucket"), "dropped", number, False)
        now = max((x for x in (seen["m"], mark) if x is not None), default=None)
        marks = self.spark.range(1).select(F.lit(now).cast("long").alias("mark"), F.lit(dropped + (seen["gone"] or 0)).cast("long").alias("dropped"))
        self._write(marks, "marks", number, False)
        changed = self._explode(own.where(live)).where("_window > _closed").select(*self.keys, "_window").distinct()
        buckets = sorted({b for x in seen["spans"] for b in range(x["a"], x["b"] + 1)})
        held = self._explode(self._panes(number).where(F.col("_bucket").isin(buckets) if buckets else F.lit(False)))
        names = {k: f"_c{i}" for i, k in enumerate([*self.keys, "_window"])}
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(c)) for k, c in names.items()])
        touched = held.join(changed.withColumnsRenamed(names), same, "left_semi")
        out = compose_windows(touched.drop("_first", "_last").withColumns({"_first": F.col("_window"), "_last": F.col("_window")}).drop("_window"), self.keys, s)
        if number - (self._last("base", number - 1) or 0) >= self.compact:
            self._compact(number, now)
        return out.select(*self.keys, *WINDOW, (F.col("window_start_us") + s.size + s.close <= F.lit(now)).alias("closed"))

    def _write(self, df: DataFrame, kind: str, number: int, by_bucket: bool = True) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy("_bucket") if by_bucket else w).parquet(self._at(kind, number))

    def _compact(self, number: int, now: int | None) -> None:
        """Adds up the batches before `number` (which may still be run again), without panes that are due to leave."""
        s, by = self.spec, [*self.keys, "_pane", "_first", "_last", "_published", "_closed", "_bucket"]
        old = self._panes(number - 1)
        kept = old.where(F.col("_last") * s.slide + s.size + 2 * s.close > F.lit(now)).where("_closed < _last") if now is not None else old
        self._write(kept.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("_events", "_n", "_total")], F.max("_seen").alias("_seen")).select(*[f.name for f in self._schema]), "base", number - 1)


def stream_panes(events: DataFrame, folder: str, keys: Sequence[str], spec: PaneSpec, event: str, arrival: str, value: Column, emit: Callable[[DataFrame, int], None], count: Column | None = None):  # noqa: ANN201
    """A stream writer that adds each batch to a PaneStore and hands the changed windows to emit(windows, batch number)."""
    store = PaneStore(events.sparkSession, folder, keys, spec)
    return events.writeStream.option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint").foreachBatch(lambda df, n: emit(store.add(df, n, event, arrival, value, count), n))


def stream_to_end(events: DataFrame, folder: str, keys: Sequence[str], spec: PaneSpec, event: str, arrival: str, value: Column, count: Column | None = None) -> DataFrame:
    """Runs a stream of events over all there is; the last state of each window: keys, the columns of WINDOW, dropped_events."""
    spark, last = events.sparkSession, [-1]

    def emit(windows: DataFrame, n: int) -> None:
        windows.write.mode("overwrite").parquet(f"{folder}/windows/batch={n}")
        last[0] = n

    stream_panes(events, folder, keys, spec, event, arrival, value, emit, count).trigger(availableNow=True).start().awaitTermination()
    kinds = {"n_initial": "long", "total_initial": "double", "n_final": "long", "total_final": "double", "late_events": "long", "dropped_events": "long"}
    late = PaneStore(spark, folder, keys, spec).late(last[0])
    by = [*keys, "window_start_us"]
    parts = []
    if last[0] >= 0:
        rows = spark.read.option("basePath", f"{folder}/windows").parquet(f"{folder}/windows").groupBy(*by).agg(F.max_by(F.struct(*WINDOW[1:]), "batch").alias("r"))
        parts.append(rows.select(*by, "r.*"))
    if late is not None:
        parts.append(late)
    if not parts:
        return spark.createDataFrame([], events.select(*keys).schema).select(*keys, F.lit(0).cast("long").alias("window_start_us"), *[F.lit(0).cast(t).alias(c) for c, t in kinds.items()])
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    both = both.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in both.columns})
    return both.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0).cast(t)).alias(c) for c, t in kinds.items()])
