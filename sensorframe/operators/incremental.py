"""Reading only new or changed records: disjoint read intervals, what is missing from them, and their commit."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import file_system, read_text, write_atomically
from .intervals import inside, merge_intervals, outside

HOUR_US = 3_600_000_000


def run_status(log: DataFrame) -> DataFrame:
    """The last state of each run: its log row with the latest logged_at (the largest log_id among equal ones).

    Log rows without logged_at count as the earliest. Runs of a null registry are left out: nothing can read for them.
    """
    last = F.struct(F.coalesce(F.unix_micros("logged_at"), F.lit(-(1 << 62))), "log_id")
    what = F.struct("data_spec_name", "run_status", F.unix_micros("write_start_time").alias("start_us"), F.unix_micros("write_end_time").alias("end_us"))
    return log.where("registry is not null").groupBy("registry", "run_id").agg(F.max_by(what, last).alias("x")).select("registry", "run_id", "x.*")


def processed_intervals(log: DataFrame) -> DataFrame:
    """What succeeded runs have read: disjoint intervals [start_us, end_us) of write time for each registry."""
    done = run_status(log).where("run_status = 'SUCCEEDED'").select("registry", "start_us", "end_us")
    return merge_intervals(done, ["registry"]).drop("gap_start_us")


def registry_rows(effective: DataFrame, log: DataFrame) -> DataFrame:
    """registry and the columns of `effective`, for each effective row of the registry's spec. The spec's registries come
    from all their log rows."""
    specs = log.where("registry is not null and data_spec_name is not null").select("registry", "data_spec_name").distinct()
    return effective.join(specs, "data_spec_name")


def unread_rows(effective: DataFrame, log: DataFrame, bucket_us: int = HOUR_US) -> DataFrame:
    """registry and the columns of `effective`, for each effective row of a registry's spec that no succeeded run has read.

    A registry whose runs all failed has every row left. The cover table holds one row for each registry and hour; Spark
    broadcasts it only where its own size check allows.
    """
    return outside(registry_rows(effective, log), processed_intervals(log), ["registry"], "arrival_us", bucket_us)


def subtract(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start_us and end_us: the parts of `wanted` that `done` doesn't cover. Both are merged (disjoint) intervals.

    A sweep over the borders of both, one row each, so a key costs as many rows as it has disjoint intervals.
    """
    def borders(df: DataFrame, column: str) -> DataFrame:
        ends = F.explode(F.array(F.struct(F.col("start_us").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("t"), F.lit(-1).alias("d"))))
        other = "_done" if column == "_wanted" else "_wanted"
        return df.select(*keys, ends.alias("x")).select(*keys, F.col("x.t").alias("start_us"), F.col("x.d").alias(column), F.lit(0).alias(other))

    both = borders(wanted, "_wanted").unionByName(borders(done, "_done")).groupBy(*keys, "start_us").agg(F.sum("_wanted").alias("_wanted"), F.sum("_done").alias("_done"))
    w = Window.partitionBy(*keys).orderBy("start_us")
    swept = both.withColumns({"_in": F.sum("_wanted").over(w), "_out": F.sum("_done").over(w), "end_us": F.lead("start_us").over(w)})
    return swept.where("_in > 0 and _out = 0 and end_us is not null").select(*keys, "start_us", "end_us")


class IntervalLedger:
    """Runs that survive failures without skipping or repeating records.

    The ledger is a folder of numbered commits. Each names a table of the disjoint intervals of sequence numbers processed
    so far for each key, and the output its run has added. A run writes its output and the merged intervals first and then
    its commit, which is created atomically and only if no other run has taken its number; so both count at once. A run
    that dies leaves folders no commit names, which nobody reads. The driver holds one commit, never the intervals.

    Ranges are joined with the source by buckets of `bucket` numbers, so they should be bounded.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), bucket: int = HOUR_US):
        self.spark, self.path, self.keys, self.bucket = spark, path.rstrip("/"), list(keys), bucket

    def _by(self) -> list[str]:
        return self.keys or ["_all"]

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df if self.keys else df.withColumn("_all", F.lit(0))

    def _commits(self) -> list[str]:
        root, fs = file_system(self.spark, f"{self.path}/commits")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n for n in names if n.startswith("v") and n.endswith(".json"))

    def state(self) -> dict:
        """The last commit: version, and the folder of the intervals processed so far."""
        names = self._commits()
        return json.loads(read_text(self.spark, f"{self.path}/commits/{names[-1]}")) if names else {"version": 0, "intervals": None}

    def processed(self) -> DataFrame | None:
        """keys, start_us and end_us of what has been processed; None before the first commit."""
        at = self.state()["intervals"]
        return self.spark.read.parquet(at) if at else None

    def pending(self, available: DataFrame) -> DataFrame:
        """The parts of `available` (keys, start_us, end_us) that no committed run has processed."""
        wanted = merge_intervals(self._keyed(available), self._by()).drop("gap_start_us")
        done = self.processed()
        return wanted if done is None else subtract(wanted, done, self._by())

    def seed(self, intervals: DataFrame) -> None:
        """Commits intervals that have been processed elsewhere, without output."""
        self._commit(None, self._keyed(intervals))

    def run(self, source: DataFrame, at: str, available: DataFrame, work: Callable[[DataFrame], DataFrame], before_commit: Callable[[], None] | None = None) -> bool:
        """Applies `work` to the rows of `source` whose `at` lies in a pending part of `available`, and commits; False if
        nothing is pending. Rows that arrive later with an `at` in a processed part aren't read, so `available` should end
        where the source is complete; gaps before it may be left for later runs. `before_commit` is called between output
        and commit."""
        todo = self.pending(available)
        if todo.isEmpty():
            return False
        out = f"{self.path}/output/{uuid.uuid4().hex}"
        work(inside(self._keyed(source), todo, self._by(), at, self.bucket).drop("_all")).write.parquet(out)
        self._commit(out, todo, before_commit)
        return True

    def _commit(self, out: str | None, added: DataFrame, before_commit: Callable[[], None] | None = None) -> None:
        old, done = self.state(), self.processed()
        merged = added.select(*self._by(), "start_us", "end_us")
        merged = merge_intervals(merged if done is None else merged.unionByName(done.select(merged.columns)), self._by()).drop("gap_start_us")
        at = f"{self.path}/intervals/{uuid.uuid4().hex}"
        merged.write.parquet(at)
        if before_commit:
            before_commit()
        version = old["version"] + 1
        write_atomically(self.spark, f"{self.path}/commits/v{version:08d}.json", json.dumps({"version": version, "intervals": at, "output": out}))

    def output(self) -> DataFrame | None:
        """All committed results, or None before the first commit."""
        paths = [p for p in (json.loads(read_text(self.spark, f"{self.path}/commits/{n}"))["output"] for n in self._commits()) if p]
        return self.spark.read.parquet(*paths) if paths else None
