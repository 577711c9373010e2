"""A catalogue of Parquet tables: listing, schemas, filtered reads, filter tables, sinks and run state."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import file_system, read_text, write_atomically

IDENTIFIER = re.compile(r"[A-Za-z0-9._-]{1,64}")


def identifier(text: object, what: str = "identifier") -> str:
    """The text, if it is a safe identifier; else ValueError."""
    if not isinstance(text, str) or not IDENTIFIER.fullmatch(text):
        raise ValueError(f"bad {what}: {text!r}")
    return text


def row_limit(n: object) -> int | None:
    if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n <= 0):
        raise ValueError(f"a limit must be a positive integer, not {n!r}")
    return n


class SensorTables:
    """Tables of a folder (one Parquet file or folder each) or, with `database`, of the session's catalogue."""

    def __init__(self, spark: SparkSession, folder: str | None = None, database: str | None = None):
        if (folder is None) == (database is None):
            raise ValueError("give a folder or a database")
        self.spark, self.folder, self.database = spark, folder, identifier(database, "database") if database else None

    def table(self, name: str) -> DataFrame:
        identifier(name, "table")
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet") if self.folder else self.spark.table(f"`{self.database}`.`{name}`")

    def schema(self, name: str) -> T.StructType:
        return self.table(name).schema

    def tables(self) -> list[str]:
        if self.database:
            return sorted(t.name for t in self.spark.catalog.listTables(self.database))
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(n.removesuffix(".parquet") for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.endswith(".parquet"))

    def read_datapoints(self, table: str = "datapoint", device_ids: Sequence[str] | None = None, start: Column | None = None, end: Column | None = None, data_types: Sequence[str] | None = None, limit: int | None = None, remove_duplicates: bool = False, device: str = "data_point_metadata.device_id", at: str = "measurement_timestamp_utc", data_type: str = "data_spec_name") -> DataFrame:
        """Data points of these devices and types with start <= time <= end (both inclusive); `limit` takes any so many.

        Only plain comparisons with literals, so Parquet skips what it can. Without conditions all rows come.
        """
        row_limit(limit)
        df = self.table(table)
        if device_ids is not None:
            df = df.where(F.col(device).isin([identifier(d, "device") for d in device_ids]) if device_ids else F.lit(False))
        if data_types is not None:
            df = df.where(F.col(data_type).isin([identifier(d, "data type") for d in data_types]) if data_types else F.lit(False))
        if start is not None:
            df = df.where(F.col(at) >= start)
        if end is not None:
            df = df.where(F.col(at) <= end)
        if remove_duplicates:
            df = remove_redelivered(df, device, at)
        return df.limit(limit) if limit is not None else df

    def filter_table(self, table: str, labels: Sequence[str] | None = None, version: str | int | None = None, version_field: str = "version_name") -> DataFrame:
        """An annotation table as rows of a filter: device_id, start_us, end_us, data_spec (null: any)."""
        df = self.table(table)
        if labels is not None:
            df = df.where(F.col("annotation_label").isin(list(labels)))
        if version is not None:
            df = df.where(F.col(f"annotation_metadata.{identifier(version_field)}") == F.lit(version))
        return filter_rows(df)

    def append(self, df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> None:
        """Adds rows to a table, which is created if needed."""
        identifier(table, "table")
        w = df.write.mode("append").partitionBy(*partition_by)
        w.parquet(f"{self.folder}/{table}.parquet") if self.folder else w.saveAsTable(f"`{self.database}`.`{table}`")


def remove_redelivered(points: DataFrame, device: str = "data_point_metadata.device_id", at: str = "measurement_timestamp_utc") -> DataFrame:
    """One row of each reading: of device, data source, measurement time and payload. Which delivery stays is not fixed.

    Write times, labels and the rest of data_point_metadata, and row_id, don't tell readings apart; null equals null.
    """
    meta = device.rpartition(".")[0]
    source = [F.col(f"{meta}.data_source_id").alias("_source")] if meta and "data_source_id" in points.schema[meta].dataType.names else []
    payload = [c for c in points.columns if c not in (meta, at, "row_id")]
    marked = points.select("*", F.col(device).alias("_device"), *source)
    return marked.dropDuplicates(["_device", *(["_source"] if source else []), at, *payload]).drop("_device", "_source")


def filter_rows(annotation: DataFrame) -> DataFrame:
    """device_id, start_us, end_us and the data_spec that the first input of an annotation names (null: any); of the
    supplemental source columns (see supplemental) those that are keys of filters, too."""
    annotation = supplemental(annotation)
    keys = [c for c in ("sensor_id", "algorithm_name", "algorithm_version") if c in annotation.columns]
    return annotation.select(
        F.col("annotation_metadata.device_id").alias("device_id"), F.unix_micros("start_timestamp_utc").alias("start_us"), F.unix_micros("end_timestamp_utc").alias("end_us"),
        F.get("annotation_metadata.input_data_info", F.lit(0))["metric_type"]["stream_item_type"].alias("data_spec"), *keys,
    )


def supplemental(df: DataFrame, prefix: str = "supplemental_source_") -> DataFrame:
    """Columns without the prefix of supplemental fields."""
    return df.withColumnsRenamed({c: c.removeprefix(prefix) for c in df.columns if c.startswith(prefix)})


@dataclass(frozen=True)
class StreamSource:
    """Where a stream comes from: exactly one of a topic and a subscription (here, folders of Parquet files)."""

    topic: str | None = None
    subscription: str | None = None
    split: timedelta = timedelta(hours=1)
    grouped: bool = False

    def __post_init__(self) -> None:
        if (self.topic is None) == (self.subscription is None):
            raise ValueError("give a topic or a subscription")

    def read(self, spark: SparkSession, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(self.topic or self.subscription)


@dataclass(frozen=True)
class BatchSource:
    """How data points are read: duplicates removed or not, participants looked up in a table of devices or not, the
    result cached or not; or so many mock rows in place of the table's own."""

    remove_duplicates: bool = True
    participants: DataFrame | None = None
    cache: bool = False
    mock: int | None = None

    def read(self, tables: SensorTables, table: str = "datapoint", **conditions: object) -> DataFrame:
        if self.mock is not None:
            df = mock_rows(tables.spark, tables.schema(table), self.mock)
        else:
            df = tables.read_datapoints(table, remove_duplicates=self.remove_duplicates, **conditions)
        df = df if self.participants is None else with_participants(df, self.participants)
        return df.cache() if self.cache else df


def mock_rows(spark: SparkSession, schema: T.StructType, n: int) -> DataFrame:
    """n rows of a schema with plain values that follow from the row's number: one a second, on device_0 to device_9."""

    def value(kind: T.DataType, name: str, i: Column) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*[value(f.dataType, f.name, i).alias(f.name) for f in kind.fields])
        if isinstance(kind, T.ArrayType):
            return F.array(*[value(kind.elementType, name, i + k) for k in range(3)])
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.timestamp_seconds(F.lit(1_700_000_000) + i).cast(kind)
        if isinstance(kind, T.BooleanType):
            return i % 2 == 0
        if isinstance(kind, T.StringType):
            return F.concat(F.lit(f"{name.removesuffix('_id')}_"), (i % 10).cast("string"))
        if isinstance(kind, T.BinaryType):
            return F.encode(i.cast("string"), "UTF-8")
        return (i % 100).cast(kind)

    i = F.col("id")
    return spark.range(n).select(*[value(f.dataType, f.name, i).alias(f.name) for f in schema.fields])


def with_participants(points: DataFrame, users: DataFrame) -> DataFrame:
    """Fills in the participant of points that have none from device_id, participant_id, participant_namespace of `users`."""
    u = users.groupBy(F.col("device_id").alias("_d")).agg(F.min(F.struct("participant_id", "participant_namespace")).alias("_u"))
    df = points.join(u, F.col("data_point_metadata.device_id") == F.col("_d"), "left")
    m = F.col("data_point_metadata")
    lacks = m["participant_id"].isNull()
    filled = m.withField("participant_id", F.when(lacks, F.col("_u.participant_id")).otherwise(m["participant_id"])).withField("participant_namespace", F.when(lacks, F.col("_u.participant_namespace")).otherwise(m["participant_namespace"]))
    return df.withColumn("data_point_metadata", filled).drop("_d", "_u")


class RunState:
    """The end of the last write-time range a registry has read, one JSON file for each registry, on any Hadoop file
    system. A commit replaces the file as a whole: a run that dies leaves the former state."""

    def __init__(self, spark: SparkSession, folder: str, registry: str, look_back: timedelta = timedelta(days=3)):
        self.spark, self.look_back = spark, look_back
        self.path = f"{folder.rstrip('/')}/{identifier(registry, 'registry')}.json"

    def next_range(self, now: datetime | None = None) -> tuple[datetime, datetime]:
        """[last end, now); without a state file it begins `look_back` before now."""
        now = now or datetime.now(timezone.utc)
        path, fs = file_system(self.spark, self.path)
        if not fs.exists(path):
            return now - self.look_back, now
        return datetime.fromisoformat(json.loads(read_text(self.spark, self.path))["last_write_end_time"]), now

    def commit(self, end: datetime) -> None:
        """Notes that everything written before `end` has been read: the range actually read, not the time of the call."""
        write_atomically(self.spark, self.path, json.dumps({"last_write_end_time": end.isoformat()}), overwrite=True)
