"""Schemas of data points and annotations, and the catalogue of data specs."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENSOR_STORE = T.StructType([T.StructField("sensor_store_write_time", T.TimestampType())])
ECHO = T.StructType([T.StructField(n, T.TimestampType()) for n in ("bucket_start", "bucket_write_time", "deleted_time", "snapshot_time")])
METADATA = T.StructType(
    [
        T.StructField("data_source_id", T.LongType()), T.StructField("device_id", T.StringType()), T.StructField("participant_id", T.StringType()), T.StructField("participant_namespace", T.LongType()),
        T.StructField("echo_metadata", ECHO), T.StructField("sensor_store_metadata", SENSOR_STORE), T.StructField("annotation_labels", T.ArrayType(T.StringType())),
    ]
)
BASE = T.StructType([T.StructField("data_point_metadata", METADATA), T.StructField("measurement_timestamp_utc", T.TimestampType())])
#: The schema of annotations, as DDL.
ANNOTATION = (
    "annotation_label string, start_timestamp_utc timestamp, end_timestamp_utc timestamp, annotation_metadata struct<device_id: string, participant_id: string, participant_namespace: bigint, version_name: string, version_number: bigint, "
    "input_data_info: array<struct<version_number: bigint, version_name: string, metric_type: struct<stream_item_type: string, derived_data_type: string, annotation_type: string>>>>"
)
CODES = {"i": T.LongType(), "d": T.DoubleType(), "s": T.StringType(), "b": T.BooleanType(), "x": T.BinaryType(), "t": T.TimestampType(), "?": T.StringType()}


def class_name(spec: str, vendor: str) -> str:
    """The class name of a dotted spec: without the vendor's prefix, parts in title case, joined."""
    return "".join(p.title() for p in spec.removeprefix(vendor).split("."))


def payload_type(text: str) -> T.StructType:
    """A payload such as `category s; flags [b]; count i!` (! marks fields that must be there) as a StructType."""
    fields = []
    for part in filter(None, (p.strip() for p in text.replace("—", "").split(";"))):
        name, code = part.rsplit(" ", 1)
        needed, code = code.endswith("!"), code.rstrip("!")
        kind = T.ArrayType(CODES[code[1:-1]]) if code.startswith("[") else CODES[code]
        fields.append(T.StructField(name, kind, not needed))
    return T.StructType(fields)


@dataclass(frozen=True)
class Spec:
    name: str
    class_name: str
    payload: T.StructType

    @property
    def schema(self) -> T.StructType:
        return T.StructType([*BASE.fields, *self.payload.fields])


class Catalogue:
    """Data specs by name and by class name, read from a table of lines `| spec | class | source | payload |`."""

    def __init__(self, lines: list[str]):
        rows = [m.groups() for m in (re.match(r"\|\s*`([^`]+)`\s*\|\s*`([^`]+)`\s*\|[^|]*\|\s*(.*?)\s*\|\s*$", line) for line in lines) if m]
        self.by_name = {n: Spec(n, c, payload_type(p)) for n, c, p in rows}
        self.by_class = {s.class_name: s for s in self.by_name.values()}

    @classmethod
    def read(cls, path: str) -> Catalogue:
        with open(path, encoding="utf-8") as f:
            return cls(f.read().splitlines())

    def __len__(self) -> int:
        return len(self.by_name)

    def __getitem__(self, name: str) -> Spec:
        return self.by_name[name]

    def check(self, name: str, schema: T.StructType, types: bool = False) -> None:
        """ValueError unless `schema` has the base fields and exactly the spec's fields, with `types` of its types too."""
        have, want = {f.name: f.dataType for f in schema}, {f.name: f.dataType for f in self[name].schema}
        missing, extra = sorted(want.keys() - have.keys()), sorted(have.keys() - want.keys())
        if missing or extra:
            raise ValueError(f"{name}: missing {missing}, unknown {extra}")
        if wrong := types and [n for n in want if have[n] != want[n] and n not in BASE.fieldNames()]:
            raise ValueError(f"{name}: other types in {wrong}")


def metadata(device_id: Column, data_source_id: Column | None = None, participant_id: Column | None = None, participant_namespace: Column | None = None, write_time: Column | None = None, labels: Column | None = None) -> Column:
    """A data_point_metadata struct; labels become sorted and distinct, missing parts null."""
    none = F.lit(None)
    return F.struct(
        (data_source_id if data_source_id is not None else none).cast("long").alias("data_source_id"),
        device_id.cast("string").alias("device_id"),
        (participant_id if participant_id is not None else none).cast("string").alias("participant_id"),
        (participant_namespace if participant_namespace is not None else none).cast("long").alias("participant_namespace"),
        none.cast(ECHO).alias("echo_metadata"),
        (F.when(write_time.isNotNull(), F.struct(write_time.alias("sensor_store_write_time"))) if write_time is not None else none).cast(SENSOR_STORE).alias("sensor_store_metadata"),
        F.array_sort(F.array_distinct(labels if labels is not None else F.array().cast("array<string>"))).alias("annotation_labels"),
    )


def to_datapoints(raw: DataFrame, payload: list[str], device: str = "DeviceID", user: str = "UserID", namespace: str = "UserNamespace", at: str = "DataPointTime", written: str = "DataPointWriteTime") -> DataFrame:
    """Raw table rows as data points: columns nested into data_point_metadata, payload fields as they are."""
    m = metadata(F.col(device), participant_id=F.col(user), participant_namespace=F.col(namespace), write_time=F.col(written))
    return raw.select(m.alias("data_point_metadata"), F.col(at).cast("timestamp").alias("measurement_timestamp_utc"), *payload)
