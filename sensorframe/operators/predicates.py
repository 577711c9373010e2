"""A composable algebra of conditions; each becomes one Column, and Catalyst decides what is pushed down.

Conditions are two-valued: a comparison with null is false, and negation turns that into true.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT_FIELDS = {
    "device_id": "data_point_metadata.device_id", "participant_id": "data_point_metadata.participant_id", "participant_namespace": "data_point_metadata.participant_namespace", "data_source_id": "data_point_metadata.data_source_id",
    "labels": "data_point_metadata.annotation_labels", "time": "measurement_timestamp_utc", "write_time": "data_point_metadata.sensor_store_metadata.sensor_store_write_time",
    "sensor_id": "sensor_id", "algorithm_name": "algorithm_name", "algorithm_version": "algorithm_version",
}
ANNOTATION_FIELDS = {
    "device_id": "annotation_metadata.device_id", "participant_id": "annotation_metadata.participant_id", "participant_namespace": "annotation_metadata.participant_namespace", "label": "annotation_label",
    "start": "start_timestamp_utc", "end": "end_timestamp_utc", "version_name": "annotation_metadata.version_name", "version_number": "annotation_metadata.version_number",
}
MESSAGE_FIELDS = {"device_id": "device_id", "participant_id": "participant_id", "time": "start_time"}
#: Namespaces of participant ids.
NAMESPACES = ("USER_ID_KEYSPACE_UNSPECIFIED", "GAIA_ID", "HASHED_STRING", "CSP_ID", "ANON_STUDY_DEVICE", "SENSOR_REGISTRY_CUSTOM", "DMI", "CSP_UUID", "FIREBASE", "CSP_INTERNAL_ID")
#: Patterns of device ids by type of device.
DEVICE_TYPES = {"COPPA": "C2Q.*", "TEST_DEVICE": "(?i).*test.*", "PICARD": r"PDV.*|com\.{vendor}\.picard.*", "PEP": "pep.*", "RIALTO": "RLQ.*|QCI.*", "MODUS": "stepwatch.*"}


class NotApplicable(ValueError):
    """The condition can't be asked of this kind of row."""


class Condition:
    def points(self, f: Mapping[str, str]) -> Column:
        return F.lit(True)

    def annotations(self, f: Mapping[str, str]) -> Column:
        return F.lit(True)

    def messages(self, f: Mapping[str, str]) -> Column:
        raise NotApplicable(f"{self!r} can't filter a stream")

    def column(self, kind: str = "points", fields: Mapping[str, str] | None = None) -> Column:
        """The condition over rows of a kind: 'points', 'annotations' or 'messages' (of a stream)."""
        known = {"points": POINT_FIELDS, "annotations": ANNOTATION_FIELDS, "messages": MESSAGE_FIELDS}[kind] | dict(fields or {})
        return F.coalesce(getattr(self, kind)(known), F.lit(False))

    def apply(self, df: DataFrame, kind: str = "points", fields: Mapping[str, str] | None = None) -> DataFrame:
        return df.where(self.column(kind, fields))

    def __and__(self, other: Condition) -> Condition:
        return And(_flat(And, self, other))

    def __or__(self, other: Condition) -> Condition:
        return Or(_flat(Or, self, other))

    def __neg__(self) -> Condition:
        return Not(self)


def _flat(kind: type, *conditions: Condition) -> tuple[Condition, ...]:
    """Members of nested conditions of the same kind, without duplicates, in order."""
    parts = [p for c in conditions for p in (c.members if isinstance(c, kind) else (c,))]
    return tuple(dict.fromkeys(parts))


def _any_kind(cls: type) -> type:
    """Conditions made of others ask these for the same kind of row."""
    for kind in ("points", "annotations", "messages"):
        setattr(cls, kind, lambda self, f, kind=kind: self.combine(kind, f))
    return cls


@_any_kind
@dataclass(frozen=True)
class And(Condition):
    members: tuple[Condition, ...] = ()

    def combine(self, kind: str, f: Mapping[str, str]) -> Column:
        return reduce(and_, [m.column(kind, f) for m in self.members], F.lit(True))


@_any_kind
@dataclass(frozen=True)
class Or(Condition):
    members: tuple[Condition, ...] = ()

    def combine(self, kind: str, f: Mapping[str, str]) -> Column:
        return reduce(or_, [m.column(kind, f) for m in self.members], F.lit(False))


@_any_kind
@dataclass(frozen=True)
class Not(Condition):
    member: Condition

    def combine(self, kind: str, f: Mapping[str, str]) -> Column:
        return ~self.member.column(kind, f)


@_any_kind
@dataclass(frozen=True)
class Devices(Condition):
    ids: tuple[str, ...]

    def combine(self, kind: str, f: Mapping[str, str]) -> Column:
        return F.col(f["device_id"]).isin(list(self.ids)) if self.ids else F.lit(False)


def Nothing() -> Condition:  # noqa: N802
    return Devices(())


def Everything() -> Condition:  # noqa: N802
    return Not(Nothing())


@_any_kind
@dataclass(frozen=True)
class Users(Condition):
    ids: tuple[str, ...]

    def combine(self, kind: str, f: Mapping[str, str]) -> Column:
        return F.col(f["participant_id"]).isin(list(self.ids)) if self.ids else F.lit(False)


@dataclass(frozen=True)
class Sensors(Condition):
    """By the sensor of the data source; points need the columns of `with_sources`. Annotations all pass."""

    ids: tuple[str, ...]

    def points(self, f: Mapping[str, str]) -> Column:
        return F.col(f["sensor_id"]).isin(list(self.ids)) if self.ids else F.lit(False)


@dataclass(frozen=True)
class Label(Condition):
    label: str
    on_annotations: bool = True

    def points(self, f: Mapping[str, str]) -> Column:
        return F.array_contains(f["labels"], self.label)

    def annotations(self, f: Mapping[str, str]) -> Column:
        return F.col(f["label"]) == self.label if self.on_annotations else F.lit(True)


@dataclass(frozen=True)
class TimeRange(Condition):
    """Points in [start, end); annotations that overlap it (with contained: lie within it); messages in (start, end].

    A null bound is unbounded. Bounds are timestamps or texts that cast to one.
    """

    start: object = None
    end: object = None
    contained: bool = False

    def _bounds(self) -> tuple[Column | None, Column | None]:
        return tuple(None if b is None else F.lit(b).cast("timestamp") for b in (self.start, self.end))

    def points(self, f: Mapping[str, str]) -> Column:
        s, e = self._bounds()
        t = F.col(f["time"])
        return reduce(and_, ([t >= s] if s is not None else []) + ([t < e] if e is not None else []), F.lit(True))

    def annotations(self, f: Mapping[str, str]) -> Column:
        s, e = self._bounds()
        a, b = F.col(f["start"]), F.col(f["end"])
        if self.contained:
            return reduce(and_, ([a >= s] if s is not None else []) + ([b <= e] if e is not None else []), F.lit(True))
        return reduce(and_, ([b > s] if s is not None else []) + ([a <= e] if e is not None else []), F.lit(True))

    def messages(self, f: Mapping[str, str]) -> Column:
        s, e = self._bounds()
        t = F.col(f["time"])
        return reduce(and_, ([t > s] if s is not None else []) + ([t <= e] if e is not None else []), F.lit(True))


@dataclass(frozen=True)
class WriteTimeRange(Condition):
    """Points written in [start, end). Only for points."""

    start: object = None
    end: object = None

    def points(self, f: Mapping[str, str]) -> Column:
        return TimeRange(self.start, self.end).points({"time": f["write_time"]})

    def annotations(self, f: Mapping[str, str]) -> Column:
        raise NotApplicable("annotations have no write time")


@dataclass(frozen=True)
class Algorithm(Condition):
    """By name and version of the data source's algorithm; data of no algorithm always passes. Annotations all pass.

    Each of name and version is a text, or several to be one of. With `substring`, a text also matches what it contains.
    """

    name: str | tuple[str, ...] = ""
    version: str | tuple[str, ...] = ""
    substring: bool = False

    def _one(self, column: str, wanted: str | Sequence[str]) -> Column:
        c = F.col(column)
        if not wanted:
            return F.lit(True)
        if isinstance(wanted, str):
            hit = c == wanted
            if self.substring:
                hit = hit | F.contains(F.lit(wanted), c)
        else:
            hit = c.isin(list(wanted))
        return c.isNull() | (c == "") | hit

    def points(self, f: Mapping[str, str]) -> Column:
        return self._one(f["algorithm_name"], self.name) & self._one(f["algorithm_version"], self.version)


@dataclass(frozen=True)
class AnnotationAlgorithm(Condition):
    """Annotations of a version name and number, or of none at all. Points all pass; neither given passes all."""

    name: str = ""
    version: int = 0

    def annotations(self, f: Mapping[str, str]) -> Column:
        n, v = F.col(f["version_name"]), F.col(f["version_number"])
        wanted = reduce(and_, ([n == self.name] if self.name else []) + ([v == self.version] if self.version else []), F.lit(True))
        return (n.isNull() & v.isNull()) | wanted


@_any_kind
@dataclass(frozen=True)
class DeviceType(Condition):
    """Device ids that begin as the type's pattern says; `vendor` is that of ids which name one (default: any)."""

    kind: str
    vendor: str = "[a-z]+"

    def combine(self, kind: str, f: Mapping[str, str]) -> Column:
        return F.col(f["device_id"]).rlike(f"^(?:{DEVICE_TYPES[self.kind].replace('{vendor}', self.vendor)})")


@dataclass(frozen=True)
class UserNamespace(Condition):
    """By the participant's namespace (number or name); with negate, all others. Rows without one are not of it."""

    namespace: int | str
    negate: bool = False
    as_name: bool = False

    def _compare(self, column: str) -> Column:
        number = NAMESPACES.index(self.namespace) if isinstance(self.namespace, str) else self.namespace
        hit = F.coalesce(F.col(column) == (F.lit(NAMESPACES[number]) if self.as_name else F.lit(number)), F.lit(False))
        return ~hit if self.negate else hit

    def points(self, f: Mapping[str, str]) -> Column:
        return self._compare(f["participant_namespace"])

    annotations = points


@dataclass(frozen=True)
class Where(Condition):
    """Any Column, over rows of any kind."""

    predicate: Column = field(compare=False)
    name: str = ""

    def points(self, f: Mapping[str, str]) -> Column:
        return self.predicate

    annotations = messages = points


def source_dimension(data_source: DataFrame) -> DataFrame:
    """One row for each data_source_id: the least non-null value of each column, as repeated rows may lack some."""
    cols = [c for c in ("data_spec_name", "sensor_id", "algorithm_name", "algorithm_version", "device_serial_number", "device_time_zone_name") if c in data_source.columns]
    return data_source.where("data_source_id is not null").groupBy("data_source_id").agg(*[F.min(c).alias(c) for c in cols])


def with_sources(points: DataFrame, data_source: DataFrame, columns: Sequence[str] = ("sensor_id", "algorithm_name", "algorithm_version"), strict: bool = False) -> DataFrame:
    """Points with columns of their data source, null where it is unknown; with `strict` an unknown source is an error.

    A left join that Spark broadcasts only as far as its own size check on the dimension allows.
    """
    dim = source_dimension(data_source).select(F.col("data_source_id").alias("_source"), *columns, F.lit(True).alias("_known"))
    out = points.join(dim, F.col("data_point_metadata.data_source_id") == F.col("_source"), "left")
    if strict:
        check = F.when(F.col("_known"), F.col(columns[0])).otherwise(F.raise_error(F.lit("unknown data source")))
        out = out.withColumn(columns[0], check)
    return out.drop("_source", "_known")


def split(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the condition, and all others (also where it is null)."""
    c = F.coalesce(condition, F.lit(False))
    return df.where(c), df.where(~c)


