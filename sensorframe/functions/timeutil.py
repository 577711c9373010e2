"""Scalar functions on timestamps, zones and labels, as Columns."""

from __future__ import annotations

import zoneinfo
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the mark of an unbounded end in warehouse tables, and what it stands for.
UNBOUNDED_US, LATEST_US = 9223372036854776, 9223372036854775
#: Offsets and the zone that stands for each.
ZONE_OF_OFFSET = {
    "-11:00": "Pacific/Pago_Pago",
    "-10:00": "Pacific/Honolulu",
    "-09:30": "Pacific/Marquesas",
    "-09:00": "America/Anchorage",
    "-08:00": "America/Los_Angeles",
    "-07:00": "America/Denver",
    "-06:00": "America/Chicago",
    "-05:00": "America/New_York",
    "-04:00": "America/Halifax",
    "-03:30": "America/St_Johns",
    "-03:00": "America/Sao_Paulo",
    "-02:30": "America/St_Johns",
    "-02:00": "America/Noronha",
    "-01:00": "Atlantic/Azores",
    "+00:00": "Europe/London",
    "+01:00": "Europe/Paris",
    "+02:00": "Europe/Athens",
    "+03:00": "Europe/Moscow",
    "+03:30": "Asia/Tehran",
    "+04:00": "Asia/Dubai",
    "+04:30": "Asia/Kabul",
    "+05:00": "Asia/Karachi",
    "+05:30": "Asia/Kolkata",
    "+05:45": "Asia/Kathmandu",
    "+06:00": "Asia/Dhaka",
    "+06:30": "Asia/Yangon",
    "+07:00": "Asia/Jakarta",
    "+08:00": "Asia/Singapore",
    "+08:45": "Australia/Eucla",
    "+09:00": "Asia/Tokyo",
    "+09:30": "Australia/Adelaide",
    "+10:00": "Australia/Melbourne",
    "+10:30": "Australia/Lord_Howe",
    "+11:00": "Pacific/Guadalcanal",
    "+12:00": "Pacific/Auckland",
    "+12:45": "Pacific/Chatham",
    "+13:00": "Pacific/Kanton",
    "+14:00": "Pacific/Kiritimati",
}
UNITS = ("SECOND", "MINUTE", "HOUR", "DAY")
OFFSET = r"^[+-](?:0\d|1[0-8]):?[0-5]\d\z"


@lru_cache(maxsize=1)
def zone_names() -> list[str]:
    return sorted(zoneinfo.available_timezones())


def zone_type(zone: Column) -> Column:
    """'NAMED', 'OFFSET' or 'INVALID' (null too)."""
    return F.when(zone.isin(zone_names()), "NAMED").when(zone.rlike(OFFSET), "OFFSET").otherwise("INVALID")


def safe_zone(zone: Column) -> Column:
    """A zone Spark accepts: names and offsets as they are, anything else UTC."""
    return F.when(zone_type(zone) == "INVALID", "UTC").otherwise(zone)


def to_local(at: Column, zone: Column) -> Column:
    """The wall clock at `zone`, written as if it were UTC."""
    return F.from_utc_timestamp(at, safe_zone(zone))


def shift_seconds(at: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(at) + seconds.cast("long") * 1_000_000)


def date_in_zone(at: Column, zone: Column) -> Column:
    """The local date, yyyy-MM-dd."""
    return F.date_format(to_local(at, zone), "yyyy-MM-dd")


def readable_zone(offset_seconds: Column) -> Column:
    """The zone that stands for an offset in seconds; an error for an offset without one."""
    seconds = lambda o: (1 if o[0] == "+" else -1) * (int(o[1:3]) * 3600 + int(o[4:]) * 60)
    table = F.create_map(*[F.lit(x) for o, z in ZONE_OF_OFFSET.items() for x in (seconds(o), z)])
    found = F.try_element_at(table, offset_seconds.cast("int"))
    return F.when(offset_seconds.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no zone for an offset of seconds: "), offset_seconds.cast("string"))))


def parse_warehouse(us: Column) -> Column:
    """Microseconds as a timestamp; the unbounded mark is the latest instant of ns precision."""
    return F.timestamp_micros(F.when(us == UNBOUNDED_US, LATEST_US).otherwise(us))


def parse_store(text: Column) -> Column:
    """A numeric text as milliseconds, another as a date text in UTC; null if neither. The session must be in UTC."""
    return F.when(text.rlike(r"^\d+\z"), F.timestamp_millis(F.when(text.rlike(r"^0*\d{1,15}\z"), text.cast("long")))).otherwise(F.try_to_timestamp(F.regexp_replace(text, r"\s+UTC$", "Z")))


def millis(at: Column) -> Column:
    """Whole milliseconds since the epoch, cut off; null stays null."""
    return F.unix_millis(at)


def from_millis(ms: Column) -> Column:
    """Milliseconds since the epoch as a timestamp."""
    return F.timestamp_millis(ms)


def time_text_millis(text: Column) -> Column:
    """A date text (in UTC unless it says otherwise) as milliseconds; an error for anything else, null too."""
    at = F.try_to_timestamp(F.regexp_replace(text, r"\s+UTC$", "Z"))
    return F.when(at.isNotNull(), F.unix_millis(at)).otherwise(F.raise_error(F.concat(F.lit("no time: "), F.coalesce(text, F.lit("null")))).cast("long"))


def utc_only(text: Column) -> Column:
    """A timestamp text that is in UTC or says no zone; an error for one with another offset."""
    other = text.rlike(r"[+-](?!00:?00)\d{2}:?\d{2}\s*\z") & text.rlike(r"\d{1,2}:\d{2}.*[+-]\d{2}:?\d{2}\s*\z")
    return F.when(other, F.raise_error(F.concat(F.lit("not in UTC: "), text)).cast("timestamp")).otherwise(F.try_to_timestamp(text))


def required(value: Column, what: str) -> Column:
    """The value; an error where it is null."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"{what} must not be null")))


def floor_second(at: Column) -> Column:
    return F.date_trunc("second", at)


def ceil_second(at: Column) -> Column:
    return F.timestamp_micros(F.ceil(F.unix_micros(at) / 1_000_000).cast("long") * 1_000_000)


def floor_unit(at: Column, unit: str) -> Column:
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    return F.date_trunc(unit.lower(), at)


def unit_interval(unit: str) -> Column:
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    return F.expr(f"interval {'24 hours' if unit == 'DAY' else '1 ' + unit.lower()}")


def filter_time(column: Column, kind: str, earliest: str = "2010-01-01", latest: Column | None = None) -> Column:
    """A filter table's time (of Spark type `kind`) as a timestamp: integers are milliseconds from `earliest` to `latest`
    (default now), texts are parsed, others an error."""
    if kind in ("bigint", "int"):
        at = F.timestamp_millis(column.cast("long"))
        fair = (at >= F.lit(earliest).cast("timestamp")) & (at < (latest if latest is not None else F.current_timestamp()))
        return F.when(column.isNull() | fair, at).otherwise(F.raise_error(F.concat(F.lit("milliseconds out of range: "), column.cast("string"))))
    if kind == "string":
        return column.cast("timestamp")
    if kind in ("timestamp", "timestamp_ntz"):
        return column.cast("timestamp")
    raise ValueError(f"start and end must be integers, texts or timestamps, not {kind}")


def job_label(text: Column) -> Column:
    """A text as a job label: lower case, at most 63 characters of a-z, 0-9, _ and -."""
    return F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9_-]", "_"), 1, 63)


def job_url(base: str, *parts: Column) -> Column:
    """The address of a job's page: a console's base address and path parts, such as region and job id."""
    return F.concat_ws("/", F.lit(base.rstrip("/")), *[F.url_encode(p) for p in parts])
