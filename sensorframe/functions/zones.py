"""Zone-offset intervals and wall-clock times."""

from __future__ import annotations

import zoneinfo
from datetime import UTC, datetime, timedelta
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Years for which changes of offset are listed; times outside take the nearest listed offset.
FIRST_YEAR, LAST_YEAR, PROBE = 1990, 2040, timedelta(days=7)

#: Zone abbreviations in their usual US, European and Japanese meaning, hours from UTC.
ABBREVIATIONS = {
    "UTC": 0, "UT": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 1, "BST": 1, "IST": 1, "CET": 1, "CEST": 2, "MEZ": 1, "MESZ": 2, "EET": 2, "EEST": 3, "MSK": 3,
    "JST": 9, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
}
FIXED = r"^(?:(?:UTC|GMT|UT)\s*)?([+-])(0?[0-9]|1[0-8])(?::?([0-5][0-9]))?\z"  # an offset of at most 18 hours


@lru_cache(maxsize=1)
def offset_intervals() -> list[tuple[str, int, int, int]]:
    """(zone, first UTC second, last UTC second + 1, offset in s) for all zones of the time zone database, in order."""
    lo, hi = datetime(FIRST_YEAR, 1, 1, tzinfo=UTC), datetime(LAST_YEAR + 1, 1, 1, tzinfo=UTC)
    probes = [lo + PROBE * i for i in range((hi - lo) // PROBE + 1)] + [hi]
    out = []
    for name in sorted(zoneinfo.available_timezones()):
        if name in ABBREVIATIONS:
            continue
        zone = zoneinfo.ZoneInfo(name)
        at = lambda t, z=zone: t.astimezone(z).utcoffset()
        start, offset, before = -(1 << 40), at(lo), lo
        for p in probes[1:]:
            if at(p) != offset:
                a, b = int(before.timestamp()), int(p.timestamp())
                while b - a > 1:
                    m = (a + b) // 2
                    a, b = (m, b) if at(datetime.fromtimestamp(m, UTC)) == offset else (a, m)
                out.append((name, start, b, int(offset.total_seconds())))
                start, offset = b, at(p)
            before = p
        out.append((name, start, 1 << 40, int(offset.total_seconds())))
    return out


@lru_cache(maxsize=1)
def _by_year() -> list[tuple]:
    rows: dict[tuple[str, int], list] = {}
    year_of = lambda s: min(max(datetime.fromtimestamp(min(max(s, -(1 << 31)), 1 << 32), UTC).year, FIRST_YEAR), LAST_YEAR)
    for zone, a, b, off in offset_intervals():
        for y in range(year_of(a + off - 2 * 86400), year_of(b + off + 2 * 86400) + 1):
            rows.setdefault((zone, y), []).append((a + off, b + off, off))
    return [(z, y, sorted(spans, key=lambda x: x[1])) for (z, y), spans in rows.items()]


def zone_table(spark: SparkSession) -> DataFrame:
    """zone, year and spans: the zone's offset intervals near that year, exploded by year, in local seconds.

    Bounded by the time zone database (about 30,000 rows), so it may be broadcast at any input size.
    """
    return spark.createDataFrame(_by_year(), "zone string, year int, spans array<struct<a: bigint, b: bigint, off: int>>")


def most_spans() -> int:
    """The greatest number of offset intervals near a year, over all zones and years."""
    return max(len(spans) for _, _, spans in _by_year())


def wall_offset(wall_s: Column, spans: Column) -> Column:
    """The offset for a wall-clock second, from the intervals as-of it.

    One interval holds it: its offset. Two do (the clock was put back): the earlier instant. None does (put forward):
    the offset before the change. Intervals are looked at one by one, in plain expressions.
    """
    each = [F.get(spans, F.lit(i)) for i in range(max(most_spans(), 2))]
    held = F.greatest(*[F.when((x["a"] <= wall_s) & (wall_s < x["b"]), x["off"]) for x in each])  # passes over nulls
    passed = [F.when(x["b"] <= wall_s, x["off"]) for x in reversed(each)]
    return F.coalesce(held, *passed, each[0]["off"])


def wall_kind(wall_s: Column, spans: Column) -> Column:
    """'exact', 'ambiguous' or 'nonexistent': how many offset intervals hold the wall-clock second."""
    n = F.size(F.filter(spans, lambda x: (x["a"] <= wall_s) & (wall_s < x["b"])))
    return F.when(n == 1, "exact").when(n > 1, "ambiguous").otherwise("nonexistent")


def fixed_offset(text: Column) -> Column:
    """Seconds of an offset text such as +05:30, -0800, GMT+2 or -03; null if it is none."""
    none = F.lit(None).cast("int")
    sign = F.when(F.regexp_extract(text, FIXED, 1) == "-", -1).otherwise(1)
    part = lambda i: F.coalesce(F.regexp_extract(text, FIXED, i).try_cast("int"), F.lit(0))
    return F.when(text.rlike(FIXED), sign * (part(2) * 3600 + part(3) * 60)).otherwise(none)


def abbreviation_offset(text: Column) -> Column:
    """Seconds of a zone abbreviation in its usual meaning; null for others."""
    table = F.create_map(*[F.lit(x) for k, h in ABBREVIATIONS.items() for x in (k, h * 3600)])
    return F.try_element_at(table, F.upper(text))


def device_zones(data_source: DataFrame, zones: DataFrame) -> DataFrame:
    """device_id and its device_zone: the zone any row gives for it that is valid, the least name among several.

    A device without a row here has no valid zone, and its wall clock is read as UTC.
    """
    names = zones.select("zone").distinct()
    z = data_source.select(F.col("device_serial_number").alias("device_id"), F.trim("device_time_zone_name").alias("zone")).where("device_id is not null and zone is not null").distinct()
    fixed = z.withColumn("offset", F.coalesce(fixed_offset(F.col("zone")), abbreviation_offset(F.col("zone"))))
    named = fixed.join(F.broadcast(names.withColumn("known", F.lit(True))), "zone", "left")
    return named.where("offset is not null or known").groupBy("device_id").agg(F.min("zone").alias("device_zone"))
