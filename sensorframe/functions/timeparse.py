"""Timestamps of many formats, precisions and zones as one instant: ns since the epoch, UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .zones import FIRST_YEAR, LAST_YEAR, abbreviation_offset, device_zones, fixed_offset, wall_offset, zone_table

# A text is rewritten to eleven fields, parted by bars: style, year, month, day, hour, minute, second, fraction, half of
# the day, offset, zone. Style: d (month known), n (numeric date whose order is the origin's; year, first, second).
TIME = r"(?:[Tt\s]\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\b\.?)?)?"
ZONE = r"\s*([Zz]|(?:(?:UTC|GMT|UT)\s*)?[+-]\d{1,2}(?::?\d{2})?)?\s*(?:\[?([A-Za-z][A-Za-z0-9_/+-]*)\]?)?"
WEEKDAY = r"(?:[A-Za-z]{3,9}\.?,?\s+)?"
MONTH = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
FORMS = (
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){TIME}{ZONE}$", "d|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt\s](\d{{2}}):?(\d{{2}}):?(\d{{2}})?(?:[.,](\d+))?{ZONE}$", "d|$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}){TIME}{ZONE}$", "n|$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    (rf"(?i)^{WEEKDAY}(\d{{1,2}})[-\s/.]+{MONTH}[-\s/.,]+(\d{{4}}|\d{{2}}){TIME}{ZONE}$", "d|$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    (rf"(?i)^{WEEKDAY}{MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}}|\d{{2}}),?{TIME}{ZONE}$", "d|$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
)
FIELDS = ("style", "year", "month", "day", "hour", "minute", "second", "fraction", "half", "offset", "zone")
#: Whole numbers count the unit that gives a date in these years.
FIRST_NUMBER_YEAR, LAST_NUMBER_YEAR = 2015, 2030
LEAST_NS, MOST_NS = 1_420_070_400 * 10**9, 1_924_992_000 * 10**9  # 2015-01-01 and 2031-01-01


def number_ns(text: Column) -> Column:
    """Whole numbers as s, ms, us or ns by the date they give; decimal numbers as seconds; else null."""
    n = F.when(text.rlike(r"^[+-]?\d{1,19}$"), text.try_cast("long"))
    out = F.when(F.lit(False), F.lit(0).cast("long"))
    for scale in (1, 10**3, 10**6, 10**9):
        out = out.when(n.between(-(-LEAST_NS // scale), (MOST_NS - 1) // scale), n * F.lit(scale).cast("long"))
    seconds = F.when(text.rlike(r"^[+-]?\d{1,10}\.\d+$"), F.substring_index(text, ".", 1).try_cast("long"))
    fraction = F.rpad(F.substring(F.substring_index(text, ".", -1), 1, 9), 9, "0").try_cast("long")
    decimal = F.when(seconds.between(-9_223_372_035, 9_223_372_035), seconds * F.lit(10**9).cast("long") + F.when(text.startswith("-"), -1).otherwise(1) * fraction)
    return F.coalesce(out, decimal)


def rewritten(text: Column) -> Column:
    """A date text as its eleven fields parted by bars. Its beginning tells the one form it may have, so one pattern is
    tried on each; a text that hasn't this form stays as it is."""
    begins = (r"^\d{4}[-/.]", r"^\d{8}[Tt\s]", r"^\d{1,2}[-/.]\d", r"^(?:[A-Za-z]{3,9}\.?,?\s+)?\d{1,2}[-\s/.]+[A-Za-z]", r"^[A-Za-z]")
    out = F.when(text.contains("|"), F.lit(None).cast("string"))
    for begin, (pattern, to) in zip(begins, FORMS):
        out = out.when(text.rlike(begin), F.regexp_replace(text, pattern, to))
    return out


def fields_of(line: Column) -> Column:
    """The eleven fields of what `rewritten` gives as an array, null if it has none of the known forms."""
    return F.when(line.startswith("d|") | line.startswith("n|"), F.split(line, r"\|", -1))


def days_since_epoch(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 of a date of the Gregorian calendar (y >= 1)."""
    y, m = y - F.when(m <= 2, 1).otherwise(0), F.when(m <= 2, m + 9).otherwise(m - 3)
    q = lambda a, b: F.floor(a / b)
    return y * 365 + q(y, 4) - q(y, 100) + q(y, 400) + q(m * 153 + 2, 5) + d - 1 - 719468


def days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


def origin_orders(fields: DataFrame, by: str) -> DataFrame:
    """`by` and _day_first: the order of numeric dates of each origin, by its dates that can be read in one way only.

    Dates that are impossible in either order are no evidence. An origin without evidence reads month first.
    """
    a, b = F.col("month").cast("int"), F.col("day").cast("int")
    votes = F.sum(F.when(a.between(13, 31) & b.between(1, 12), 1).when(b.between(13, 31) & a.between(1, 12), -1).otherwise(0))
    return fields.where("style = 'n'").groupBy(by).agg((votes > 0).alias("_day_first"))


def normalize_times(df: DataFrame, text: str, origin: str, device: str, data_source: DataFrame) -> DataFrame:
    """Adds instant_ns: the instant that column `text` names, null if none.

    Rules: surrounding white space means nothing; numbers as in number_ns; an offset in the text counts before a zone
    name; abbreviations have their usual meaning; without zone the text is the wall clock of `device`, whose zone comes
    from `data_source` (UTC if it has no valid one); a wall time that occurs twice is the earlier instant and a skipped
    one is read with the offset before the change; numeric dates follow their origin's order; two-digit years are 20yy;
    a date alone is midnight. Null, impossible and other texts give null, as does a zone name nobody knows.

    All expressions are built in. The zone table is bounded by the time zone database and broadcast; the devices' zones
    and the origins' orders are aggregates that Spark joins as their size allows.
    """
    spark = df.sparkSession
    zones = zone_table(spark)
    bare = df.withColumn("_t", F.regexp_replace(F.col(text), r"(?U)^[\s ﻿]+|[\s ﻿]+$", ""))
    parsed = bare.withColumns({"_number": number_ns(F.col("_t")), "_line": rewritten(F.col("_t"))}).withColumn("_f", fields_of(F.col("_line")))
    parsed = parsed.select("*", *[F.get("_f", F.lit(i)).alias(f"_{f}") for i, f in enumerate(FIELDS)]).drop("_line", "_f")
    numeric = bare.where(F.col("_t").rlike(r"^\d{1,2}[-/.]\d{1,2}[-/.]\d")).select(F.col(origin).alias("_origin"), fields_of(F.regexp_replace("_t", *FORMS[2])).alias("f"))
    orders = origin_orders(numeric.select("_origin", F.get("f", F.lit(0)).alias("style"), F.get("f", F.lit(2)).alias("month"), F.get("f", F.lit(3)).alias("day")), "_origin")
    own = device_zones(data_source, zones).withColumnsRenamed({"device_id": "_device", "device_zone": "_device_zone"})
    own = own.withColumn("_device_fixed", F.coalesce(fixed_offset(F.upper("_device_zone")), abbreviation_offset(F.col("_device_zone"))))
    parsed = parsed.join(orders, parsed[origin].eqNullSafe(orders["_origin"]), "left").join(own, parsed[device] == own["_device"], "left")

    swap = (F.col("_style") == "n") & F.coalesce("_day_first", F.lit(False))
    month_text, day_text = F.when(swap, F.col("_day")).otherwise(F.col("_month")), F.when(swap, F.col("_month")).otherwise(F.col("_day"))
    named = F.expr("(instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(substring(_month, 1, 3))) + 2) div 3")
    num = lambda c: F.when(F.length(c) > 0, c.cast("int")).otherwise(0)
    month = F.when(F.col("_month").rlike("^[A-Za-z]"), named.cast("int")).otherwise(F.when(month_text.rlike(r"^\d+$"), month_text.cast("int")))
    year = F.col("_year").cast("int")
    parsed = parsed.withColumns({"_y": F.when(F.length("_year") <= 2, year + 2000).otherwise(year), "_m": month, "_d": F.when(day_text.rlike(r"^\d+$"), day_text.cast("int"))})
    hour, minute, second, half = num(F.col("_hour")), num(F.col("_minute")), num(F.col("_second")), F.lower("_half")
    hour24 = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour)
    y, m, d = F.col("_y"), F.col("_m"), F.col("_d")
    sane = y.between(1700, 2250) & m.between(1, 12) & (d >= 1) & (d <= days_in_month(y, m)) & (minute < 60) & (second < 60) & F.when(F.length("_half") > 0, hour.between(1, 12)).otherwise(hour < 24)
    wall = days_since_epoch(y, m, d) * 86400 + hour24 * 3600 + minute * 60 + second
    said = F.when(F.length("_offset") > 0, F.when(F.upper("_offset") == "Z", 0).otherwise(fixed_offset(F.upper("_offset"))))
    zone = F.when(F.length("_zone") > 0, F.col("_zone"))
    unzoned = (F.length("_offset") == 0) & zone.isNull()
    use = F.when(unzoned, F.coalesce("_device_zone", F.lit("UTC"))).when(F.length("_offset") == 0, zone)
    fixed = F.coalesce(said, F.when(unzoned, F.when(F.col("_device_zone").isNull(), 0).otherwise(F.col("_device_fixed"))).otherwise(F.coalesce(fixed_offset(F.upper(zone)), abbreviation_offset(zone))))
    parsed = parsed.withColumns({"_wall": F.when(sane, wall).cast("long"), "_fixed": fixed, "_use": use})
    year_key = F.when(F.col("_fixed").isNull(), F.greatest(F.lit(FIRST_YEAR), F.least(F.lit(LAST_YEAR), F.col("_y"))))
    z = zones.select(F.col("zone").alias("_z"), F.col("year").alias("_zy"), F.col("spans").alias("_spans"))
    out = parsed.withColumn("_yk", year_key).join(F.broadcast(z), (F.col("_use") == F.col("_z")) & (F.col("_yk") == F.col("_zy")), "left")
    offset = F.coalesce("_fixed", wall_offset(F.col("_wall"), F.col("_spans")))
    fraction = F.rpad(F.substring("_fraction", 1, 9), 9, "0").cast("long")
    instant = (F.col("_wall") - offset) * 1_000_000_000 + fraction
    return out.select(*[df[c] for c in df.columns], F.coalesce("_number", instant).alias("instant_ns"))


def range_bounds(filter_range: DataFrame, data_source: DataFrame) -> DataFrame:
    """row_id, range_end ('start' or 'end') and instant_ns of each bound of a filter table that names an instant."""
    ends = F.explode(F.array(F.struct(F.lit("start").alias("range_end"), F.col("start_time").alias("text")), F.struct(F.lit("end").alias("range_end"), F.col("end_time").alias("text"))))
    rows = filter_range.select("row_id", "device_id", "origin", ends.alias("x")).select("row_id", "device_id", "origin", "x.*").where("text is not null")
    return normalize_times(rows, "text", "origin", "device_id", data_source).where("instant_ns is not null").select("row_id", "range_end", "instant_ns")
