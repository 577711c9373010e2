"""Time normalisation and implausible readings over whole test tables, against separate plain-Python statements."""

import math
import os
import re
import statistics
import zoneinfo
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from sensorframe.plans import problems
from sensorframe.sources.tables import load

FOLDER = os.environ.get("SENSORFRAME_TESTDATA", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
HOURS = {"PST": -8, "PDT": -7, "MST": -7, "MDT": -6, "CST": -6, "CDT": -5, "EST": -5, "EDT": -4, "GMT": 0, "UTC": 0, "BST": 1, "CET": 1, "CEST": 2, "JST": 9}
EPOCH = datetime(1970, 1, 1)
PLAIN = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y%m%dT%H%M%S", "%a, %d %b %Y %H:%M:%S", "%d-%b-%y %H:%M:%S", "%b %d, %Y %I:%M:%S %p", "%d.%m.%Y %H:%M"]
DAY_FIRST = ["%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M"]
MONTH_FIRST = ["%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y %I:%M %p"]


def hours(sign, h, m):
    return (1 if sign == "+" else -1) * (int(h) * 3600 + int(m or 0) * 60)


def instant(text, day_first, zone_of_device):
    text = text.strip()
    if re.fullmatch(r"\d+", text):
        for per_s in (1, 10**3, 10**6, 10**9):
            ns = int(text) * (10**9 // per_s)
            if datetime(2015, 1, 1) <= EPOCH + timedelta(seconds=min(ns // 10**9, 10**10)) < datetime(2031, 1, 1):
                return ns
        return None
    if re.fullmatch(r"\d+\.\d+", text):
        a, b = text.split(".")
        return int(a) * 10**9 + int(b.ljust(9, "0")[:9])
    zone = offset = None
    if m := re.fullmatch(r"(.*?)\s*\[([^\]]+)\]", text):
        text, zone = m.groups()
    if m := re.fullmatch(r"(.*\d)\s*[Zz]", text):
        text, offset = m[1], 0
    elif m := re.fullmatch(r"(.*:\d\d(?:\.\d+)?|\d{8}T\d{6})\s*(?:GMT|UTC)?([+-])(\d\d):?(\d\d)?", text):
        text, offset = m[1], hours(*m.groups()[1:])
    if m := re.fullmatch(r"(.*?)\s+([A-Za-z_]+(?:/[A-Za-z_/]+)+|[A-Z]{3,4})", text):
        text, zone = m.groups()
    fraction = 0
    if m := re.fullmatch(r"(.*:\d\d)\.(\d+)", text):
        text, fraction = m[1], int(m[2].ljust(9, "0")[:9])
    if re.match(r"\d{4}-", text):
        text = text.replace("T", " ").replace("t", " ")
    for form in PLAIN + (DAY_FIRST if day_first else MONTH_FIRST):
        try:
            at = datetime.strptime(text, form)
            break
        except ValueError:
            continue
    else:
        return None
    zone = zone or zone_of_device
    if offset is None:
        if zone in HOURS:
            offset = HOURS[zone] * 3600
        elif m := re.fullmatch(r"([+-])(\d\d):?(\d\d)", zone):
            offset = hours(*m.groups())
        else:
            offset = int(at.replace(tzinfo=zoneinfo.ZoneInfo(zone), fold=0).utcoffset().total_seconds())
    return (int((at - EPOCH).total_seconds()) - offset) * 10**9 + fraction


def test_bounds(spark):
    names, zones = zoneinfo.available_timezones(), defaultdict(set)
    for r in load(spark, FOLDER, "data_source").select("device_serial_number", "device_time_zone_name").distinct().collect():
        if r[1] in names or re.fullmatch(r"[+-](?:0\d|1[0-8]):[0-5]\d", r[1] or ""):
            zones[r[0]].add(r[1])
    rows = load(spark, FOLDER, "filter_range").collect()
    first = defaultdict(int)
    for r in rows:
        for t in (r.start_time, r.end_time):
            if m := re.match(r"\s*(\d{1,2})[/.](\d{1,2})[/.]\d{4}", t or ""):
                a, b = int(m[1]), int(m[2])
                first[r.origin] += (12 < a <= 31 and b <= 12) - (12 < b <= 31 and a <= 12)
    want = {}
    for r in rows:
        for end, t in (("start", r.start_time), ("end", r.end_time)):
            if t is not None and (x := instant(t, first[r.origin] > 0, min(zones[r.device_id], default="UTC"))) is not None:
                want[r.row_id, end] = x
    got = {(r.row_id, r.range_end): r.instant_ns for r in problems.p3_found(spark, FOLDER).collect()}
    assert got == want


def naive(series, low, high):
    """Spike and run times of one device's [(time, value)], by loops over the whole series."""
    diffs = [abs(b[1] - a[1]) for a, b in zip(series, series[1:]) if b[1] != a[1]]
    scale = statistics.median_low(diffs) / (0.6744897501960817 * math.sqrt(2)) if diffs else math.inf
    inside = [i for i, (_, v) in enumerate(series) if low <= v <= high]
    flagged: set[int] = set()
    for _ in range(3):
        new = set()
        for i in inside:
            t, v = series[i]
            sides = []
            for order in (range(i - 1, -1, -1), range(i + 1, len(series))):
                near = []
                for j in order:
                    if abs(series[j][0] - t) > 180_000_000 or len(near) == 5:
                        break
                    if j not in flagged and low <= series[j][1] <= high:
                        near.append(series[j][1])
                if near:
                    sides.append(statistics.median(near))
            if sides and abs(v - min(max(v, min(sides)), max(sides))) > 10 * scale:
                new.add(i)
        if new == flagged:
            break
        flagged = new
    out, run = set(), []
    for k, i in enumerate(inside):
        run = [*run, i] if i in flagged else []
        if run and (k + 1 == len(inside) or inside[k + 1] not in flagged):
            out |= {series[j][0] for j in run} if len(run) <= 2 else set()
    start = 0
    for i in range(1, len(series) + 1):
        if i == len(series) or series[i][1] != series[start][1]:
            if i - start >= 8:
                out |= {series[j][0] for j in range(start, i)}
            start = i
    return out


def test_readings(spark):
    got = {(r.signal, r.row_id) for r in problems.p6_found(spark, FOLDER).collect()}
    want = set()
    for signal, table, column, low, high in (("imu", "unpacked_imu", "acceleration_x", -32768, 32767), ("eda", "unpacked_eda", "raw_adc", 0, 1048575)):
        by = defaultdict(list)
        for r in load(spark, FOLDER, table).selectExpr("row_id", "data_point_metadata.device_id as d", "unix_micros(measurement_timestamp_utc) as t", f"{column} as v").collect():
            if r.d is not None and r.v is not None and r.v == r.v:
                by[r.d].append((r.t, r.v, r.row_id))
                if not low <= r.v <= high:
                    want.add((signal, r.row_id))
        for rows in by.values():
            bad = naive(sorted({(t, v) for t, v, _ in rows}), low, high)
            want |= {(signal, i) for t, _, i in rows if t in bad}
    assert got == want
