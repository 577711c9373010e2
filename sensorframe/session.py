"""Sessions in UTC."""

from __future__ import annotations

from pyspark.sql import SparkSession


def utc_session(app: str = "sensorframe", **conf: str) -> SparkSession:
    """A session whose time zone is UTC and that re-plans at run time; `conf` keys use __ for dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def require_utc(spark: SparkSession) -> None:
    """ValueError unless the session's time zone is UTC, which reading texts as timestamps relies on."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, it is {zone}")
