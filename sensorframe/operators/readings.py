"""Changes within a reading: which redelivered rows say something new."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def run_changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], bucket: Column | None = None) -> DataFrame:
    """Rows whose `values` differ from the row before them of the same `keys`, in `order`; the first row always counts.

    Null equals null and NaN equals NaN; null keys form their own group. With `bucket`, a value that never falls along
    `order`, runs of copies are first thinned within (keys, bucket) and then across buckets. Dropping copies of the
    row before is associative, so both ways give the same rows, and a key that holds a third of all rows is worked on
    by as many tasks as it has buckets. Adds `is_first` and `previous_<value>` columns. An empty table gives no rows.
    """
    now = F.struct(*[F.col(v) for v in values])

    def thin(d: DataFrame, by: list) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        d = d.withColumns({"_before": F.lag(now).over(w), "_rn": F.lag(F.lit(1)).over(w)})
        return d.where(F.col("_rn").isNull() | ~F.col("_before").eqNullSafe(now))

    if bucket is not None:
        df = thin(df.withColumn("_bucket", bucket), [*keys, "_bucket"]).drop("_before", "_rn", "_bucket")
    out = thin(df, list(keys))
    return out.withColumns({"is_first": F.col("_rn").isNull()} | {f"previous_{v}": F.col(f"_before.{v}") for v in values}).drop("_before", "_rn")


def effective_rows(points: DataFrame) -> DataFrame:
    """The data points that change a reading (device, spec, measurement time), with arrivals in us.

    Rows without arrival or measurement time, and deleted rows, count as absent. Columns: row_id, device_id,
    data_spec_name, measured_us, arrival_us, rate, confidence, is_first, previous_rate, previous_confidence.
    """
    from ..sources.tables import arrival, meta

    rows = points.where(meta("echo_metadata.deleted_time").isNull()).select(
        "row_id",
        meta("device_id").alias("device_id"),
        "data_spec_name",
        F.unix_micros("measurement_timestamp_utc").alias("measured_us"),
        F.unix_micros(arrival()).alias("arrival_us"),
        "rate",
        "confidence",
    )
    rows = rows.where("arrival_us is not null and measured_us is not null")
    return run_changes(rows, ["device_id", "data_spec_name", "measured_us"], ["arrival_us", "row_id"], ["rate", "confidence"], F.floor(F.col("arrival_us") / DAY_US))
