"""Packets of samples rebuilt into evenly spaced series, with built-in expressions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

RATE_GUARD, ERROR = 0.20, 0.05


@dataclass(frozen=True)
class Signal:
    """A packed spec: its channels, whether its true timestamp is a timestamp, and how channels are named and cast."""

    channels: tuple[str, ...]
    true_is_timestamp: bool = True
    kind: str = "double"
    legacy_device: str | None = None  # pattern of devices whose packets have no true timestamps
    optional: tuple[str, ...] = ()  # channels only sensors 0 and 1 have; else null


SIGNALS: Mapping[str, Signal] = {
    "imu": Signal(("acceleration_x", "acceleration_y", "acceleration_z"), optional=("gyro_x", "gyro_y", "gyro_z")),
    "ppg": Signal(("green",)),
    "two_channel_ppg": Signal(("green", "green_2"), true_is_timestamp=False),
    "eda": Signal(("raw_adc",), legacy_device="^C2Q"),
    "picard_eda": Signal(("real_adc", "im_adc", "z2_adc"), true_is_timestamp=False),
    "ecg": Signal(("raw_adc",), kind="bigint"),
}


PACKET = ("start_ms", "sampling_rate", "sensor_id", "true_ms", "true_index")


def _renamed(packets: DataFrame, keys: Sequence[str], channels: Sequence[str], keep: Sequence[str]) -> tuple[DataFrame, list[str], list[str], list[str]]:
    """Packets with neutral names for the caller's columns, which so can't clash with the names used in between."""
    names = [[f"{kind}_{i}" for i in range(len(cols))] for kind, cols in (("key", keys), ("channel", channels), ("keep", keep))]
    own = [F.col(c) for c in PACKET if c in packets.columns]
    df = packets.select(*own, *[F.col(c).alias(n) for cols, ns in zip((keys, channels, keep), names) for c, n in zip(cols, ns)])
    return df, *names


def _back(df: DataFrame, keys: Sequence[str], channels: Sequence[str], keep: Sequence[str], extra: Sequence[str]) -> DataFrame:
    first = [F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)]
    return df.select(*first, *extra, *[F.col(f"channel_{i}").alias(c) for i, c in enumerate(channels)], *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])


def checked(packets: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Adds n, the packet's length. Packets without any sample are dropped, a channel without samples becomes nulls, and
    channels of different other lengths are an error."""
    sizes = [F.coalesce(F.size(c), F.lit(0)) for c in channels]
    longest = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    bad = F.lit(False)
    for s in sizes:
        bad = bad | ((s != 0) & (s != longest))
    df = packets.withColumn("n", F.when(bad, F.raise_error(F.lit("channels of a packet differ in length")).cast("int")).otherwise(longest)).where("n > 0")
    kinds = {c: packets.schema[c].dataType for c in channels}
    return df.withColumns({c: F.when(F.coalesce(F.size(c), F.lit(0)) == 0, F.array_repeat(F.lit(None), F.col("n")).cast(kinds[c])).otherwise(F.col(c)) for c in channels})


def _samples(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    zipped = F.arrays_zip(*channels)
    rest = [c for c in df.columns if c not in channels]
    return df.select(*rest, F.posexplode(zipped).alias("pos", "s")).select(*rest, "pos", *[F.col(f"s.{c}").alias(c) for c in channels])


def unpack_legacy(packets: DataFrame, keys: Sequence[str], channels: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """keys, timestamp_ms, sampling_rate, channels, keep: samples at the packet's start plus position by its rate.

    Where a packet's last sample would not come before the next packet's start, its samples from that start on are
    dropped. Packets have start_ms (double) and sampling_rate.
    """
    packets, k, c, x = _renamed(packets, keys, channels, keep)
    w = Window.partitionBy(*k).orderBy("start_ms")
    df = checked(packets, c).withColumn("next_ms", F.lead("start_ms").over(w))
    df = _samples(df, c).withColumn("timestamp_ms", F.col("start_ms") + F.col("pos") * 1000.0 / F.col("sampling_rate"))
    return _back(df.where(F.col("next_ms").isNull() | (F.col("timestamp_ms") < F.col("next_ms"))), keys, channels, keep, ["timestamp_ms", "sampling_rate"])


def unpack(packets: DataFrame, keys: Sequence[str], channels: Sequence[str], keep: Sequence[str] = (), on_rate: str = "error", drop_gaps: bool = False, exclude_first_rate: bool = False, error: float = ERROR, observation: Observation | None = None) -> DataFrame:
    """keys, timestamp_ms, channels, keep: one row for each sample, evenly spaced within each group of `keys`.

    Packets have start_ms (double), sampling_rate, true_ms (double?) and true_index (long?): sample true_index of the
    packet was taken at true_ms. Rates between true timestamps are compared with their median; where one differs by more
    than `error`, packets were lost: its samples give way to null samples at the median rate (with `drop_gaps` to none,
    though places are counted). A line through all times then spaces the samples evenly.

    A group without any true timestamp takes packet start plus length at its rate. A group with several sensor_ids is
    an error. Where the median differs by 20 % or more from the first packet's rate: `on_rate` 'error' raises, 'ignore'
    goes on, 'drop' leaves the group out (for unpack_legacy to take, see `rate_off`). Groups without a valid rate give
    no rows. After the result has been used, an `observation` has the number of groups whose rate is so far off as
    median_fs_error. Values are computed relative to the group's start; no array longer than a packet is built. Groups should
    be windows of bounded size.
    """
    if on_rate not in ("error", "ignore", "drop"):
        raise ValueError("on_rate must be error, ignore or drop")
    packets, k, c, x = _renamed(packets, keys, channels, keep)
    return _back(_unpack(packets, k, c, x, on_rate, drop_gaps, exclude_first_rate, error, observation), keys, channels, keep, ["timestamp_ms"])


def _unpack(packets: DataFrame, keys: Sequence[str], channels: Sequence[str], keep: Sequence[str], on_rate: str, drop_gaps: bool, exclude_first_rate: bool, error: float, observation: Observation | None) -> DataFrame:
    df = anchored(packets, keys, channels, error, exclude_first_rate)
    if observation is not None:
        far = F.abs(F.col("median") - F.col("nominal")) / F.col("nominal") >= RATE_GUARD
        df = df.observe(observation, F.count(F.when((F.col("order") == 1) & far, 1)).alias("median_fs_error"))
    off = F.abs(F.col("median") - F.col("nominal")) / F.col("nominal") >= RATE_GUARD
    if on_rate == "error":
        df = df.withColumn("median", F.when(F.coalesce(off, F.lit(False)), F.raise_error(F.lit("the sampling rate differs by 20 % or more from the nominal one")).cast("double")).otherwise(F.col("median")))
    elif on_rate == "drop":
        df = df.where(~F.coalesce(off, F.lit(False)))
    df = df.where("mean is not null")

    w = Window.partitionBy(*keys).orderBy("order")
    before, at_or_after, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(1, Window.unboundedFollowing)
    df = df.withColumns({"prev": F.last("a", True).over(before), "here": F.first("a", True).over(at_or_after), "next": F.first("a", True).over(after)})

    s = _samples(df, channels).withColumn("si", F.col("cum") + F.col("pos"))
    past = F.col("a").isNotNull() & (F.col("si") >= F.col("a.g"))
    s = s.withColumns({"from": F.when(past, F.col("a")).otherwise(F.col("prev")), "to": F.when(past, F.col("next")).otherwise(F.col("here"))})
    raw = (
        F.when(F.col("from").isNull(), F.col("to.t") - (F.col("to.g") - F.col("si")) * 1000.0 / F.col("mean"))
        .when(F.col("to").isNull(), F.col("from.t") + (F.col("si") - F.col("from.g")) * 1000.0 / F.col("mean"))
        .otherwise(F.col("from.t") + (F.col("si") - F.col("from.g")) * 1000.0 / F.col("to.fs"))
    )
    lost = F.col("from").isNotNull() & F.col("to").isNotNull() & ~F.col("to.ok")
    samples = s.where(~lost).select(*keys, raw.alias("raw"), F.coalesce("from.t", F.lit(-1e300)).alias("block"), F.col("si").alias("place"), F.lit(1).cast("long").alias("places"), F.lit(True).alias("real"), *channels, *keep)

    gap = df.where("a is not null and prev is not null and not a.ok")
    count = F.ceil((F.col("a.t") - F.col("prev.t")) * F.col("median") / 1000.0)
    kinds = {c: samples.schema[c].dataType for c in (*channels, *keep)}
    nulls = [F.lit(None).cast(kinds[c]).alias(c) for c in (*channels, *keep)]
    if drop_gaps:
        rows = gap.where(count > 0).select(*keys, F.lit(None).cast("double").alias("raw"), F.col("prev.t").alias("block"), F.lit(0).cast("long").alias("place"), F.floor((F.col("a.t") - F.col("prev.t")) * F.col("median") / 1000.0).alias("places"), F.lit(False).alias("real"), *nulls)
    else:
        k = gap.where(count > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).alias("k"))
        rows = k.select(*keys, (F.col("prev.t") + F.col("k") * 1000.0 / F.col("median")).alias("raw"), F.col("prev.t").alias("block"), F.col("k").alias("place"), F.lit(1).cast("long").alias("places"), F.lit(True).alias("real"), *nulls)
    union = samples.unionByName(rows)

    order = Window.partitionBy(*keys).orderBy("block", "place")
    group = Window.partitionBy(*keys)
    fit = union.withColumn("i", F.sum("places").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("places")).withColumn("base", F.min("raw").over(group))
    fit = fit.where("real").withColumn("y", F.col("raw") - F.col("base"))
    fit = fit.withColumns({"slope": F.regr_slope("y", F.col("i").cast("double")).over(group), "cut": F.regr_intercept("y", F.col("i").cast("double")).over(group)})
    at = F.col("base") + F.coalesce(F.col("cut") + F.col("slope") * F.col("i"), F.col("y"))
    return fit.select(*keys, at.alias("timestamp_ms"), *channels, *keep)


def anchored(packets: DataFrame, keys: Sequence[str], channels: Sequence[str], error: float = ERROR, exclude_first_rate: bool = False) -> DataFrame:
    """Checked packets with their place in the group (order, cum), anchor a (g, t, fs, ok), and the group's median, mean
    and nominal rate."""
    group = Window.partitionBy(*keys)
    w = group.orderBy("start_ms")
    df = checked(packets, channels)
    if "sensor_id" in packets.columns:
        several = F.min("sensor_id").over(group) != F.max("sensor_id").over(group)
        df = df.withColumn("n", F.when(F.coalesce(several, F.lit(False)), F.raise_error(F.lit("several sensors in a group")).cast("int")).otherwise(F.col("n")))
    df = df.withColumns({"order": F.row_number().over(w), "cum": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_true": F.count(F.when(F.col("true_ms").isNotNull() & F.col("true_index").isNotNull(), 1)).over(group), "nominal": F.first("sampling_rate").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    none = F.col("_true") == 0
    index = F.when(none, F.col("n") - 1).otherwise(F.col("true_index"))
    true = F.when(none, F.col("start_ms") + (F.col("n") - 1) * 1000.0 / F.col("sampling_rate")).otherwise(F.col("true_ms"))
    df = df.withColumns({"_g": F.when(index.isNotNull() & true.isNotNull(), F.col("cum") + index).cast("double"), "_t": F.when(index.isNotNull(), true)})
    w = group.orderBy("order")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    here = F.when(F.col("_g").isNotNull() & F.col("_t").isNotNull(), F.struct("_g", "_t"))
    df = df.withColumn("_here", here).withColumn("_last", F.last("_here", True).over(before))
    rate = 1000.0 * (F.col("_g") - F.coalesce("_last._g", F.lit(0.0))) / (F.col("_t") - F.coalesce("_last._t", F.lit(0.0)))
    df = df.withColumn("fs", F.when(F.col("_here").isNotNull(), rate))
    counted = F.when(F.col("_last").isNotNull(), F.col("fs")) if exclude_first_rate else F.col("fs")
    df = df.withColumn("median", F.percentile(counted, 0.5).over(group))
    df = df.withColumn("_ok", F.abs(F.col("fs") - F.col("median")) / F.col("median") <= error)
    df = df.withColumn("mean", F.avg(F.when(F.col("_ok"), F.col("fs"))).over(group))
    return df.withColumn("a", F.when(F.col("_here").isNotNull(), F.struct(F.col("_g").alias("g"), F.col("_t").alias("t"), F.col("fs"), F.coalesce("_ok", F.lit(False)).alias("ok")))).drop("_here", "_last", "_g", "_t", "_ok", "_true")


def rate_off(packets: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """The groups whose median rate differs by 20 % or more from the first packet's."""
    packets, k, c, _ = _renamed(packets, keys, channels, ())
    df = anchored(packets, k, c)
    return _back(df.where(F.abs(F.col("median") - F.col("nominal")) / F.col("nominal") >= RATE_GUARD), keys, (), (), ()).distinct()


def unpack_or_legacy(packets: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """unpack, with unpack_legacy for the groups of rate_off."""
    off = rate_off(packets, keys, channels)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    legacy = packets.alias("l").join(off.alias("r"), same, "left_semi")
    return unpack(packets, keys, channels, on_rate="drop").unionByName(unpack_legacy(legacy, keys, channels).drop("sampling_rate"))


def unpack_signal(packets: DataFrame, signal: str, sensor_id: str | None = None, data_source: DataFrame | None = None, window: str = "1 hour", on_rate: str = "error") -> DataFrame:
    """Data points of the samples of a packed spec (a key of SIGNALS), one row each, with derived metadata.

    Packets are grouped by participant, device and window of their measurement time. With `sensor_id`, packets of other
    sensors are left out; the packet's own sensor_id or its data source's counts, so `data_source` must be given. Groups
    whose rate is off are handled as `on_rate` of unpack says; 'legacy' takes unpack_legacy for them.
    """
    from .keys import Fixed, key_by, key_time, measured
    from .metadata import derived_metadata
    from .predicates import with_sources

    spec = SIGNALS[signal]
    df = packets
    if sensor_id is not None:
        if data_source is None:
            raise ValueError("choosing a sensor needs the data sources")
        own = F.col("sensor_id").cast("string")
        named = with_sources(df.withColumn("_own", own).drop("sensor_id"), data_source, ["sensor_id"])
        df = named.where((F.col("_own") == sensor_id) | (F.col("sensor_id") == sensor_id)).drop("sensor_id").withColumnRenamed("_own", "sensor_id")
    channels = list(spec.channels) + [c for c in spec.optional if c in packets.columns and sensor_id in (None, "0", "1")]
    keys = ["device_id", "participant_id", "participant_namespace", "start_time_range_micros", "end_time_range_micros"]
    df = key_time(key_by(df, True, True), Fixed(window), measured())
    ms: Column = F.unix_micros("true_timestamp_millis") / 1000.0 if spec.true_is_timestamp else F.col("true_timestamp_millis").cast("double")
    p = df.select(*keys, (F.unix_micros("measurement_timestamp_utc") / 1000.0).alias("start_ms"), F.col("sampling_rate").cast("double").alias("sampling_rate"), "sensor_id", ms.alias("true_ms"), F.col("true_timestamp_sample_index").alias("true_index"), *channels)
    plain = (lambda x: unpack_or_legacy(x, keys, channels)) if on_rate == "legacy" else (lambda x: unpack(x, keys, channels, on_rate=on_rate))
    if spec.legacy_device:
        old = F.coalesce(F.col("device_id").rlike(spec.legacy_device), F.lit(False))
        out = plain(p.where(~old)).unionByName(unpack_legacy(p.where(old), keys, channels).drop("sampling_rate"))
    else:
        out = plain(p)
    meta = derived_metadata(df, keys)
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    out = out.alias("o").join(meta.alias("m"), same)
    missing = [F.lit(None).cast(spec.kind).alias(c) for c in spec.optional if c not in channels]
    return out.select(F.col("m.derived_metadata").alias("data_point_metadata"), F.timestamp_micros(F.round(F.col("o.timestamp_ms") * 1000).cast("long")).alias("measurement_timestamp_utc"), *[F.col(f"o.{c}").cast(spec.kind).alias(c) for c in channels], *missing)
