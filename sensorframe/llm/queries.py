"""Queries of the training-data problems, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load
from . import nearest, packing, tokens, truncation

TOLERANCE_US = 500_000


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = nearest.join_nearest(nearest.sensor_side(load(spark, d, "unpacked_imu")), nearest.sensor_side(load(spark, d, "unpacked_ppg")), TOLERANCE_US)
    return pairs.withColumnsRenamed({"left_id": "imu_row_id", "right_id": "ppg_row_id"})


def p7_stream(spark: SparkSession, d: str) -> DataFrame:
    """p7_found by the streaming join over both tables in order of time."""
    pairs = nearest.replay_nearest(nearest.sensor_side(load(spark, d, "unpacked_imu")), nearest.sensor_side(load(spark, d, "unpacked_ppg")), TOLERANCE_US)
    return pairs.withColumnsRenamed({"left_id": "imu_row_id", "right_id": "ppg_row_id"})


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(load(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from their ids."""
    return tokens.decode_ids(p8_ids(spark, d))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.token_lengths(load(spark, d, "documents")))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_fill(p9_containers(spark, d))


def p9_rules(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: pieces and tokens of each text that has any, and how far the fullest goes."""
    packed = p9_containers(spark, d)
    fullest = packing.container_fill(packed).agg(F.max("tokens").alias("fullest"))
    whole = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))
    ok = (F.col("longest") <= packing.CAPACITY) & (F.col("pieces") == F.greatest(F.ceil(F.col("tokens") / packing.CAPACITY), F.lit(1)))
    return whole.crossJoin(F.broadcast(fullest)).select("doc_id", (ok & (F.col("fullest") <= packing.CAPACITY)).alias("holds"))  # one row


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_documents(load(spark, d, "documents"))


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_share(load(spark, d, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p7_found, p7_stream, p8_ids, p8_decoded, p9_containers, p9_fill, p9_rules, p10_found, p10_sources)}


def oracle_sql() -> dict[str, str]:
    sql = {
        "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
        "p9_rules": "select doc_id, true as holds from documents",
        "p7_found": """with i as (select row_id, data_point_metadata.device_id as d, epoch_us(measurement_timestamp_utc) as t from unpacked_imu where data_point_metadata.device_id is not null),
            p as (select data_point_metadata.device_id as d, epoch_us(measurement_timestamp_utc) as t, min(row_id) as row_id from unpacked_ppg where data_point_metadata.device_id is not null group by 1, 2),
            b as (select i.row_id as imu, i.t, p.row_id, p.t as pt from i asof join p on i.d = p.d and i.t >= p.t),
            a as (select i.row_id as imu, i.t, p.row_id, p.t as pt from i asof join p on i.d = p.d and i.t < p.t),
            c as (select imu, row_id, pt, abs(t - pt) as far from b union all select imu, row_id, pt, abs(t - pt) from a),
            r as (select *, row_number() over (partition by imu order by far, pt, row_id) as n from c where far <= 500000)
            select imu as imu_row_id, row_id as ppg_row_id from r where n = 1""",
    }
    return sql | {"p7_stream": sql["p7_found"]}
