"""Reading the columnar tables a query names."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The Parquet table `table` in `folder`, a file or a folder of files."""
    return spark.read.parquet(os.path.join(folder, f"{table}.parquet"))


def meta(field: str) -> Column:
    """A field of data_point_metadata."""
    return F.col(f"data_point_metadata.{field}")


def arrival() -> Column:
    """When a data point reached the store: the store's write time, else the bucket's."""
    return F.coalesce(meta("sensor_store_metadata.sensor_store_write_time"), meta("echo_metadata.bucket_write_time"))


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """(path, its file system) as Hadoop knows them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_atomically(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """Writes a small file so that readers see all of it or nothing. Without `overwrite`, an error if it is there already:
    of several writers one wins. By the file manager of Spark's own streaming logs, so as safe as the file system allows."""
    p, _ = file_system(spark, path)
    manager = getattr(spark.sparkContext._jvm.org.apache.spark.sql.execution.streaming.checkpointing, "CheckpointFileManager$")
    files = getattr(manager, "MODULE$").create(p.getParent(), spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(p.getParent()):
        files.mkdirs(p.getParent())
    out = files.createAtomic(p, overwrite)
    try:
        out.write(bytearray(text.encode()))
        out.close()
    except Exception:
        out.cancel()
        raise


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    p, fs = file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the cluster's shared checkpoint folder (spark.checkpoint.dir), for written tables; what is in it
    is deleted when the application ends.

    Where neither the setting nor the context's checkpoint folder is there, SENSORFRAME_SHARED counts. Without that, a
    session on one machine (local[n]) takes a temporary folder of it; on a cluster it is an error, as executors would each
    write to a disk of their own.
    """
    import tempfile
    import uuid

    sc = spark.sparkContext
    set_ = sc._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (set_.get() if set_.isDefined() else None) or os.environ.get("SENSORFRAME_SHARED")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "sensorframe-shared")
    path, fs = file_system(spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{path.toString()}/t"
