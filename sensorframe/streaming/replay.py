"""Tables replayed as streams, in the order of a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import file_system, shared_folder

FIRST_MS = 1_500_000_000_000  # modification time of the first file


def replay(table: DataFrame, order: Column, steps: int, files: int = 4) -> DataFrame:
    """A stream of the table's rows in about `steps` batches in the order of `order` (null first).

    The rows are written once to the shared folder, in `files` files a batch, whose modification times put them in order;
    so the file system must keep these, as HDFS and local ones do. A batch is a range of `order` and never one task's.
    """
    spark, path = table.sparkSession, shared_folder(table.sparkSession, "replay")
    table.withColumn("_order", order).repartitionByRange(steps * files, "_order").drop("_order").write.parquet(path)
    root, fs = file_system(spark, path)
    parts = sorted((s.getPath() for s in fs.listStatus(root) if s.getPath().getName().endswith(".parquet")), key=lambda p: p.getName())
    for i, p in enumerate(parts):
        fs.setTimes(p, FIRST_MS + 1000 * i, -1)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is and returns the rows of its batches, with their number as `batch`.

    Each batch is written to the shared folder under its number, so one that is run again replaces itself.
    """
    spark, out = stream.sparkSession, shared_folder(stream.sparkSession, name)
    keep = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    path, fs = file_system(spark, f"{out}/rows")
    if not fs.exists(path):  # no batch has run
        return spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0))
    return spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.IntegerType())])).option("basePath", f"{out}/rows").parquet(f"{out}/rows")
