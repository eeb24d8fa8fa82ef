"""Streams of cell contributions (ts, layer, i, j, v) to windowed sums, and to a store that later batches add to.

The reference data have no streams; these let an instrument feed the same tables that the batch operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(cells: DataFrame, length: str, late: str, ts: str = "ts") -> DataFrame:
    """(start, layer, i, j, v): sums in tumbling windows; contributions later than the watermark are left out. Works on batches too."""
    per = cells.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), "layer", "i", "j").agg(F.sum("v").alias("v"))
    return per.select(F.col("w.start").alias("start"), "layer", "i", "j", "v")


def append_sums(cells: DataFrame, path: str, checkpoint: str):
    """A query that writes each batch's partial sums, parted by layer, under its batch number: a batch that is repeated replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("layer", "i", "j").agg(F.sum("v").alias("v"))
        sums.write.mode("overwrite").partitionBy("layer").parquet(f"{path}/batch={number}")

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def summed(spark, path: str) -> DataFrame:
    """The grid so far: the partial sums of all batches, added up."""
    return spark.read.parquet(path).groupBy("layer", "i", "j").agg(F.sum("v").alias("v"))
