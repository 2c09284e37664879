"""Streams of evidence: duplicates dropped within a watermark, windowed summaries, fusion a batch.

The batch operators have no stream in their model; these wrap them for sources that never end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_repeats(stream: DataFrame, key: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """Each key once while its state is held; state older than the watermark goes."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, by: list[str], value: str, time: str, width: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(start, by..., n, total): counts and sums of tumbling or sliding windows."""
    t = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    g = t.groupBy(F.window(time, width, slide) if slide else F.window(time, width), *by)
    return g.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts a query that applies a batch operator to every micro-batch and writes it once.

    A batch's number names its folder, so a batch that runs again after a failure replaces its own output.
    """

    def write(df: DataFrame, number: int) -> None:
        operator(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
