"""Rows as they arrive: the batch rules for late and repeated rows on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_arrivals(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def without_repeats(rows: DataFrame, keys: Sequence[str], arrived: str, within: str = "60 days") -> DataFrame:
    """A row delivered again within the given time is dropped; state older than that is given up."""
    return rows.withWatermark(arrived, within).dropDuplicatesWithinWatermark(list(keys))


def counts_per_window(rows: DataFrame, arrived: str, by: Sequence[str], window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Rows per window of arrival; windows are final once rows may be no later than ``late``."""
    return rows.withWatermark(arrived, late).groupBy(F.window(arrived, window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes all that has arrived so far to Parquet and ends; run again, it goes on where it left off."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    query.awaitTermination()
    return query
