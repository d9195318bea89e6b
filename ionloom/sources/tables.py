"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; its schema comes from the Parquet footer."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether df has at most most_rows rows; reads no more than that plus one."""
    return df.limit(most_rows + 1).count() <= most_rows
