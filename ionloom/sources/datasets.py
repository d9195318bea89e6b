"""Externally analysed matrices: what they hold, and matching them to our pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inspect(df: DataFrame) -> dict:
    """Rows, value columns and, for every text column, how many distinct values it has: those with few may name samples."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    numbers = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("float", "double")]
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(texts)]).first()
    return {"n_rows": counts["n"], "value_columns": numbers, "sample_columns": {c: counts[f"d{i}"] for i, c in enumerate(texts)}, "has_mz": "mz" in df.columns}


def match_pixels(rows: DataFrame, pixels: DataFrame, sample: str, name: str, suffix: str = r"-[^-]*$") -> DataFrame:
    """rows with the pixel_id of our pixels: by the number in their name (a suffix taken off), else by x and y.

    All rows must find a pixel of their own; the first that does not fails the read.
    """
    by_name = rows.withColumn("_id", F.regexp_replace(name, suffix, "").try_cast("bigint"))
    one = by_name.join(pixels.select(sample, F.col("pixel_id").alias("_id"), F.col("pixel_id").alias("_by_name")), [sample, "_id"], "left").drop("_id")
    two = one.join(pixels.groupBy(sample, "x", "y").agg(F.min("pixel_id").alias("_by_place")), [sample, "x", "y"], "left")
    found = F.coalesce("_by_name", "_by_place")
    checked = F.when(found.isNull(), F.raise_error(F.concat(F.lit("no pixel for row "), F.col(name))).cast("bigint")).otherwise(found)
    return two.withColumn("pixel_id", checked).drop("_by_name", "_by_place")
