"""Target lists: CSV or tab-separated text of compounds to look for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions.chemistry import neutral_mass


def read_target_list(spark: SparkSession, path: str) -> DataFrame:
    """name, formula, inchikey, neutral_mass, target_mz, source_file, line.

    The header is read in any case; name is needed, and formula or mz. The first
    bad row (no name, neither formula nor m/z, an unreadable formula or m/z)
    fails the read and says why.
    """
    separator = "\t" if path.lower().endswith((".txt", ".tsv")) else ","
    raw = spark.read.option("header", True).option("sep", separator).option("mode", "FAILFAST").csv(path)
    names = {c.strip().lower(): c for c in raw.columns}
    if "name" not in names or not {"formula", "mz"} & set(names):
        raise ValueError(f"{path}: columns name and formula or mz are needed")
    text = lambda c: F.nullif(F.trim(F.col(f"`{names[c]}`")), F.lit("")) if c in names else F.lit(None).cast("string")
    df = raw.select(text("name").alias("name"), text("formula").alias("formula"), text("inchikey").alias("inchikey"), text("mz").alias("_mz"), F.lit(path).alias("source_file"), F.monotonically_increasing_id().alias("line"))
    df = df.withColumn("neutral_mass", neutral_mass(F.col("formula"))).withColumn("target_mz", F.col("_mz").try_cast("double"))
    problem = (
        F.when(F.col("name").isNull(), "no name")
        .when(F.col("formula").isNull() & F.col("_mz").isNull(), "neither formula nor m/z")
        .when(F.col("formula").isNotNull() & F.col("neutral_mass").isNull(), "unreadable formula")
        .when(F.col("_mz").isNotNull() & F.coalesce(~(F.col("target_mz") > 0), F.lit(True)), "unreadable m/z")
    )
    checked = F.when(problem.isNotNull(), F.raise_error(F.concat(F.col("source_file"), F.lit(": "), problem)).cast("string")).otherwise(F.col("name"))
    return df.select(checked.alias("name"), "formula", "inchikey", "neutral_mass", "target_mz", "source_file", "line")


def read_target_lists(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several lists one after the other; nothing is made distinct."""
    return reduce(DataFrame.unionByName, [read_target_list(spark, p) for p in paths])
