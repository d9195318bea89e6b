"""Table lifecycle: latest rows, upserts, replacement, snapshots, provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMANDS = T.StructType([T.StructField(n, t) for n, t in (("command_id", T.StringType()), ("run_id", T.StringType()), ("sample_id", T.LongType()), ("command_name", T.StringType()), ("arguments", T.StringType()), ("executed_at", T.TimestampType()))])


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest order columns (NULL is least); combined before the shuffle, so repeated keys do not gather.

    Every column is picked by an aggregate of its own, and all pick the same
    row, as they see the rows in one order: columns that are not used later are
    neither read nor moved.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    # One number, where the order allows it, keeps the aggregate's buffers flat.
    number = {"timestamp": F.unix_micros, "bigint": lambda c: c, "int": lambda c: c.cast("bigint")}.get(kinds[order[0]]) if len(order) == 1 else None
    at = F.coalesce(number(F.col(order[0])), F.lit(-(2**63))) if number else F.struct(*order)
    best = df.groupBy(*keys).agg(*[F.max_by(F.col(f"`{c}`"), at).alias(c) for c in df.columns if c not in keys])
    return best.select(*[F.col(f"`{c}`") for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with the rows of new, which take the place of rows with the same (NULL-safe) key."""
    fresh = new.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]).distinct()
    kept = old.join(fresh, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def move_rows(source: DataFrame, keys: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that are moved)."""
    return source.join(keys.select(*on).distinct(), list(on), "left_anti"), source.join(keys.select(*on).distinct(), list(on), "left_semi")


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Writes df; of what is at path only the partitions that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def snapshot(tables: Mapping[str, DataFrame], path: str) -> None:
    """Writes a version of every table under path."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, current: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The snapshot's tables with the columns of the current ones: missing ones are NULL, others are left out."""
    out = {}
    for name, df in current.items():
        old = spark.read.parquet(f"{path}/{name}")
        out[name] = old.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in old.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return out


def command_row(spark: SparkSession, name: str, run_id: str, arguments: Mapping, sample_id: int | None = None) -> DataFrame:
    """A row of the commands table for a step that was run."""
    import json
    import uuid
    from datetime import UTC, datetime

    return spark.createDataFrame([(str(uuid.uuid4()), run_id, sample_id, name, json.dumps(arguments, sort_keys=True), datetime.now(UTC))], COMMANDS)


def was_run(commands: DataFrame, name: str, run_id: str, sample_id: int | None = None) -> bool:
    return not commands.where((F.col("command_name") == name) & (F.col("run_id") == run_id) & F.col("sample_id").eqNullSafe(F.lit(sample_id).cast("bigint"))).isEmpty()


def last_arguments(commands: DataFrame, schema: str) -> DataFrame:
    """command_name, sample_id, args: the arguments of each step's latest run, read with the schema."""
    last = commands.groupBy("command_name", "sample_id").agg(F.max_by("arguments", F.struct("executed_at", "command_id")).alias("_a"))
    return last.select("command_name", "sample_id", F.from_json("_a", schema).alias("args"))


def quoted_lines(df: DataFrame, columns: Sequence[str], separator: str = ",") -> DataFrame:
    """line: delimited text with every text quoted and numbers bare; missing numbers are empty, missing texts \"\"."""
    def cell(c: str):
        if isinstance(df.schema[c].dataType, T.StringType):
            return F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return df.select(F.concat_ws(separator, *[cell(c) for c in columns]).alias("line"))
