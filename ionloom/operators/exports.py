"""Tables for people: wide integration tables, annotation columns, reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integration_table(matrix: DataFrame, pixels: DataFrame, features: DataFrame, by: Sequence[str], pixel: str, feature: str, mz: str, value: str, most_columns: int = 5_000) -> DataFrame:
    """by, x, y and a column per feature named by its m/z with four decimals; what is not detected is 0.

    The columns are listed from the feature table first (no more than
    most_columns), so the pivot needs no pass over the values for them.
    """
    heads = [r[0] for r in features.where(F.col(mz).isNotNull()).select(F.format_string("%.4f", mz).alias("h")).distinct().orderBy(F.col("h").cast("double")).limit(most_columns + 1).collect()]
    if len(heads) > most_columns:
        raise ValueError(f"more than {most_columns} columns")
    named = matrix.join(features.select(feature, F.format_string("%.4f", mz).alias("_h")), feature)
    wide = named.groupBy(*by, pixel).pivot("_h", heads).agg(F.max(value))
    joined = pixels.select(*by, pixel, "x", "y").join(wide, [*by, pixel], "left")
    return joined.select(*by, pixel, "x", "y", *[F.coalesce(F.col(f"`{h}`"), F.lit(0.0)).alias(h) for h in heads])


def annotation_columns(axis: DataFrame, annotations: DataFrame, mz: str) -> DataFrame:
    """axis with the annotations of the feature of the same m/z (six decimals); -1 and blanks where there is none."""
    texts = [f.name for f in annotations.schema.fields if f.dataType.simpleString() == "string"]
    key = annotations.withColumn("_key", F.bround(mz, 6)).drop(mz).dropDuplicates(["_key"])
    out = axis.withColumn("_key", F.bround(mz, 6)).join(key, "_key", "left").drop("_key")
    return out.withColumn("feature_id", F.coalesce("feature_id", F.lit(-1))).na.fill("", texts)


def report(parts: dict[str, DataFrame], most_rows: int = 10_000) -> str:
    """JSON of small summary tables, rows in order of their columns; a table of more than most_rows is refused."""
    out = {}
    for name, df in parts.items():
        rows = df.orderBy(*df.columns).limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name} is no summary: more than {most_rows} rows")
        out[name] = [r.asDict(recursive=True) for r in rows]
    return json.dumps(out, default=str, sort_keys=True)


def upsampled(grid: DataFrame, by: Sequence[str], x: str, y: str, factor: int) -> DataFrame:
    """Every cell as factor x factor cells of the same value."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    return grid.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).withColumn(x, F.col(x) * factor + F.col("_i")).withColumn(y, F.col(y) * factor + F.col("_j")).drop("_i", "_j")


def composite(channels: DataFrame, by: Sequence[str], red: str, green: str, blue: str, mode: str = "sum") -> DataFrame:
    """by and r, g, b from 0 to 255: channels added up, or their maximum."""
    fold = {"sum": F.sum, "max": F.max}[mode]
    byte = lambda c: F.round(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), fold(c)))).cast("int")
    return channels.groupBy(*by).agg(byte(red).alias("r"), byte(green).alias("g"), byte(blue).alias("b"))


def colour_ramp(anchors: Sequence[tuple[int, int, int]], steps: int = 256) -> list[int]:
    """steps colours as 0xRRGGBB numbers, evenly between the anchors."""
    out = []
    for k in range(steps):
        at = k * (len(anchors) - 1) / (steps - 1)
        i = min(int(at), len(anchors) - 2)
        r, g, b = (round(x + (y - x) * (at - i)) for x, y in zip(anchors[i], anchors[i + 1], strict=True))
        out.append(r << 16 | g << 8 | b)
    return out


def colourised(grid: DataFrame, value: str, vmin: str, vmax: str, ramp: Sequence[int]) -> DataFrame:
    """grid with rgba: the ramp's colour for a value between vmin and vmax (cut to them), opaque; transparent where there is no value."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col(value) - F.col(vmin), F.col(vmax) - F.col(vmin))))
    place = F.floor(F.coalesce(share, F.lit(0.0)) * (len(ramp) - 1) + 0.5).cast("int")
    colour = F.get(F.array(*[F.lit(c) for c in ramp]), place).cast("bigint")
    return grid.withColumn("rgba", F.when(F.col(value).isNotNull() & ~F.isnan(value), colour * 256 + 255).otherwise(F.lit(0).cast("bigint")))


def write_rasters(grid: DataFrame, by: Sequence[str], folder: str) -> None:
    """A folder of raster tables (y, x, value, rgba and what else grid has), a part per group of by; only groups that grid has are replaced."""
    grid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)
