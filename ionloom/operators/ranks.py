"""Ranks and exact percentiles within groups of any size.

Rows are sorted by range over all groups, so a large group is cut into many
ranges. A row's rank is its place in its range plus how many rows of its group
lie in the ranges before: one row per group and range, of which a group has no
more than there are partitions. What has been sorted is written, as ranges are
sampled and a second computation might cut them elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.session import stored

#: Rows, or distinct values, up to which one task may hold those of a group.
HELD_VALUES = 1_000_000


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, most_held: int = HELD_VALUES) -> DataFrame:
    """df with name: 1..n within by, in this order, which must tell all rows of a group apart for equal results on every run. NULL is a group like any other.

    No more than most_held rows in all are numbered by a window, as no task can then hold more; else by ranges. The numbers are the same.
    """
    df = stored(df)
    if df.count() <= most_held:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    placed = stored(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_range").alias("_r"), "_before")
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    met = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)] + [F.col("_range") == F.col("_r")]
    return placed.withColumn("_in", inside).join(before, met).select(*df.columns, (F.col("_before") + F.col("_in")).cast("int").alias(name))


def percentiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], most_held: int = HELD_VALUES) -> DataFrame:
    """by, n, q (ARRAY<DOUBLE>: an exact, linearly interpolated percentile per share).

    NULL and NaN do not count; a group without values has no row. Equal values
    are counted first. Where few distinct ones are left a task holds those of a
    group; else they are sorted by range and only the ranges in which a wanted
    place lies are looked at.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    counted = stored(rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")))
    if counted.count() <= most_held:
        return counted.groupBy(*by).agg(F.sum("_c").alias("n"), F.percentile("_v", F.array(*map(F.lit, shares)), F.col("_c")).alias("q"))
    placed = stored(counted.repartitionByRange(*by, "_v").sortWithinPartitions(*by, "_v").withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy(*by, "_range").agg(F.sum("_c").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.withColumn("_before", before).join(sums.groupBy(*by).agg(F.sum("_s").alias("n")), list(by)) if by else sums.withColumn("_before", before).crossJoin(F.broadcast(sums.agg(F.sum("_s").alias("n"))))
    # Places from 0: the two between which each share falls, and the ranges that hold them.
    at = [(i, side, share) for i, share in enumerate(shares) for side in (0, 1)]
    exact = lambda share: F.lit(float(share)) * (F.col("n") - 1)
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), (F.ceil if side else F.floor)(exact(share)).cast("bigint").alias("place")) for i, side, share in at])).alias("w")
    asked = parts.select(*by, "_range", "_before", "_s", "n", wanted).where((F.col("w.place") >= F.col("_before")) & (F.col("w.place") < F.col("_before") + F.col("_s")))
    asked = asked.groupBy(*by, "_range", "_before", "n").agg(F.collect_list("w").alias("_w"))
    until = F.sum("_c").over(Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    held = placed.join(asked, [*by, "_range"]).withColumn("_until", F.col("_before") + until)
    hits = held.select(*by, "n", "_v", F.explode(F.filter("_w", lambda w: (w["place"] < F.col("_until")) & (w["place"] >= F.col("_until") - F.col("_c")))).alias("w"))
    ends = hits.groupBy(*by, "n", F.col("w.i").alias("i")).agg(F.max(F.when(F.col("w.side") == 0, F.col("_v"))).alias("lo"), F.max(F.when(F.col("w.side") == 1, F.col("_v"))).alias("hi"))
    share = F.element_at(F.array(*map(F.lit, map(float, shares))), F.col("i") + 1)
    place = share * (F.col("n") - 1)
    between = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((F.ceil(place) - place) * F.col("lo") + (place - F.floor(place)) * F.col("hi"))
    return ends.groupBy(*by, "n").agg(F.array_sort(F.collect_list(F.struct("i", between.alias("q")))).alias("l")).select(*by, "n", F.transform("l", lambda x: x["q"]).alias("q"))
