"""Interval, ppm, nearest and as-of joins as equi-joins on buckets.

Catalyst has no index for a range condition and falls back to a nested loop.
Here every range becomes a set of buckets, the buckets are joined by equality,
and the exact condition is the residual, so the joins shuffle by key, spill,
and are split by AQE where a bucket is hot. A pair meets in exactly one bucket,
so nothing has to be made distinct afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _renamed(df: DataFrame, keep: Sequence[str], others: Sequence[str], suffix: str = "_right") -> DataFrame:
    """Columns that clash with the other side's get a suffix; keep are join keys."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c in set(others) - set(keep)})


def interval_join(points: DataFrame, spans: DataFrame, at: str, lo: str, hi: str, by: Sequence[str] = (), width: float = 60.0) -> DataFrame:
    """Every point with every span that holds it, both ends included.

    by: equality columns of both sides. NULL or NaN positions and bounds, and
    spans whose end lies before their start, match nothing. Columns of spans
    that clash get the suffix _right. width should be near a usual span length.
    A span that covers many buckets is listed in each, so very long spans call
    for a larger width.
    """
    b = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    spans = _renamed(spans, by, points.columns)
    lo, hi = (c + "_right" if c in points.columns else c for c in (lo, hi))
    left = points.where(F.col(at).isNotNull() & ~F.isnan(F.col(at).cast("double"))).withColumn("_b", b(F.col(at)))
    right = spans.where((F.col(lo) <= F.col(hi)) & ~F.isnan(F.col(lo).cast("double")) & ~F.isnan(F.col(hi).cast("double"))).withColumn("_b", F.explode(F.sequence(b(F.col(lo)), b(F.col(hi)))))
    return left.join(right, [*by, "_b"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("_b")


def ppm_bucket(mz: Column, ppm: float) -> Column:
    """Logarithmic bucket twice as wide as the tolerance."""
    return F.floor(F.log(mz) / F.lit(_log1p(2 * ppm * 1e-6))).cast("bigint")


def _log1p(x: float) -> float:
    import math

    return math.log1p(x)


def ppm_join(left: DataFrame, right: DataFrame, left_mz: str, right_mz: str, ppm: float, by: Sequence[str] = ()) -> DataFrame:
    """Pairs with right*(1-ppm) <= left <= right*(1+ppm), both ends included.

    Non-positive, NULL and NaN m/z match nothing. Clashing columns of right get
    the suffix _right. The right side is listed in three buckets; let it be the smaller.
    """
    right = _renamed(right, by, left.columns)
    name = right_mz + "_right" if right_mz in set(left.columns) - set(by) else right_mz
    real = lambda c: (F.col(c) > 0) & ~F.isnan(F.col(c).cast("double"))
    probe = left.where(real(left_mz)).withColumn("_b", ppm_bucket(F.col(left_mz), ppm))
    base = ppm_bucket(F.col(name), ppm)
    build = right.where(real(name)).withColumn("_b", F.explode(F.array(base - 1, base, base + 1)))
    tolerance = F.col(name) * F.lit(ppm * 1e-6)
    return probe.join(build, [*by, "_b"]).where(F.col(left_mz).between(F.col(name) - tolerance, F.col(name) + tolerance)).drop("_b")


def nearest_ppm(left: DataFrame, right: DataFrame, left_id: Sequence[str], left_mz: str, right_mz: str, ppm: float, keep: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Every left row with the keep columns of the right row nearest in ppm, NULL if none is within ppm.

    left_id identifies left rows; rows that share it get the same answer. Equal
    distances go to the lower m/z, then the smaller keep columns.
    """
    probe = left.select(*left_id, *[c for c in by if c not in left_id], F.col(left_mz).alias("_mz")).where("_mz is not null").distinct()
    pairs = ppm_join(probe, right.select(*by, F.col(right_mz).alias("_ref"), *keep), "_mz", "_ref", ppm, by)
    order = F.struct(F.abs((F.col("_mz") - F.col("_ref")) / F.col("_ref")).alias("d"), F.col("_ref").alias("m"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    best = pairs.groupBy(*left_id, "_mz").agg(F.min_by(F.struct(*keep, F.col("_ref").alias("matched_mz")), order).alias("_m"))
    best = best.select(*[F.col(c).alias(f"_id{i}") for i, c in enumerate(left_id)], "_mz", "_m")
    cond = [F.col(c).eqNullSafe(F.col(f"_id{i}")) for i, c in enumerate(left_id)] + [F.col(left_mz) == F.col("_mz")]
    joined = left.join(best, cond, "left")
    return joined.select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in keep], F.col("_m.matched_mz").alias("matched_mz"))


def asof(left: DataFrame, right: DataFrame, on: str, right_on: str, value: str, by: Sequence[str] = (), direction: str = "backward", width: float = 600.0) -> DataFrame:
    """left with value of the last right row at or before (backward) or the first at or after (forward).

    Equal right positions: the largest value backward, the smallest forward. Two
    levels, so that no key has to fit one task: within (by, bucket) by a window,
    across buckets by the last value of each, one row per occupied bucket.
    Rows with a NULL or NaN position, or a NULL by column, get NULL.
    """
    back = direction == "backward"
    b = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    real = F.col("_on").isNotNull() & ~F.isnan(F.col("_on").cast("double"))
    r = right.select(*by, F.col(right_on).alias("_on"), F.col(value).alias("_v")).where(real)
    r = r.groupBy(*by, "_on").agg((F.max if back else F.min)("_v").alias("_v"))
    l = left.withColumn("_on", F.col(on)).withColumn("_side", F.lit(1))  # noqa: E741
    rows = l.unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True).withColumn("_b", b(F.when(real, F.col("_on"))))
    local = Window.partitionBy(*by, "_b").orderBy("_on" if back else F.desc("_on"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_in", F.last(F.when(F.col("_side") == 0, F.struct("_v")), ignorenulls=True).over(local)).where("_side = 1").drop("_v", "_side")
    edge = r.withColumn("_b", b(F.col("_on"))).groupBy(*by, "_b").agg((F.max_by if back else F.min_by)("_v", "_on").alias("_edge"))
    wanted = inside.select(*by, "_b").distinct().join(edge, [*by, "_b"], "full")
    across = Window.partitionBy(*by).orderBy("_b" if back else F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = wanted.withColumn("_carry", F.last("_edge", ignorenulls=True).over(across)).select(*by, "_b", "_carry")
    out = inside.join(carried, [*by, "_b"], "left")
    return out.select(*left.columns, F.coalesce(F.col("_in._v"), F.col("_carry")).alias(value))


def nearest(left: DataFrame, right: DataFrame, on: str, right_on: str, key: str, by: Sequence[str] = (), width: float = 600.0) -> DataFrame:
    """left with key and position of the nearest right row, without tolerance; ties go to the lower position, then the smaller key."""
    r = right.where(F.col(right_on).isNotNull()).groupBy(*by, F.col(right_on).alias("_pos")).agg(F.min(key).alias("_key")).withColumn("_hit", F.struct(F.col("_pos").alias("p"), F.col("_key").alias("k")))
    both = asof(left, r, on, "_pos", "_hit", by, "backward", width).withColumnRenamed("_hit", "_back")
    both = asof(both, r, on, "_pos", "_hit", by, "forward", width)
    use_back = F.col("_hit").isNull() | (F.col(on) - F.col("_back.p") <= F.col("_hit.p") - F.col(on))
    pick = F.when(F.col("_back").isNotNull() & use_back, F.col("_back")).otherwise(F.col("_hit"))
    return both.withColumn("_pick", pick).select(*left.columns, F.col("_pick.k").alias(key), F.col("_pick.p").alias("matched_at"))
