"""Pairing records with the nearest record in time of the same entity.

Every right-hand time becomes the interval of left-hand times nearest to it:
from just after the midpoint with its predecessor to the midpoint with its
successor, cut at the tolerance. These intervals do not overlap within an
entity, so a left row meets at most one, and the range join is an equi-join on
(entity, time bucket) with the interval as residual.

Entities are never gathered: neighbours further than twice the tolerance away
cannot shorten an interval, so they are looked up per (entity, bucket), with a
copy of the rows near a bucket's edge. As times are whole ticks and one record
per tick is kept, a bucket holds at most its width plus the edges in rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.operators.intervals import to_ticks


def _bucket(tick: Column, width: int) -> Column:
    return F.floor(tick / F.lit(width)).cast("bigint")


def nearest_intervals(right: DataFrame, entity: Sequence[str], tick: str, key: str, tolerance: int) -> DataFrame:
    """entity columns, key, tick, lo, hi: the left ticks (both inclusive) whose nearest right record this is.

    Of several records at one tick the smallest key is kept; at equal distance
    the earlier record wins, so hi is the midpoint and the next lo lies above it.
    """
    width = 4 * tolerance + 1
    own = right.groupBy(*entity, F.col(tick).alias("_t")).agg(F.min(key).alias("_key"))
    reach = 2 * tolerance
    # A row goes to its own bucket and, near an edge, to the neighbour's as a halo row.
    spread = own.select(*entity, "_t", "_key", _bucket(F.col("_t"), width).alias("_own"), F.explode(F.array_distinct(F.array(*[_bucket(F.col("_t") + F.lit(x), width) for x in (-reach, 0, reach)]))).alias("_b"))
    w = Window.partitionBy(*entity, "_b").orderBy("_t")
    t, before, after = F.col("_t"), F.lag("_t").over(w), F.lead("_t").over(w)
    half = lambda a, b: F.floor((a + b) / F.lit(2)).cast("bigint")
    return (
        spread.withColumn("_before", before)
        .withColumn("_after", after)
        .where("_own = _b")
        .select(
            *entity,
            F.col("_key").alias(key),
            t.alias(tick),
            F.greatest(t - tolerance, half(F.col("_before"), t) + 1).alias("lo"),
            F.least(t + tolerance, half(t, F.col("_after"))).alias("hi"),
        )
    )


def pair_nearest(left: DataFrame, right: DataFrame, entity: Sequence[str], left_time: str, right_time: str, left_key: str, right_key: str, tolerance: int, per_unit: int = 1000) -> DataFrame:
    """entity columns, left_key, right_key of each left record and its nearest right record.

    Times are rounded to whole ticks (per_unit per unit) and the distance may be
    up to and including tolerance ticks. Rows with a NULL entity, key or time,
    or a NaN time, take no part. Repeated rows give their pair once.
    """
    if left_key == right_key or {left_key, right_key} & set(entity):
        raise ValueError("the two keys and the entity columns need different names")
    needed = lambda key, tick: " and ".join(f"`{c}` is not null" for c in [*entity, key, tick])
    lefts = left.select(*entity, left_key, to_ticks(F.col(left_time), per_unit).alias("_l")).where(needed(left_key, "_l"))
    rights = right.select(*entity, right_key, to_ticks(F.col(right_time), per_unit).alias("_r")).where(needed(right_key, "_r"))
    width = 4 * tolerance + 1
    spans = nearest_intervals(rights, entity, "_r", right_key, tolerance)
    # An interval is no longer than 2 * tolerance + 1, so it lies in one or two buckets.
    index = spans.select(*entity, right_key, "lo", "hi", F.explode(F.sequence(_bucket(F.col("lo"), width), _bucket(F.col("hi"), width))).alias("_b"))
    probe = lefts.withColumn("_b", _bucket(F.col("_l"), width))
    return probe.join(index, [*entity, "_b"]).where("_l between lo and hi").select(*entity, left_key, right_key).distinct()
