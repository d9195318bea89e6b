"""Merging of overlapping, nested and touching intervals per entity.

Two levels, so that no entity has to fit one task: every interval is clipped
to time shards of a fixed width, each (entity, shard) is merged on its own, and
only one summary row per occupied shard takes part in the stitching across
shard boundaries. An interval that covers whole shards is not copied into each
of them; it leaves one bridge row from its second to its last but one shard.

Sizes: starts are whole ticks and pre-aggregated to the furthest end per start,
so a local window holds at most ``shard_width`` rows however often a dwell was
repeated; a stitching window holds at most (time span / shard width) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds beyond this are no exact number of ticks in a DOUBLE.
EXACT = 2**53


def to_ticks(col: Column, per_unit: int) -> Column:
    """A DOUBLE as whole ticks, half away from zero; NULL for NULL, NaN, infinite or inexact values."""
    scaled = F.round(col * F.lit(float(per_unit)))
    return F.when(~F.isnan(col) & (F.abs(scaled) < EXACT), scaled.cast("bigint"))


def valid_dwells(df: DataFrame, entity: Sequence[str], start: str, end: str, per_unit: int = 1000) -> DataFrame:
    """entity columns, _s, _e in ticks (names that begin with _ are this module's own). Rows with a missing entity or bound, or
    with the end before the start (in the values as given), hold no interval."""
    return (
        df.select(*entity, to_ticks(F.col(start), per_unit).alias("_s"), to_ticks(F.col(end), per_unit).alias("_e"), (F.col(end) >= F.col(start)).alias("_ok"))
        .where("_ok and _s is not null and _e is not null and " + " and ".join(f"`{c}` is not null" for c in entity))
        .select(*entity, "_s", "_e")
    )


def _shard_level(dwells: DataFrame, entity: Sequence[str], width: int) -> DataFrame:
    """A row per occupied shard: its coverage, that carried into it, and its inner gaps (at most width / 2)."""
    shard = lambda c: F.floor(F.col(c) / F.lit(width)).cast("bigint")
    d = dwells.withColumn("_a", shard("_s")).withColumn("_b", shard("_e"))
    lo = lambda c: F.col(c) * F.lit(width)
    head = F.struct(F.col("_a").alias("_h"), F.col("_s").alias("_ps"), F.least("_e", lo("_a") + width).alias("_pe"), F.when(F.col("_b") > F.col("_a") + 1, F.col("_b") - 1).alias("_bridge"))
    tail = F.struct(F.col("_b").alias("_h"), lo("_b").alias("_ps"), F.col("_e").alias("_pe"), F.lit(None).cast("bigint").alias("_bridge"))
    pieces = d.select(*entity, F.explode(F.when(F.col("_b") > F.col("_a"), F.array(head, tail)).otherwise(F.array(head))).alias("_piece")).select(*entity, "_piece.*")
    # Furthest end per start: combined before the shuffle, it bounds what a window can hold.
    pieces = pieces.groupBy(*entity, "_h", "_ps").agg(F.max("_pe").alias("_pe"), F.max("_bridge").alias("_bridge"))
    run = Window.partitionBy(*entity, "_h").orderBy("_ps").rowsBetween(Window.unboundedPreceding, -1)
    local = pieces.withColumn("_before", F.max("_pe").over(run))
    inner = F.collect_list(F.when(F.col("_ps") > F.col("_before"), F.struct(F.col("_before").alias("gap_start"), F.col("_ps").alias("gap_end"))))
    return (
        local.groupBy(*entity, "_h")
        .agg(F.min("_ps").alias("_first_s"), F.max("_pe").alias("_last_e"), F.max("_bridge").alias("_bridge"), inner.alias("_inner"))
        .withColumn("_carry_bridge", F.max("_bridge").over(Window.partitionBy(*entity).orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_covered", F.coalesce(F.col("_carry_bridge") >= F.col("_h"), F.lit(False)))
        .withColumn("_reach", F.greatest("_last_e", (F.col("_bridge") + 1) * width))
        .withColumn("_carry_e", F.max("_reach").over(Window.partitionBy(*entity).orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)))
    )


def gaps(dwells: DataFrame, entity: Sequence[str], shard_width: int = 300_000) -> DataFrame:
    """Times between neighbouring periods: entity columns, gap_start, gap_end (ticks).

    Input as from valid_dwells. Bounds belong to the interval, so touching ones
    leave no gap; one of length 0 counts. An empty input gives an empty result.
    """
    shards = _shard_level(dwells, entity, shard_width)
    before = F.array(F.struct(F.col("_carry_e").alias("gap_start"), F.col("_first_s").alias("gap_end")))
    # A shard inside a longer interval has no gaps of its own and none before it.
    found = F.when(F.col("_first_s") > F.col("_carry_e"), F.concat(before, "_inner")).otherwise(F.col("_inner"))
    return shards.where("not _covered").select(*entity, F.explode(found).alias("_g")).select(*entity, "_g.gap_start", "_g.gap_end")


def periods(dwells: DataFrame, entity: Sequence[str], shard_width: int = 300_000) -> DataFrame:
    """Continuous periods: entity columns, period_start, period_end (ticks).

    A period begins at the entity's first start or where a gap ends, and ends
    where the next gap begins or at the entity's last end. The next gap is
    looked up within the shard first and then across shard summaries, so this
    too needs no window over all of an entity's gaps.
    """
    found = gaps(dwells, entity, shard_width).withColumn("_h", F.floor(F.col("gap_end") / F.lit(shard_width)).cast("bigint"))
    ends = dwells.groupBy(*entity).agg(F.min("_s").alias("_first_s"), F.max("_e").alias("_last_e"))
    by_shard = found.groupBy(*entity, "_h").agg(F.min("gap_start").alias("_first_gap"))
    by_shard = by_shard.withColumn("_later", F.min("_first_gap").over(Window.partitionBy(*entity).orderBy("_h").rowsBetween(1, Window.unboundedFollowing)))
    after = found.withColumn("_next", F.lead("gap_start").over(Window.partitionBy(*entity, "_h").orderBy("gap_end")))
    tails = (
        after.join(by_shard.select(*entity, "_h", "_later"), [*entity, "_h"])
        .join(ends, list(entity))
        .select(*entity, F.col("gap_end").alias("period_start"), F.coalesce("_next", "_later", "_last_e").alias("period_end"))
    )
    first = by_shard.groupBy(*entity).agg(F.min("_first_gap").alias("_g"))
    heads = ends.join(first, list(entity), "left").select(*entity, F.col("_first_s").alias("period_start"), F.coalesce("_g", "_last_e").alias("period_end"))
    return heads.unionByName(tails)
