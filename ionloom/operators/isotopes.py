"""Isotopes linked to their monoisotopic feature within samples."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.functions.chemistry import C13_DELTA
from ionloom.functions.spectral import max_m1_ratio
from ionloom.operators.joins import ppm_join
from ionloom.session import stored
from ionloom.sources.tables import small_enough

#: Calls over which the connected parts are spread.
LOTS = 1024
#: Rows that are sent to all tasks rather than shuffled.
FEW = 10_000
#: Pixels a correlation needs.
LEAST_PIXELS = 3


# A stored file is far smaller than its rows in memory: where its size decides, tables are broadcast that the driver
# cannot hold. So every join here says how its sides meet: few rows, counted, are broadcast, all else is merged.


def spatial_correlation(pairs: DataFrame, matrix: DataFrame, sample: str, pixel: str, feature: str, value: str) -> DataFrame:
    """pairs (sample, mono_id, isotope_id) with corr: Pearson r over the pixels where the mono is positive; -1 for fewer than three of these or a flat image.

    matrix holds the non-zero values. Sums are formed per pair, so no pair's pixels gather.
    """
    m = matrix.where(F.col(value) > 0).select(sample, pixel, F.col(feature).alias("mono_id"), F.col(value).alias("_x"))
    images = matrix.select(sample, pixel, F.col(feature).alias("isotope_id"), F.col(value).alias("_y"))
    if small_enough(pairs, FEW):
        mono = m.join(F.broadcast(pairs), [sample, "mono_id"])
        images = images.join(F.broadcast(pairs.select(sample, "isotope_id")), [sample, "isotope_id"], "left_semi")
    else:
        mono = m.join(pairs.hint("merge"), [sample, "mono_id"])
    both = mono.join(images.hint("merge"), [sample, "isotope_id", pixel], "left").withColumn("_y", F.coalesce("_y", F.lit(0.0)))
    s = both.groupBy(sample, "mono_id", "isotope_id").agg(F.count(F.lit(1)).alias("_n"), F.covar_pop("_x", "_y").alias("_c"), F.var_pop("_x").alias("_vx"), F.var_pop("_y").alias("_vy"))
    r = F.when((F.col("_n") >= LEAST_PIXELS) & (F.col("_vx") > 0) & (F.col("_vy") > 0), F.col("_c") / F.sqrt(F.col("_vx") * F.col("_vy"))).otherwise(F.lit(-1.0))
    return pairs.join(s.select(sample, "mono_id", "isotope_id", r.alias("corr")).hint("merge"), [sample, "mono_id", "isotope_id"], "left").withColumn("corr", F.coalesce("corr", F.lit(-1.0)))


def link_isotopes(features: DataFrame, matrix: DataFrame, n_pixels: DataFrame, sample: str, pixel: str, feature: str, mz: str, value: str, ppm: float = 5.0, max_isotopes: int = 3, max_charge: int = 1, min_corr: float = 0.5, image_pixels: str | None = None) -> DataFrame:
    """sample, mono_id, isotope_id, k, z, ratio, corr.

    From the most intense feature (mean over all pixels of the sample) down,
    each not yet claimed one claims M+1, M+2 ... as long as there is a feature
    at k times the isotope distance that is weaker, for M+1 not stronger than
    plausible, and as often together as min_corr asks (the best correlated
    wins); the charge with the longest chain counts. Features can only get in
    each other's way within a connected part of the candidate pairs; these
    parts, not samples, are what is claimed within one call. image_pixels: the
    column of matrix, if any, that counts the positive pixels of a row's image.
    """
    masses = features.select(feature, F.col(mz).alias("_mz")).where("_mz is not null").hint("merge")
    sums = lambda m: m.groupBy(sample, feature).agg(F.sum(value).alias("_s"), F.count_if(F.col(value) > 0).alias("_n"))
    # With fewer pixels the correlation is -1.
    seen = (F.col("_s") > 0) & ((F.col("_n") >= LEAST_PIXELS) | F.lit(min_corr <= -1))
    large = matrix.where(F.col(image_pixels) >= LEAST_PIXELS) if image_pixels and min_corr > -1 else matrix
    mono = stored(sums(large).where(seen).join(masses, feature).select(sample, F.col(feature).alias("mono_id"), F.col("_mz").alias("mono_mz"), F.col("_s").alias("mono_s")))
    few = small_enough(mono, FEW)
    near = matrix.join(F.broadcast(mono.select(sample)), sample, "left_semi") if few else matrix
    iso = sums(near).join(masses, feature).select(sample, F.col(feature).alias("isotope_id"), "_mz", F.col("_s").alias("iso_s"))
    offsets = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(z).alias("z")) for z in range(1, max_charge + 1) for k in range(1, max_isotopes + 1)])).alias("o")
    mono = mono.select("*", offsets).select(sample, "mono_id", "mono_mz", "mono_s", "o.*").withColumn("expected", F.col("mono_mz") + F.col("k") * F.lit(C13_DELTA) / F.col("z"))
    pairs = ppm_join(iso, F.broadcast(mono) if few else mono.hint("merge"), "_mz", "expected", ppm, [sample])
    # What is weaker in the mean is so in the sum; the means themselves are those of few rows.
    pairs = pairs.where((F.col("isotope_id") != F.col("mono_id")) & (F.col("iso_s") < F.col("mono_s"))).hint("merge").join(n_pixels, sample)
    pairs = pairs.withColumns({"mono_h": F.col("mono_s") / F.col("n"), "iso_h": F.col("iso_s") / F.col("n")})
    plausible = (F.col("k") > 1) | (F.col("iso_h") / F.col("mono_h") <= max_m1_ratio(F.col("mono_mz"), F.col("z")))
    pairs = stored(pairs.where((F.col("iso_h") < F.col("mono_h")) & (F.col("mono_h") > 0) & plausible).select(sample, "mono_id", "mono_h", "isotope_id", "iso_h", "_mz", "k", "z"))
    corr = spatial_correlation(pairs.select(sample, "mono_id", "isotope_id").distinct(), matrix, sample, pixel, feature, value).where(F.col("corr") >= min_corr)
    edges = stored(pairs.join(corr.hint("merge"), [sample, "mono_id", "isotope_id"]))
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    part = components(edges, sample, "mono_id", "isotope_id").select(sample, F.col("node").alias("mono_id"), "component")
    # Many parts share a call; a part is never split.
    lots = edges.join(part.hint("merge"), [sample, "mono_id"]).withColumn("_lot", F.pmod(F.xxhash64(sample, "component"), F.lit(LOTS)))
    columns = [sample, "mono_id", "isotope_id", "k", "z", "ratio", "corr"]

    def claim(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["mono_h", "mono_id"], ascending=[False, True], kind="stable")
        options: dict[tuple, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        for r in rows.itertuples(index=False):
            options[getattr(r, sample), r.mono_id][r.z, r.k].append((r.corr, r.iso_mz, r.isotope_id, r.iso_h / r.mono_h))
        taken: set = set()
        out = []
        # The rows come from the most intense feature down.
        for (group, mono), held in options.items():
            if (group, mono) in taken:
                continue
            chains = []
            for z in range(1, max_charge + 1):
                chain: list = []
                for k in range(1, max_isotopes + 1):
                    free = [x for x in held.get((z, k), ()) if (group, x[2]) not in taken]
                    if not free:
                        break
                    corr, _, isotope, ratio = max(free)
                    chain.append((group, mono, isotope, k, z, ratio, corr))
                chains.append(chain)
            best = max(chains, key=len)
            out += best
            taken |= {(group, c[2]) for c in best} | ({(group, mono)} if best else set())
        return pd.DataFrame(out, columns=columns)

    return lots.withColumnRenamed("_mz", "iso_mz").groupBy("_lot").applyInPandas(claim, f"`{sample}` {kinds[sample]}, mono_id {kinds['mono_id']}, isotope_id {kinds['isotope_id']}, k int, z int, ratio double, corr double")


def components(edges: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """by, node, component: the least node of the connected part each node lies in. Every round halves what is left of a part's longest way, as labels are followed to their own labels."""
    pairs = stored(edges.select(by, F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(by, F.col(b).alias("u"), F.col(a).alias("v"))).distinct())
    labels = stored(pairs.groupBy(by, F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("component")))
    while True:
        near = pairs.hint("merge").join(labels.select(by, F.col("node").alias("v"), F.col("component").alias("_c")), [by, "v"]).groupBy(by, F.col("u").alias("node")).agg(F.min("_c").alias("_near"))
        own = labels.join(near.hint("merge"), [by, "node"]).select(by, "node", "component", F.least("component", "_near").alias("_c"))
        up = labels.select(by, F.col("node").alias("_c"), F.col("component").alias("_up"))
        moved = stored(own.join(up.hint("merge"), [by, "_c"], "left").select(by, "node", F.least("_c", F.coalesce("_up", "_c")).alias("component"), (F.col("component") != F.least("_c", F.coalesce("_up", "_c"))).alias("_moved")))
        labels = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return labels
