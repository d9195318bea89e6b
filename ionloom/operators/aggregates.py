"""Aggregates: averaged spectra, matrices, summaries, calibration, correlation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.operators.joins import ppm_join
from ionloom.operators.ranks import percentiles


def average_spectrum(scans: DataFrame, mapped: DataFrame, by: Sequence[str], scan: str, pixel: str, lo: float, hi: float, width: float) -> DataFrame:
    """by, bin, mz, intensity: summed intensity per m/z bin over the scans that fall on a pixel
    (each once, on however many it falls), over the number of such pixels; only filled bins. scans has a row per scan.

    The bin is computed in single precision and cut towards zero, as the data are singles.
    """
    used = mapped.select(*by, scan).distinct()
    spectra = scans.join(used, [*by, scan], "left_semi").select(*by, "mz", "intensity")
    peaks = spectra.select(*by, F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select(*by, F.col("p.mz").cast("float").alias("m"), F.col("p.intensity").cast("double").alias("i"))
    at = ((F.col("m") - F.lit(lo).cast("float")) / F.lit(width).cast("float")).cast("bigint")
    n_bins = int(round((hi - lo) / width))
    sums = peaks.withColumn("bin", at).where(F.col("bin").between(0, n_bins - 1)).groupBy(*by, "bin").agg(F.sum("i").alias("_sum"))
    with_scan = mapped.join(scans.select(*by, scan).distinct(), [*by, scan], "left_semi")
    pixels = with_scan.groupBy(*by).agg(F.count_distinct(pixel).alias("_pixels"))
    return sums.join(pixels, list(by)).select(*by, "bin", (F.lit(lo) + (F.col("bin") + 0.5) * width).alias("mz"), (F.col("_sum") / F.col("_pixels")).alias("intensity"))


def quantify(scans: DataFrame, targets: DataFrame, by: Sequence[str], scan: str, target: str, target_mz: str, ppm: float) -> DataFrame:
    """by, scan, target, value: the strongest peak of each scan within ppm of each target; what is not detected has no row."""
    peaks = scans.select(*by, scan, F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select(*by, scan, F.col("p.mz").cast("double").alias("_m"), F.col("p.intensity").cast("double").alias("_i")).where("_i > 0")
    pairs = ppm_join(peaks, targets.select(target, F.col(target_mz).alias("_t")), "_m", "_t", ppm)
    return pairs.groupBy(*by, scan, target).agg(F.max("_i").alias("value"))


def pixel_matrix(values: DataFrame, mapped: DataFrame, by: Sequence[str], scan: str, pixel: str, target: str) -> DataFrame:
    """by, pixel, target, value: mean over the pixel's scans in which the target was detected."""
    return values.join(mapped.select(*by, pixel, scan).distinct(), [*by, scan]).groupBy(*by, pixel, target).agg(F.avg("value").alias("value"))


def weighted_mz(members: DataFrame, by: Sequence[str], mz: str, weight: str) -> DataFrame:
    """by, mz_weighted, mz_spread_ppm: the mean by intensity (negative ones as 0; plain if all are 0) and the spread in ppm, NULL for one member."""
    w = F.greatest(F.lit(0.0), F.col(weight))
    mean = F.when(F.sum(w) > 0, F.sum(F.col(mz) * w) / F.sum(w)).otherwise(F.avg(mz))
    return members.groupBy(*by).agg(mean.alias("mz_weighted"), F.when(F.count(mz) > 1, F.stddev_pop(mz) / mean * 1e6).alias("mz_spread_ppm"))


def mad_threshold(df: DataFrame, by: Sequence[str], value: str, n_mads: float = 2.5, log: bool = True) -> DataFrame:
    """by, threshold: median plus n_mads times the median absolute deviation, of log10 if log (positive values only)."""
    rows = df.where((F.col(value) > 0) if log else F.col(value).isNotNull()).where(~F.isnan(F.col(value).cast("double"))).select(*by, (F.log10(value) if log else F.col(value).cast("double")).alias("_v"))
    mid = percentiles(rows, by, "_v", [0.5]).select(*by, F.get("q", F.lit(0)).alias("_m"))
    off = rows.join(mid, list(by)).withColumn("_off", F.abs(F.col("_v") - F.col("_m")))
    spread = percentiles(off, by, "_off", [0.5]).select(*by, F.get("q", F.lit(0)).alias("_mad")).join(mid, list(by))
    limit = F.col("_m") + n_mads * F.col("_mad")
    return spread.select(*by, (F.pow(F.lit(10.0), limit) if log else limit).alias("threshold"))


def compound_scores(annotations: DataFrame, group: str, compound: str, score: str, order: Sequence[str], keep: Sequence[str], scan: Sequence[str]) -> DataFrame:
    """Per group and compound the best row (score, then order ascending), and counts of rows and distinct scans."""
    best = F.max_by(F.struct(*keep), F.struct(F.col(score), *[(-F.col(c)).alias(f"_{c}") for c in order]))
    agg = annotations.where(F.col(compound).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)).groupBy(group, compound).agg(F.max(score).alias("best_score"), best.alias("_b"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.struct(*scan)).alias("n_scans"))
    return agg.select(group, compound, "best_score", *[F.col(f"_b.{c}").alias(c) for c in keep], "n_rows", "n_scans")


def calibration(points: DataFrame, by: Sequence[str], x: str, y: str, weighting: str = "none") -> DataFrame:
    """by, n, slope, intercept, r2, lod, loq of a (weighted) line; weighting none, 1/x or 1/x2 (weight 1 where x is 0).

    NULL where fewer than two different x are given; LOD and LOQ are NULL for a slope of 0.
    """
    c = F.col
    w = {"none": F.lit(1.0), "1/x": F.when(c(x) == 0, 1.0).otherwise(1.0 / F.abs(c(x))), "1/x2": F.when(c(x) == 0, 1.0).otherwise(1.0 / (c(x) * c(x)))}[weighting]
    rows = points.where(c(x).isNotNull() & c(y).isNotNull() & ~F.isnan(c(x).cast("double")) & ~F.isnan(c(y).cast("double"))).select(*by, c(x).cast("double").alias(x), c(y).cast("double").alias(y)).withColumn("_w", w)
    s = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"), F.sum(c("_w") * c(x)).alias("wx"), F.sum(c("_w") * c(y)).alias("wy"))
    mean_x, mean_y = c("wx") / c("w"), c("wy") / c("w")
    # Second pass around the means, as sums of squares lose precision.
    d = rows.join(s, list(by)).select(*by, "n", mean_x.alias("_mx"), mean_y.alias("_my"), "_w", (c(x) - mean_x).alias("_dx"), (c(y) - mean_y).alias("_dy"))
    m = d.groupBy(*by, "n", "_mx", "_my").agg(F.sum(c("_w") * c("_dx") * c("_dx")).alias("sxx"), F.sum(c("_w") * c("_dx") * c("_dy")).alias("sxy"), F.sum(c("_w") * c("_dy") * c("_dy")).alias("syy"))
    slope = F.when(c("sxx") > 0, c("sxy") / c("sxx"))
    m = m.withColumn("slope", slope).withColumn("intercept", c("_my") - c("slope") * c("_mx")).withColumn("r2", F.when((c("sxx") > 0) & (c("syy") > 0), c("sxy") * c("sxy") / (c("sxx") * c("syy"))))
    r = rows.join(m.select(*by, "slope", "intercept"), list(by)).withColumn("_r", c(y) - c("slope") * c(x) - c("intercept"))
    spread = r.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.var_pop("_r").alias("_v"))
    s_res = F.when(c("_n") > 2, F.sqrt(c("_v") * c("_n") / (c("_n") - 2))).otherwise(F.lit(0.0))
    limit = lambda k: F.when(c("slope") != 0, k * s_res / F.abs(c("slope")))
    return m.join(spread, list(by)).select(*by, "n", "slope", "intercept", "r2", limit(3.3).alias("lod"), limit(10.0).alias("loq"))


def interpolate(intensity: Column, slope: Column, intercept: Column) -> Column:
    """Concentration for an intensity; NULL where the slope is 0."""
    return F.when(slope != 0, (intensity - intercept) / slope)


def normalise(df: DataFrame, reference: str, value: str, name: str = "normalised") -> DataFrame:
    """log1p(value * median / reference) with the median of all rows' references; 0 where the reference or the median is not positive."""
    real = F.when(~F.isnan(reference), F.col(reference))
    middle = percentiles(df.select(real.alias("_v")), [], "_v", [0.5]).agg(F.max(F.get("q", F.lit(0))).alias("_median"))
    scaled = F.when((F.col("_median") > 0) & (real > 0), F.log1p(F.col(value) * (F.col("_median") / real))).otherwise(F.lit(0.0))
    return df.crossJoin(F.broadcast(middle)).withColumn(name, scaled).drop("_median")


def correlation_pairs(matrix: DataFrame, n_pixels: DataFrame, by: Sequence[str], pixel: str, feature: str, value: str, rank: bool = False, pixels_per_lot: int = 20_000, features_per_tile: int = 1024, min_abs: float | None = None) -> DataFrame:
    """by, feature_a, feature_b (a < b), r for all pairs of features, over all pixels (absent ones count as 0).

    matrix holds the non-zero values, n_pixels by and n. A group's pixels are cut into lots of about ``pixels_per_lot`` and its
    features into tiles of about ``features_per_tile``; each call gives the products of two tiles over one lot, at most a square
    of tile by tile, and these are added up. Constant features have no r and no row. rank: Spearman, with mean ranks. min_abs:
    only pairs with at least this abs(r); of the features that are never on one pixel, only those that can reach it are paired.
    """
    rows = matrix.select(*by, F.col(pixel).alias("_p"), F.col(feature).alias("_f"), F.col(value).cast("double").alias("_v")).where("_v is not null and _v != 0")
    if rank:
        # Non-negative values: zeros share the lowest rank, the others lie above it.
        w = Window.partitionBy(*by, "_f")
        n = F.col("n") - F.count(F.lit(1)).over(w)
        order = F.rank().over(w.orderBy("_v")) + (F.count(F.lit(1)).over(Window.partitionBy(*by, "_f", "_v")) - 1) / 2.0
        zero = (n + 1) / 2.0
        rows = rows.join(n_pixels, list(by)).withColumn("_z", F.when(n > 0, zero).otherwise(0.0)).withColumn("_r", order + n).select(*by, "_p", "_f", (F.col("_r") - F.col("_z")).alias("_v"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    key = ", ".join(f"`{c}` {kinds[c]}" for c in by)

    def products(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame.iloc[0]
        _, p = np.unique(frame["_p"].to_numpy(), return_inverse=True)
        order = np.argsort(p, kind="stable")
        p, v, t = p[order], frame["_v"].to_numpy()[order], frame["_t"].to_numpy()[order]
        one = int(head["_ta"]) == int(head["_tb"])
        sides = []
        for tile in dict.fromkeys((int(head["_ta"]), int(head["_tb"]))):
            mine = t == tile
            features, f = np.unique(frame["_f"].to_numpy()[order][mine], return_inverse=True)
            sides.append((features, f, p[mine], v[mine]))
        left, right = sides[0], sides[-1]
        gram = np.zeros((len(left[0]), len(right[0])))

        def dense(side: tuple, lo: int) -> np.ndarray:
            features, f, at, values = side
            some = slice(np.searchsorted(at, lo), np.searchsorted(at, lo + 2000))
            out = np.zeros((2000, len(features)))
            out[at[some] - lo, f[some]] = values[some]
            return out

        # A few thousand pixels at a time, dense.
        for lo in range(0, int(p[-1]) + 1 if len(p) else 0, 2000):
            x = dense(left, lo)
            gram += x.T @ (x if one else dense(right, lo))
        a, b = np.nonzero(np.triu(gram) if one else gram)
        fa, fb = left[0][a], right[0][b]
        swap = fa > fb
        return pd.DataFrame({**{c: head[c] for c in by}, "_a": np.where(swap, fb, fa), "_b": np.where(swap, fa, fb), "_s": gram[a, b]})

    sizes = rows.groupBy(*by).agg(F.count_distinct("_f").alias("_nf")).select(*by, F.ceil(F.col("_nf") / F.lit(features_per_tile)).cast("int").alias("_tiles"))
    n_lots = n_pixels.select(*by, F.ceil(F.col("n") / F.lit(pixels_per_lot)).cast("bigint").alias("_lots")).join(sizes, list(by))
    lots = rows.join(n_lots, list(by)).withColumn("_lot", F.pmod(F.xxhash64("_p"), F.greatest(F.lit(1), "_lots"))).withColumn("_t", F.pmod(F.xxhash64("_f"), "_tiles").cast("int"))
    # A value meets every tile, its own included.
    lots = lots.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).withColumn("_ta", F.least("_t", "_j")).withColumn("_tb", F.greatest("_t", "_j")).drop("_lots", "_tiles", "_j")
    blocks = lots.groupBy(*by, "_lot", "_ta", "_tb").applyInPandas(products, f"{key}, _a {kinds['_f']}, _b {kinds['_f']}, _s double")
    gram = blocks.groupBy(*by, "_a", "_b").agg(F.sum("_s").alias("_s"))
    sums = rows.groupBy(*by, "_f").agg(F.sum("_v").alias("_m")).join(n_pixels.select(*by, F.col("n").cast("double").alias("_n")), list(by))
    squares = gram.where("_a = _b").select(*by, F.col("_a").alias("_f"), F.col("_s").alias("_ss"))
    mean, square = F.col("_m") / F.col("_n"), F.col("_ss") / F.col("_n")
    varied = sums.join(squares, [*by, "_f"]).select(*by, "_f", "_n", mean.alias("_mean"), (square - mean * mean).alias("_var"), square.alias("_ms")).where("_var > 1e-12 * _ms")
    one = varied.select(*by, F.col("_f").alias("feature_a"), F.col("_mean").alias("_ma"), F.col("_var").alias("_va"), "_n")
    two = varied.select(*by, F.col("_f").alias("feature_b"), F.col("_mean").alias("_mb"), F.col("_var").alias("_vb"))
    met = gram.where("_a < _b").select(*by, F.col("_a").alias("feature_a"), F.col("_b").alias("feature_b"), "_s")
    bound = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    r = bound((F.coalesce(F.col("_s"), F.lit(0.0)) / F.col("_n") - F.col("_ma") * F.col("_mb")) / F.sqrt(F.col("_va") * F.col("_vb")))
    if min_abs is None or min_abs <= 0:
        pairs = one.join(two, list(by)).where("feature_a < feature_b").join(met, [*by, "feature_a", "feature_b"], "left")
        return pairs.select(*by, "feature_a", "feature_b", r.alias("r"))
    together = met.join(one, [*by, "feature_a"]).join(two, [*by, "feature_b"]).select(*by, "feature_a", "feature_b", r.alias("r"))
    # Never on one pixel: r is minus the product of their means over their deviations.
    share = lambda m, v: F.abs(F.col(m)) / F.sqrt(F.col(v))
    most = one.groupBy(*by).agg(F.max(share("_ma", "_va")).alias("_most"))
    able = lambda df, m, v: df.join(most, list(by)).where(share(m, v) * F.col("_most") >= min_abs).drop("_most")
    apart = able(one, "_ma", "_va").join(able(two, "_mb", "_vb"), list(by)).where("feature_a < feature_b").where(share("_ma", "_va") * share("_mb", "_vb") >= min_abs)
    apart = apart.join(met.select(*by, "feature_a", "feature_b"), [*by, "feature_a", "feature_b"], "left_anti").withColumn("_s", F.lit(0.0))
    return together.where(F.abs("r") >= min_abs).unionByName(apart.select(*by, "feature_a", "feature_b", r.alias("r")))


def correlation_with(matrix: DataFrame, n_pixels: DataFrame, by: Sequence[str], pixel: str, feature: str, value: str, chosen) -> DataFrame:
    """by, feature, r of one feature with every other of its groups, as correlation_pairs has them; only its own pixels are joined."""
    rows = matrix.select(*by, F.col(pixel).alias("_p"), F.col(feature).alias(feature), F.col(value).cast("double").alias("_v")).where("_v is not null and _v != 0")
    n = n_pixels.select(*by, F.col("n").cast("double").alias("_n"))
    moments = rows.groupBy(*by, feature).agg(F.sum("_v").alias("_m"), F.sum(F.col("_v") * F.col("_v")).alias("_q")).join(n, list(by))
    mean, square = F.col("_m") / F.col("_n"), F.col("_q") / F.col("_n")
    varied = moments.select(*by, feature, "_n", mean.alias("_mean"), (square - mean * mean).alias("_var"), square.alias("_ms")).where("_var > 1e-12 * _ms")
    own = rows.where(F.col(feature) == chosen).select(*by, "_p", F.col("_v").alias("_x"))
    cross = rows.join(own, [*by, "_p"]).groupBy(*by, feature).agg(F.sum(F.col("_v") * F.col("_x")).alias("_s"))
    mine = varied.where(F.col(feature) == chosen).select(*by, F.col("_mean").alias("_ma"), F.col("_var").alias("_va"))
    pairs = varied.where(F.col(feature) != chosen).join(mine, list(by)).join(cross, [*by, feature], "left")
    r = (F.coalesce("_s", F.lit(0.0)) / F.col("_n") - F.col("_ma") * F.col("_mean")) / F.sqrt(F.col("_va") * F.col("_var"))
    return pairs.select(*by, feature, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("r"))


def value_range(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, vmin, vmax for colouring: the least value, and the 99.5th percentile of those above it (vmin + 1 if flat)."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    low = rows.groupBy(*by).agg(F.min(value).alias("vmin"))
    above = rows.select(*by, value).join(low, list(by)).where(F.col(value) > F.col("vmin"))
    high = percentiles(above, by, value, [0.995]).select(*by, F.get("q", F.lit(0)).alias("_high"))
    return low.join(high, list(by), "left").select(*by, "vmin", F.coalesce("_high", F.col("vmin") + 1).alias("vmax"))


def violin(df: DataFrame, by: Sequence[str], value: str, points: int = 64, bins: int = 512) -> DataFrame:
    """by, x, density: a Gaussian density estimate (Scott's width) at evenly spaced points between a group's least and greatest value.

    Values are counted in bins first, so what is summed per point is at most a
    row per bin, however many values there are. NULL density for a group of one
    value or of equal ones; NULL and NaN values do not count.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    stats = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.stddev_samp("_v").alias("_sd"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("_v") - F.col("_lo"), width))).cast("int")
    counts = rows.join(stats.select(*by, "_lo", "_hi"), list(by)).groupBy(*by, at.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    hist = counts.where("_b is not null").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_b", "_c"))).alias("_h"))
    grid = stats.join(hist, list(by), "left").select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_k")).withColumn("x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_k") / (points - 1)).withColumn("_s", F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2)))
    centre = lambda b: F.col("_lo") + (b + 0.5) * width
    total = F.aggregate("_h", F.lit(0.0), lambda acc, h: acc + h["_c"] * F.exp(-0.5 * F.pow((F.col("x") - centre(h["_b"])) / F.col("_s"), F.lit(2.0))))
    return grid.select(*by, F.col("_k").alias("point"), "x", F.when(F.col("_s") > 0, total / (F.col("_n") * F.col("_s") * 2.5066282746310002)).alias("density"))


def isotope_vote(links: DataFrame, present: DataFrame, protected: DataFrame, group: str = "sample", max_isotopes: int = 3) -> DataFrame:
    """Isotopes accepted from links found per sample: mono_id, isotope_id, k, z, n_samples_linked, n_samples_both, intensity_ratio, spatial_corr.

    links: group, mono_id, isotope_id, k, z, ratio, corr; present: group, feature_id.
    A link counts if more than half of the samples that hold both features have
    it; a feature goes to the mono with most votes (then lower k, mono); an
    isotope is no mono; M+k needs M+(k-1) of the same mono and charge.
    """
    votes = links.groupBy("mono_id", "isotope_id", "k", "z").agg(F.count(F.lit(1)).alias("n_samples_linked"), F.median("ratio").alias("intensity_ratio"), F.median("corr").alias("spatial_corr"))
    pairs = votes.select("mono_id", "isotope_id").distinct()
    both = pairs.join(present.select(group, F.col("feature_id").alias("mono_id")), "mono_id").join(present.select(group, F.col("feature_id").alias("isotope_id")), [group, "isotope_id"]).groupBy("mono_id", "isotope_id").agg(F.count_distinct(group).alias("n_samples_both"))
    passed = votes.join(both, ["mono_id", "isotope_id"]).where("2 * n_samples_linked > n_samples_both").join(protected.select(F.col("feature_id").alias("isotope_id")), "isotope_id", "left_anti")
    won = passed.withColumn("_n", F.row_number().over(Window.partitionBy("isotope_id").orderBy(F.desc("n_samples_linked"), "k", "mono_id", "z"))).where("_n = 1").drop("_n")
    won = won.join(won.select(F.col("isotope_id").alias("mono_id")).distinct(), "mono_id", "left_anti")
    level = won.where("k = 1")
    out = level
    for k in range(2, max_isotopes + 1):
        level = won.where(F.col("k") == k).join(level.select("mono_id", "z"), ["mono_id", "z"], "left_semi")
        out = out.unionByName(level)
    return out


