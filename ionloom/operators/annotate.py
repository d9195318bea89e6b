"""MS2 annotation: candidates by m/z and polarity, scored, ranked, and what became of each feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions.spectral import filtered_dot_product, noise_filtered
from ionloom.operators.cleaning import matched_pairs
from ionloom.operators.joins import ppm_join

SPECTRUM = ["library_id", "spectrum_id"]
SCAN = ["sample_id", "scan_id"]


def usable(scans: DataFrame, min_purity: float | None = None) -> DataFrame:
    """Scans that are scored: of a feature, not flat, readable, and not known to be too impure."""
    pure = F.lit(True) if min_purity is None else F.coalesce(F.col("purity") >= min_purity, F.lit(True))
    return scans.where(F.col("feature_id").isNotNull() & ~F.coalesce(F.col("is_flat"), F.lit(False)) & pure & F.col("peaks").isNotNull())


def candidates(scans: DataFrame, features: DataFrame, library: DataFrame, ppm: float = 10.0) -> DataFrame:
    """feature_id, _pol, library_id, spectrum_id: library spectra within ppm of the feature (both ends included) of a polarity that its scans have.

    A spectrum or a scan of unknown polarity goes with any. No peaks take part.
    """
    asked = scans.select("feature_id", F.coalesce("polarity", F.lit("")).alias("_pol")).distinct().join(features.select("feature_id", F.col("mz").alias("_mz")).where("_mz is not null"), "feature_id")
    # The feature's m/z is the centre of the window here, the library's elsewhere.
    met = ppm_join(library.select(*SPECTRUM, F.col("polarity").alias("_lib_pol"), F.col("ref_mz").alias("_ref")), asked, "_ref", "_mz", ppm)
    return met.where("_lib_pol is null or _pol = '' or _lib_pol = _pol").select("feature_id", "_pol", *SPECTRUM)


def scored(scans: DataFrame, found: DataFrame, library: DataFrame, fragment_ppm: float = 10.0, noise: float = 0.01, mz_power: float = 2.0, intensity_power: float = 0.5, weights: tuple[float, float, float] = (1.0, 0.5, 0.5)) -> DataFrame:
    """Scans with those candidates of their feature that share a peak with them: sample_id, scan_id, feature_id, library_id, spectrum_id, score and its parts.

    scans: sample_id, scan_id (together one row), feature_id, polarity, peaks; found: see candidates; library: library_id,
    spectrum_id (together one row), peaks. Which pairs share a peak is found by joining peaks, as most pairs share none; each
    side's peaks are then fetched once for those that do.
    """
    # Noise is taken off per spectrum, not per pair.
    clean = lambda df, key, name: df.select(*key, noise_filtered(F.col("peaks"), noise).alias(name))
    peak = lambda df, *key: df.select(*key, F.explode("_p").alias("x")).select(*key, F.col("x.m").alias("_m"))
    ours = peak(clean(scans, [*SCAN, "feature_id", F.coalesce("polarity", F.lit("")).alias("_pol")], "_p"), *SCAN, "feature_id", "_pol")
    theirs = peak(found.join(clean(library, SPECTRUM, "_p"), SPECTRUM), "feature_id", "_pol", *SPECTRUM)
    pairs = ppm_join(ours, theirs.withColumnRenamed("_m", "_lm"), "_m", "_lm", fragment_ppm, ["feature_id", "_pol"]).select(*SCAN, "feature_id", *SPECTRUM).distinct()
    both = pairs.join(clean(library, SPECTRUM, "_library"), SPECTRUM).join(clean(scans, SCAN, "_query"), SCAN)
    m = filtered_dot_product(F.col("_query"), F.col("_library"), fragment_ppm, mz_power, intensity_power, weights)
    return both.withColumn("_m", m).select(*SCAN, "feature_id", *SPECTRUM, "_m.*")


def ranked_rows(rows: DataFrame, min_matched: int = 1) -> DataFrame:
    """Scored pairs with enough matched peaks, with rank_ms2 within their scan by score (equal to nine decimals: by library and spectrum).
    A scan has no more rows than its feature has candidates."""
    rank = F.row_number().over(Window.partitionBy(*SCAN).orderBy(F.desc(F.round("score", 9)), *SPECTRUM))
    return rows.where(F.col("n_matched_peaks") >= min_matched).withColumn("rank_ms2", rank)


def outcomes(scans: DataFrame, found: DataFrame, rows: DataFrame, min_matched: int = 1, min_purity: float | None = None) -> DataFrame:
    """One row per feature with MS2: outcome (all_scans_skipped, annotated, no_shared_fragments or no_candidates), n_scans, the scans
    skipped as flat, as impure and as unreadable, n_candidates, and best_n_matched_peaks over all pairs. rows: see scored."""
    flat = F.coalesce(F.col("is_flat"), F.lit(False))
    impure = F.lit(False) if min_purity is None else ~flat & F.coalesce(F.col("purity") < min_purity, F.lit(False))
    own = scans.where("feature_id is not null").groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_scans"), F.count_if(flat).alias("n_skipped_flat"), F.count_if(impure).alias("n_skipped_purity"), F.count_if(~flat & ~impure & F.col("peaks").isNull()).alias("n_skipped_unreadable"))
    per = found.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    best = rows.groupBy("feature_id").agg(F.max("n_matched_peaks").alias("best_n_matched_peaks"))
    zero = lambda c, t: F.coalesce(c, F.lit(0).cast(t)).alias(c)
    out = own.join(per, "feature_id", "left").join(best, "feature_id", "left").select(*own.columns, zero("n_candidates", "bigint"), zero("best_n_matched_peaks", "int"))
    none_left = F.col("n_skipped_flat") + F.col("n_skipped_purity") + F.col("n_skipped_unreadable") == F.col("n_scans")
    outcome = F.when(none_left, "all_scans_skipped").when(F.col("best_n_matched_peaks") >= max(1, min_matched), "annotated").when(F.col("n_candidates") > 0, "no_shared_fragments").otherwise("no_candidates")
    return out.withColumn("outcome", outcome)


def mirror(query: Column, library: Column, ppm: float = 10.0) -> Column:
    """STRUCT<matched, unmatched, library_matched, library_unmatched, connectors> of peaks for a mirror plot: the library's point down.

    A peak is matched if one of the other side lies within ppm of it; a
    connector joins a library peak to the strongest query peak within ppm of it.
    """
    near = lambda x, other: F.exists(other, lambda y: F.abs(y["m"] - x["m"]) <= x["m"] * (ppm * 1e-6))
    down = lambda p: F.transform(p, lambda x: F.struct(x["m"].alias("m"), (-x["i"]).alias("i")))
    return F.struct(
        F.filter(query, lambda x: near(x, library)).alias("matched"),
        F.filter(query, lambda x: ~near(x, library)).alias("unmatched"),
        down(F.filter(library, lambda x: near(x, query))).alias("library_matched"),
        down(F.filter(library, lambda x: ~near(x, query))).alias("library_unmatched"),
        matched_pairs(query, library, ppm).alias("connectors"),
    )
