"""MS2 spectra against a library, purity, cleaning, centroids, formulas, and what is read of a feature.

The tables hold no MS2 and no library peaks. Stand-ins with the same shape are
derived from them: an MS2 scan has the peaks of its parent MS1 scan, a library
spectrum those of the scan that its best-scoring annotation belongs to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionloom.functions import chemistry, spectral
from ionloom.operators import aggregates, annotate, cleaning, formulas, joins, ranks, windows
from ionloom.plans import ms1_queries, ms2_queries
from ionloom.plans.ms1_queries import features, mapped, scans
from ionloom.plans.ms2_queries import annotations, associations
from ionloom.session import stored

#: Adducts that are asked for by default, one per polarity.
ASKED = ("[M+H]+", "[M-H]-")


def ms2_spectra(spark: SparkSession, d: str) -> DataFrame:
    """id, sample_id, scan_id, feature_id, polarity, precursor_mz, is_flat, peaks of every MS2 scan; scans without a parent have NULL peaks."""
    a = associations(spark, d).select("id", "sample_id", "scan_id", "feature_id", "polarity", "precursor_mz", (F.col("flat_fragmentation") == 1).alias("is_flat"))
    parents = ms2_queries.parent_scan(spark, d).where("parent_scan_id is not null")
    peaks = scans(spark, d).select("sample_id", F.col("scan_id").alias("parent_scan_id"), spectral.peaks(F.col("mz"), F.col("intensity")).alias("peaks"))
    return a.join(parents, "id", "left").join(peaks, ["sample_id", "parent_scan_id"], "left").drop("parent_scan_id")


def _one_per_scan(spark: SparkSession, d: str) -> DataFrame:
    """MS2 spectra with one row per (sample, scan): the least id."""
    return stored(ms2_spectra(spark, d).groupBy("sample_id", "scan_id").agg(F.min_by(F.struct("feature_id", "polarity", "precursor_mz", "is_flat", "peaks"), "id").alias("r")).select("sample_id", "scan_id", "r.*").withColumn("purity", F.lit(None).cast("double")))


def library_spectra(spark: SparkSession, d: str, spectra: DataFrame) -> DataFrame:
    """library_id, spectrum_id, ref_mz, polarity, peaks."""
    best = annotations(spark, d).where("library_spectrum_id is not null").groupBy("library_id", F.col("library_spectrum_id").alias("spectrum_id")).agg(F.min_by(F.struct("sample_id", "scan_id"), F.struct(-F.col("score"), "id")).alias("r"))
    return best.select("library_id", "spectrum_id", "r.*").join(spectra.select("sample_id", "scan_id", F.col("precursor_mz").alias("ref_mz"), "polarity", "peaks"), ["sample_id", "scan_id"]).where("ref_mz is not null and peaks is not null").drop("sample_id", "scan_id")


def _annotated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    spectra = _one_per_scan(spark, d)
    library = stored(library_spectra(spark, d, spectra))
    used = annotate.usable(spectra)
    found = stored(annotate.candidates(used, features(spark, d), library))
    # Every pair is scored once, for its rows and for the outcomes.
    return spectra, found, stored(annotate.scored(used, found, library))


def ms2_annotate(spark: SparkSession, d: str) -> DataFrame:
    """Library spectra that share peaks with each MS2 scan, with score, its parts and rank."""
    _, _, rows = _annotated(spark, d)
    r = lambda c: F.round(c, 6).alias(c)
    return annotate.ranked_rows(rows).select("sample_id", "scan_id", "feature_id", "library_id", "spectrum_id", r("score"), r("dot_product_score"), r("lib_coverage"), r("emp_coverage"), "n_matched_peaks", "n_lib_peaks", "rank_ms2")


def ms2_outcome(spark: SparkSession, d: str) -> DataFrame:
    """What became of each feature with MS2, with the counts behind it."""
    spectra, found, rows = _annotated(spark, d)
    return annotate.outcomes(spectra, found, rows)


def mirror_data(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of the two sides of the best hit of each feature: how many match and how they are joined."""
    spectra, found, rows = _annotated(spark, d)
    best = rows.where("n_matched_peaks >= 1").groupBy("feature_id").agg(F.min_by(F.struct("sample_id", "scan_id", "library_id", "spectrum_id"), F.struct(-F.round("score", 9), "sample_id", "scan_id", "library_id", "spectrum_id")).alias("r")).select("feature_id", "r.*")
    library = library_spectra(spark, d, spectra).withColumnRenamed("peaks", "_library").select("library_id", "spectrum_id", "_library")
    both = best.join(spectra.select("sample_id", "scan_id", "peaks"), ["sample_id", "scan_id"]).join(library, ["library_id", "spectrum_id"])
    m = both.withColumn("m", annotate.mirror(F.col("peaks"), F.col("_library")))
    low = F.aggregate("m.library_matched", F.lit(0.0), lambda acc, x: acc + x["i"])
    return m.select("feature_id", "library_id", "spectrum_id", *[F.size(f"m.{c}").alias(f"n_{c}") for c in ("matched", "unmatched", "library_matched", "library_unmatched", "connectors")], F.round(low, 3).alias("library_matched_sum")).withColumn("library_matched_sum", F.col("library_matched_sum") + 0.0)


def purity_table(spark: SparkSession, d: str) -> DataFrame:
    """Per MS2 scan its parent, isolation window, precursor purity, whether the precursor is confirmed, and the precursor snapped to the parent's peak."""
    links = ms2_queries.parent_scan(spark, d)
    a = associations(spark, d).select("id", "sample_id", "precursor_mz", "isolation_window_target")
    peaks = scans(spark, d).select("sample_id", F.col("scan_id").alias("parent_scan_id"), spectral.peaks(F.col("mz"), F.col("intensity")).alias("p"))
    rows = a.join(links, "id", "left").join(peaks, ["sample_id", "parent_scan_id"], "left")
    ref, centre = F.coalesce("precursor_mz", "isolation_window_target"), F.coalesce("isolation_window_target", "precursor_mz")
    w = spectral.window_bounds(centre, F.lit(None).cast("double"), F.lit(None).cast("double"), 0.5)
    known = F.col("p").isNotNull() & centre.isNotNull()
    share = F.when(known, spectral.purity_fraction(F.col("p"), w["lo"], w["hi"], ref, 25.0))
    snapped = F.when(known, cleaning.snap_precursor(F.col("p"), ref, 15.0))
    out = rows.withColumn("_s", share).withColumn("_snap", snapped)
    return out.select("id", "parent_scan_id", *[F.when(known, w[x]).alias(f"window_{x}") for x in ("lo", "hi")], F.round("_s", 6).alias("purity_score"), (F.col("_s") >= 0.01).alias("precursor_confirmed"), F.round("_snap.mz", 6).alias("snapped_mz"))


def associated_purity(spark: SparkSession, d: str, cutoff: float = 0.8) -> DataFrame:
    """Per sample the associated MS2 scans of known purity and how many reach the cutoff."""
    p = purity_table(spark, d).where("purity_score is not null").select("id", "purity_score")
    a = associations(spark, d).where("feature_id is not null").select("id", "sample_id")
    return p.join(a, "id").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_associated"), F.count_if(F.col("purity_score") >= cutoff).alias("n_ge_cutoff"))


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    """MS2 peaks with the key of their scan's precursor: id, polarity, key, ref, m, i."""
    a = associations(spark, d).select("id", F.coalesce("precursor_mz", "isolation_window_target").alias("_pm")).where("_pm is not null")
    near = joins.nearest_ppm(a, features(spark, d).where("mz is not null").select(F.col("mz").alias("fmz"), "feature_id"), ["id"], "_pm", "fmz", 10.0, ["feature_id"])
    keys = windows.precursor_keys(near, "feature_id", "_pm", 10.0).select("id", "key", F.coalesce("matched_mz", "_pm").alias("ref"))
    spectra = ms2_spectra(spark, d).where("peaks is not null and polarity is not null").select("id", "polarity", "peaks")
    return spectra.join(keys, "id").select("id", "polarity", "key", "ref", F.explode("peaks").alias("x")).select("id", "polarity", "key", "ref", "x.m", "x.i")


def removed_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Fragments that recur whatever the precursor: listed from one in twenty precursors on, removed from one in two."""
    found = cleaning.removed_background(windows.background(_keyed(spark, d).select("polarity", "key", "m"), "m", "polarity", "key", 10.0))
    return found.select("polarity", F.round("mz", 4).alias("mz"), "n_keys", F.round("fraction", 6).alias("fraction"), "removed")


def cleaned_scans(spark: SparkSession, d: str) -> DataFrame:
    """Per MS2 scan its peaks, those above the precursor, those of the background, and those left."""
    peaks = stored(_keyed(spark, d))
    found = stored(cleaning.removed_background(windows.background(peaks.select("polarity", "key", "m"), "m", "polarity", "key", 10.0)).where("removed").select("polarity", F.col("mz").alias("_bg")))
    # By distinct position, however many scans share it; the peak is the window's centre.
    at = peaks.select("polarity", "m").distinct()
    hit = joins.ppm_join(found, at, "_bg", "m", 10.0, ["polarity"]).select("polarity", "m").distinct().withColumn("_hit", F.lit(True))
    above = F.col("m") > F.col("ref") * (1 + 10e-6)
    rows = peaks.join(hit, ["polarity", "m"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False))).withColumn("_above", above)
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_peaks"), F.count_if("_above").alias("n_above"), F.count_if("_hit").alias("n_background"), F.count_if(~F.col("_above") & ~F.col("_hit")).alias("n_left"))


def _average(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.average_spectrum(scans(spark, d), mapped(spark, d), ["sample_id"], "scan_id", "pixel_id", 70.0, 1000.0, 0.001)


def sample_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of each sample's averaged spectrum above the MAD threshold. The scans are centroids already, so the bins' own noise is no baseline: a factor of 0."""
    found = stored(windows.centroids(_average(spark, d), ["sample_id"], "bin", "mz", "intensity", 0.001, baseline_factor=0.0))
    limit = aggregates.mad_threshold(found, ["sample_id"], "intensity")
    return found.join(limit, "sample_id").where(F.col("intensity") > F.col("threshold")).select("sample_id", F.round("mz", 3).alias("mz"), F.round("intensity", 6).alias("intensity"))


def flat_filtered(spark: SparkSession, d: str, height: float = 10.0) -> DataFrame:
    """Bins of the averaged spectra that reach a fixed height, counted per sample: the filter without MAD."""
    rows = aggregates.average_spectrum(scans(spark, d), mapped(spark, d), ["sample_id"], "scan_id", "pixel_id", 70.0, 900.0, 0.5)
    return rows.groupBy("sample_id").agg(F.count_if(F.round(F.col("intensity") + 1e-8, 6) >= height).alias("n_kept"), F.count(F.lit(1)).alias("n_bins"))


def aligned_features(spark: SparkSession, d: str) -> DataFrame:
    """Features: the filtered centroids of all samples, aligned over samples."""
    peaks = stored(sample_centroids(spark, d))
    numbered = ranks.ranked(peaks, ["sample_id"], [F.asc("mz"), F.asc("intensity")], "idx")
    return windows.align_across(numbered, "mz", "sample_id", "idx", 5.0).select("feature_mz", "n_members")


def predicted_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Formulas within 10 ppm of each feature for the asked adducts, up to five per adduct."""
    out = formulas.predict(features(spark, d).where("mz is not null").select("feature_id", "mz"), ASKED)
    return out.select("feature_id", "adduct", "formula", F.round("mass_error", 9).alias("mass_error"), F.round("mass_error_ppm", 5).alias("mass_error_ppm"), "rank")


def top_formulas(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest formulas of each feature, whatever the adduct."""
    rank = F.row_number().over(Window.partitionBy("feature_id").orderBy(F.abs("mass_error_ppm"), "adduct", "formula"))
    # At most five rows per adduct and feature.
    return predicted_formulas(spark, d).withColumn("place", rank).where("place <= 3").select("feature_id", "adduct", "formula", "mass_error_ppm", "place")


def features_for_prediction(spark: SparkSession, d: str) -> DataFrame:
    """Every feature with its name so far: target list, MS2, or the nearest predicted formula with its adduct."""
    named = ms2_queries.representative_annotation(spark, d).select("feature_id", "mz", "best_score", F.when(F.col("source").isin("target_list", "ms2"), F.col("compound_name")).alias("known"))
    nearest = top_formulas(spark, d).where("place = 1").select("feature_id", F.concat_ws(" + ", "formula", "adduct").alias("predicted"))
    return named.join(nearest, "feature_id", "left").select("feature_id", "mz", F.coalesce("known", "predicted").alias("compound_name"), "best_score")


def feature_hits(spark: SparkSession, d: str) -> DataFrame:
    """Each feature's MS2 hits in the order they are shown (place): by rank in the feature, then score; one per compound for the top hits."""
    a = annotations(spark, d).where("feature_id is not null and n_matched_peaks is not null").select("id", "feature_id", "sample_id", "scan_id", "library_id", "compound_name", "inchikey", "score", "n_matched_peaks")
    ranked = windows.rank_with_tolerance(a, ["feature_id"], "score", "n_matched_peaks", ["id"], 0.05, "place")
    first = ranked.where("inchikey is not null").groupBy("feature_id", "inchikey").agg(F.min("place").alias("place")).withColumn("first_of_compound", F.lit(True)).drop("inchikey")
    return ranked.join(first, ["feature_id", "place"], "left").select("feature_id", "place", "id", "compound_name", "score", F.coalesce("first_of_compound", F.lit(False)).alias("first_of_compound"))


def precursor_table(spark: SparkSession, d: str) -> DataFrame:
    """Each feature's precursor candidates in order of rank, with the size of their tie and the feature's weighted m/z."""
    c = ms2_queries.precursor_candidates(spark, d)
    tied = c.groupBy("feature_id", "tie_rank").agg(F.count(F.lit(1)).alias("n_tied"))
    f = features(spark, d).select("feature_id", F.round("mz_weighted", 6).alias("mz_weighted"), F.round("mz_spread_ppm", 6).alias("mz_spread_ppm"))
    return c.join(tied, ["feature_id", "tie_rank"]).join(f, "feature_id", "left").select("feature_id", "rank", F.coalesce("tie_rank", "rank").alias("tie_rank"), "n_tied", "compound_id", "adduct", "ppm_error", "mz_weighted", "mz_spread_ppm")


def target_preview(spark: SparkSession, d: str) -> DataFrame:
    """Target compounds against the finished features, nothing written: every ion near a feature, a row for each compound found nowhere, and which to use: for a feature without a name so far, the nearest only."""
    ions = ms2_queries.library(spark, d).where(F.col("library_id") == 2).where(F.col("adduct").isin(*ASKED)).select("compound_id", "compound_name", "adduct", "ref_mz")
    near = joins.nearest_ppm(ions.withColumn("target_id", F.concat_ws(":", "compound_id", "adduct")), features(spark, d).where("mz is not null").select("mz", "feature_id"), ["target_id"], "ref_mz", "mz", 10.0, ["feature_id"])
    hits = near.where("feature_id is not null").withColumn("ppm", F.round(spectral.ppm_between(F.col("matched_mz"), F.col("ref_mz")), 4))
    named = ms2_queries.representative_annotation(spark, d).select("feature_id", F.coalesce("compound_name", F.lit("")).alias("current_name"), (F.col("source").isNull() | (F.col("source") == "predicted")).alias("free"))
    rows = hits.join(named, "feature_id")
    first = rows.where("free").groupBy("feature_id").agg(F.min_by(F.struct("compound_id", "adduct"), F.struct(F.abs("ppm"), "compound_id", "adduct")).alias("u")).select("feature_id", "u.*").withColumn("_use", F.lit(True))
    found = rows.join(first, ["feature_id", "compound_id", "adduct"], "left").select("compound_id", "compound_name", F.lit(True).alias("detected"), "adduct", "feature_id", "ppm", "current_name", F.coalesce("_use", F.lit(False)).alias("use"))
    missing = ions.select("compound_id", "compound_name").distinct().join(hits.select("compound_id").distinct(), "compound_id", "left_anti")
    return found.unionByName(missing.select("compound_id", "compound_name", F.lit(False).alias("detected"), F.lit("").alias("adduct"), F.lit(-1).cast("bigint").alias("feature_id"), F.lit(0.0).alias("ppm"), F.lit("").alias("current_name"), F.lit(False).alias("use")))


# Categories of peaks in the order they are shown.
CATEGORIES = ("no_ms2", "non_annotated", "annotated")


def peak_categories(spark: SparkSession, d: str) -> DataFrame:
    """Bins of each sample's averaged spectrum by the category of the feature nearest to them, whatever the distance: peaks and their greatest intensity, in the order shown."""
    f = features(spark, d).where("mz is not null").select("feature_id", "mz")
    a = associations(spark, d).where("feature_id is not null").select("feature_id").distinct().withColumn("_ms2", F.lit(True))
    n = annotations(spark, d).where("feature_id is not null").select("feature_id").distinct().withColumn("_named", F.lit(True))
    category = F.when(F.col("_named"), "annotated").when(F.col("_ms2"), "non_annotated").otherwise("no_ms2")
    kinds = f.join(a, "feature_id", "left").join(n, "feature_id", "left").select("feature_id", category.alias("category"))
    rows = aggregates.average_spectrum(scans(spark, d), mapped(spark, d), ["sample_id"], "scan_id", "pixel_id", 70.0, 900.0, 0.5)
    near = joins.nearest(rows, f.withColumnRenamed("mz", "fmz"), "mz", "fmz", "feature_id", width=5.0)
    out = near.join(kinds, "feature_id").groupBy("sample_id", "category").agg(F.count(F.lit(1)).alias("n_peaks"), F.round(F.max("intensity") + 1e-8, 6).alias("highest"))
    return out.withColumn("place", F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")).cast("int"))


QUERIES = {f.__name__: f for f in (ms2_annotate, ms2_outcome, mirror_data, purity_table, associated_purity, removed_fragments, cleaned_scans, sample_centroids, flat_filtered, aligned_features, predicted_formulas, top_formulas, features_for_prediction, feature_hits, precursor_table, target_preview, peak_categories)}

_BASE = ms2_queries._BASE + """, par AS (
  SELECT l.id, r.scan_id AS parent_scan_id FROM (SELECT id, sample_id, polarity, rt FROM a WHERE rt IS NOT NULL AND polarity IS NOT NULL) l
  ASOF LEFT JOIN (SELECT sample_id, polarity, rt, max(scan_id) AS scan_id FROM s WHERE rt IS NOT NULL AND polarity IS NOT NULL GROUP BY ALL) r ON l.sample_id = r.sample_id AND l.polarity = r.polarity AND l.rt >= r.rt
), sp AS (
  SELECT a.id, a.sample_id, a.scan_id, a.feature_id, a.polarity, a.precursor_mz, a.isolation_window_target, a.flat_fragmentation, parent_scan_id, s.mz, s.intensity
  FROM a LEFT JOIN par USING (id) LEFT JOIN s ON s.sample_id = a.sample_id AND s.scan_id = parent_scan_id
), one AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, scan_id ORDER BY id) AS rn FROM sp) WHERE rn = 1
)"""
#: Peaks as shares of the strongest, from one in a hundred on.
_SCALED = "SELECT * REPLACE (CASE WHEN top > 0 THEN i / top ELSE i END AS i) FROM (SELECT *, max(i) OVER (PARTITION BY {k}) AS top FROM ({t})) WHERE top <= 0 OR i / top >= 0.01"
_UNNEST = "SELECT {k}, CAST(unnest(mz) AS DOUBLE) AS m, CAST(unnest(intensity) AS DOUBLE) AS i, generate_subscripts(mz, 1) AS p FROM {t}"
_SCORED = _BASE + f""", lb AS (
  SELECT library_id, library_spectrum_id AS spectrum_id, one.precursor_mz AS ref_mz, one.polarity, one.mz, one.intensity
  FROM (SELECT *, row_number() OVER (PARTITION BY library_id, library_spectrum_id ORDER BY score DESC, id) AS rk FROM n WHERE library_spectrum_id IS NOT NULL) b JOIN one ON one.sample_id = b.sample_id AND one.scan_id = b.scan_id
  WHERE rk = 1 AND one.precursor_mz IS NOT NULL AND one.mz IS NOT NULL
), us AS (SELECT * FROM one WHERE feature_id IS NOT NULL AND coalesce(flat_fragmentation, 0) != 1 AND mz IS NOT NULL
), cd AS (
  SELECT k.feature_id, k.polarity, library_id, spectrum_id FROM (SELECT DISTINCT feature_id, polarity FROM us) k JOIN f ON f.feature_id = k.feature_id
  JOIN lb ON lb.ref_mz BETWEEN f.mz - f.mz * 1e-5 AND f.mz + f.mz * 1e-5 AND (lb.polarity IS NULL OR k.polarity IS NULL OR lb.polarity = k.polarity)
), pr AS (
  SELECT us.sample_id, us.scan_id, us.feature_id, library_id, spectrum_id FROM us JOIN cd ON cd.feature_id = us.feature_id AND cd.polarity IS NOT DISTINCT FROM us.polarity
), qp AS ({_SCALED.format(k="sample_id, scan_id", t=_UNNEST.format(k="sample_id, scan_id", t="us"))}
), lp AS ({_SCALED.format(k="library_id, spectrum_id", t=_UNNEST.format(k="library_id, spectrum_id", t="lb"))}
), mt AS (
  SELECT pr.*, lp.p, lp.m, lp.i, (SELECT max(qp.i) FROM qp WHERE qp.sample_id = pr.sample_id AND qp.scan_id = pr.scan_id AND abs(qp.m - lp.m) <= lp.m * 1e-5) AS q FROM pr JOIN lp USING (library_id, spectrum_id)
), ec AS (
  SELECT pr.*, (SELECT count(*) FROM qp WHERE qp.sample_id = pr.sample_id AND qp.scan_id = pr.scan_id AND EXISTS (SELECT 1 FROM lp WHERE lp.library_id = pr.library_id AND lp.spectrum_id = pr.spectrum_id AND abs(lp.m - qp.m) <= qp.m * 1e-5)) AS ne,
    (SELECT count(*) FROM qp WHERE qp.sample_id = pr.sample_id AND qp.scan_id = pr.scan_id) AS nq FROM pr
), sm AS (
  SELECT sample_id, scan_id, feature_id, library_id, spectrum_id, sum(sqrt(i) * m * m * sqrt(coalesce(q, 0)) * m * m) AS lq, sum(i * m * m * m * m) AS ll, sum(coalesce(q, 0) * m * m * m * m) AS qq, count(q) AS nm, count(*) AS nl FROM mt GROUP BY ALL
), sc AS (
  SELECT *, least(1, dot * sqrt(lc) * sqrt(em)) AS score FROM (
    SELECT sm.*, CASE WHEN ll > 0 AND qq > 0 THEN least(1, lq / (sqrt(ll) * sqrt(qq))) ELSE 0 END AS dot, nm / nl AS lc, ne / nq AS em FROM sm JOIN ec USING (sample_id, scan_id, feature_id, library_id, spectrum_id))
)"""
_KEYED = _BASE + """, pm AS (SELECT id, coalesce(precursor_mz, isolation_window_target) AS pm FROM a), nk AS (
  SELECT id, feature_id, mz, row_number() OVER (PARTITION BY id ORDER BY abs((pm - mz) / mz), mz, feature_id) AS rn FROM pm JOIN f ON pm BETWEEN mz - mz * 1e-5 AND mz + mz * 1e-5
), kp AS (
  SELECT sp.id, polarity, coalesce(nk.feature_id, CAST(-1 - floor(ln(pm) / ln(1.00001)) AS BIGINT)) AS key, coalesce(nk.mz, pm) AS ref, CAST(unnest(sp.mz) AS DOUBLE) AS m
  FROM sp JOIN pm USING (id) LEFT JOIN nk ON nk.id = sp.id AND rn = 1 WHERE pm IS NOT NULL AND polarity IS NOT NULL AND sp.mz IS NOT NULL
), x AS (SELECT polarity, key, m, ln(m) AS l FROM kp),
 gp AS (SELECT *, CASE WHEN l - lag(l) OVER (PARTITION BY polarity ORDER BY l) > ln(1.00001) THEN 1 ELSE 0 END AS brk FROM x),
 il AS (SELECT *, sum(brk) OVER (PARTITION BY polarity ORDER BY l) AS island FROM gp),
 pc AS (SELECT *, floor((l - min(l) OVER (PARTITION BY polarity, island)) / ln(1.00001) / 2) AS piece FROM il),
 tt AS (SELECT polarity, count(DISTINCT key) AS n_total FROM x GROUP BY ALL),
 bg AS (SELECT polarity, avg(m) AS mz, count(DISTINCT key) AS n_keys, count(DISTINCT key) / any_value(n_total) AS fraction FROM pc JOIN tt USING (polarity) GROUP BY polarity, island, piece)"""
_ELEMENTS = formulas.BOUNDS
_FORMULAS = ms2_queries._BASE + f""", cp AS (
  SELECT c, n_, o, p, s_, c * {chemistry.MASS['C']!r} + n_ * {chemistry.MASS['N']!r} + o * {chemistry.MASS['O']!r} + p * {chemistry.MASS['P']!r} + s_ * {chemistry.MASS['S']!r} AS rest
  FROM range(1, {_ELEMENTS['C'] + 1}) t1(c), range(0, {_ELEMENTS['N'] + 1}) t2(n_), range(0, {_ELEMENTS['O'] + 1}) t3(o), range(0, {_ELEMENTS['P'] + 1}) t4(p), range(0, {_ELEMENTS['S'] + 1}) t5(s_)
  WHERE n_ <= floor(c * 1.3) AND o <= floor(c * 1.2) AND p <= floor(c * 0.3) AND s_ <= floor(c * 0.8)
), ak AS (
  SELECT feature_id, mz, adduct, (mz * abs(charge) - delta) / molecules AS mass, mz * abs(charge) / molecules * 1e-5 AS tol, molecules, charge FROM f, adds WHERE adduct IN ('[M+H]+', '[M-H]-') AND mz > 0
), fm AS (
  SELECT *, CAST(round((mass - rest) / {chemistry.MASS['H']!r}) AS INT) AS h FROM ak JOIN cp ON rest <= mass + tol AND rest >= mass - {chemistry.MASS['H']!r} * 3.2 * c - 1 AND abs(mass - rest - round((mass - rest) / {chemistry.MASS['H']!r}) * {chemistry.MASS['H']!r}) <= tol
), fo AS (
  SELECT feature_id, adduct, 'C' || CASE WHEN c > 1 THEN CAST(c AS VARCHAR) ELSE '' END || CASE WHEN h > 0 THEN 'H' || CASE WHEN h > 1 THEN CAST(h AS VARCHAR) ELSE '' END ELSE '' END || CASE WHEN n_ > 0 THEN 'N' || CASE WHEN n_ > 1 THEN CAST(n_ AS VARCHAR) ELSE '' END ELSE '' END
    || CASE WHEN o > 0 THEN 'O' || CASE WHEN o > 1 THEN CAST(o AS VARCHAR) ELSE '' END ELSE '' END || CASE WHEN p > 0 THEN 'P' || CASE WHEN p > 1 THEN CAST(p AS VARCHAR) ELSE '' END ELSE '' END || CASE WHEN s_ > 0 THEN 'S' || CASE WHEN s_ > 1 THEN CAST(s_ AS VARCHAR) ELSE '' END ELSE '' END AS formula,
    mass - rest - h * {chemistry.MASS['H']!r} AS err, mz FROM fm WHERE h BETWEEN 0.1 * c AND 3.1 * c AND 2 * c + 2 + n_ + p - h >= 0 AND (2 * c + 2 + n_ + p - h) % 2 = 0
), fr AS (SELECT feature_id, adduct, formula, err, err / (mz - err) * 1e6 AS ppm, row_number() OVER (PARTITION BY feature_id, adduct ORDER BY round(abs(err / (mz - err) * 1e6), 6), formula) AS rank FROM fo
), ft AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY abs(round(ppm, 5)), adduct, formula) AS place FROM fr WHERE rank <= 5)"""
_AVERAGE = ms1_queries._BASE + """, u AS (SELECT s.sample_id, mz, intensity FROM s WHERE EXISTS (SELECT 1 FROM mp WHERE mp.sample_id = s.sample_id AND mp.scan_id = s.scan_id)),
 b AS (SELECT sample_id, CAST(trunc((m - CAST(70 AS FLOAT)) / CAST(0.5 AS FLOAT)) AS BIGINT) AS bin, CAST(i AS DOUBLE) AS i FROM (SELECT sample_id, unnest(mz) AS m, unnest(intensity) AS i FROM u)),
 np AS (SELECT sample_id, count(DISTINCT pixel_id) AS n FROM mp WHERE EXISTS (SELECT 1 FROM s WHERE mp.sample_id = s.sample_id AND mp.scan_id = s.scan_id) GROUP BY ALL),
 av AS (SELECT sample_id, bin, 70 + (bin + 0.5) * 0.5 AS mz, sum(i) / any_value(n) AS intensity FROM b JOIN np USING (sample_id) WHERE bin BETWEEN 0 AND 1659 GROUP BY ALL)"""

ORACLE = {
    "precursor_table": ms2_queries._BASE + f""" SELECT c.feature_id, rank, tie_rank, count(*) OVER (PARTITION BY c.feature_id, tie_rank) AS n_tied, compound_id, adduct, ppm_error, round(mz_weighted, 6) AS mz_weighted, round(mz_spread_ppm, 6) AS mz_spread_ppm
 FROM ({ms2_queries.ORACLE['precursor_candidates']}) c LEFT JOIN f ON f.feature_id = c.feature_id""",
    "target_preview": ms2_queries._BASE + """, tg AS (SELECT compound_id, compound_name, adduct, ref_mz FROM lib WHERE library_id = 2 AND adduct IN ('[M+H]+', '[M-H]-')),
 nb AS (SELECT tg.*, feature_id, round((mz - ref_mz) / ref_mz * 1e6, 4) AS ppm, row_number() OVER (PARTITION BY compound_id, adduct ORDER BY abs((ref_mz - mz) / mz), mz, feature_id) AS rn FROM tg JOIN f ON ref_mz BETWEEN mz - mz * 1e-5 AND mz + mz * 1e-5),
 ht AS (SELECT nb.*, coalesce(rep.compound_name, '') AS current_name, coalesce(source = 'predicted', true) AS free FROM nb JOIN rep USING (feature_id) WHERE rn = 1),
 us AS (SELECT *, free AND row_number() OVER (PARTITION BY feature_id, free ORDER BY abs(ppm), compound_id, adduct) = 1 AS use FROM ht)
 SELECT compound_id, compound_name, true AS detected, adduct, feature_id, ppm, current_name, use FROM us
 UNION ALL SELECT DISTINCT compound_id, compound_name, false, '', -1, 0.0, '', false FROM tg WHERE compound_id NOT IN (SELECT compound_id FROM ht)""",
    "associated_purity": ms2_queries._BASE + ms2_queries._PURITY + " SELECT a.sample_id, count(*) AS n_associated, count(*) FILTER (purity_score >= 0.8) AS n_ge_cutoff FROM pu JOIN a USING (id) WHERE feature_id IS NOT NULL GROUP BY ALL",
    "ms2_annotate": _SCORED + """ SELECT sample_id, scan_id, feature_id, library_id, spectrum_id, round(score, 6) AS score, round(dot, 6) AS dot_product_score, round(lc, 6) AS lib_coverage, round(em, 6) AS emp_coverage, CAST(nm AS INT) AS n_matched_peaks, CAST(nl AS INT) AS n_lib_peaks,
 CAST(row_number() OVER (PARTITION BY sample_id, scan_id ORDER BY round(score, 9) DESC, library_id, spectrum_id) AS INT) AS rank_ms2 FROM sc WHERE nm >= 1""",
    "ms2_outcome": _SCORED + """, o AS (SELECT feature_id, count(*) AS n_scans, count(*) FILTER (coalesce(flat_fragmentation, 0) = 1) AS n_skipped_flat, CAST(0 AS BIGINT) AS n_skipped_purity, count(*) FILTER (coalesce(flat_fragmentation, 0) != 1 AND mz IS NULL) AS n_skipped_unreadable FROM one WHERE feature_id IS NOT NULL GROUP BY ALL)
 SELECT o.*, coalesce(nc, 0) AS n_candidates, CAST(coalesce(bm, 0) AS INT) AS best_n_matched_peaks, CASE WHEN n_skipped_flat + n_skipped_unreadable = n_scans THEN 'all_scans_skipped' WHEN bm >= 1 THEN 'annotated' WHEN nc > 0 THEN 'no_shared_fragments' ELSE 'no_candidates' END AS outcome
 FROM o LEFT JOIN (SELECT feature_id, count(*) AS nc FROM cd GROUP BY ALL) USING (feature_id) LEFT JOIN (SELECT feature_id, max(nm) AS bm FROM sc GROUP BY ALL) USING (feature_id)""",
    "mirror_data": _SCORED + f""", be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY round(score, 9) DESC, sample_id, scan_id, library_id, spectrum_id) AS rk FROM sc WHERE nm >= 1) WHERE rk = 1),
 eq AS ({_UNNEST.format(k="sample_id, scan_id", t="us")}), el AS ({_UNNEST.format(k="library_id, spectrum_id", t="lb")}),
 q AS (SELECT be.feature_id, eq.m, EXISTS (SELECT 1 FROM el WHERE el.library_id = be.library_id AND el.spectrum_id = be.spectrum_id AND abs(el.m - eq.m) <= eq.m * 1e-5) AS hit FROM be JOIN eq ON eq.sample_id = be.sample_id AND eq.scan_id = be.scan_id),
 l AS (SELECT be.feature_id, el.m, el.i, EXISTS (SELECT 1 FROM eq WHERE eq.sample_id = be.sample_id AND eq.scan_id = be.scan_id AND abs(el.m - eq.m) <= el.m * 1e-5) AS hit FROM be JOIN el ON el.library_id = be.library_id AND el.spectrum_id = be.spectrum_id),
 q2 AS (SELECT feature_id, CAST(count(*) FILTER (hit) AS INT) AS n_matched, CAST(count(*) FILTER (NOT hit) AS INT) AS n_unmatched FROM q GROUP BY ALL), l2 AS (SELECT feature_id, CAST(count(*) FILTER (hit) AS INT) AS n_library_matched, CAST(count(*) FILTER (NOT hit) AS INT) AS n_library_unmatched, round(-sum(i) FILTER (hit), 3) + 0.0 AS library_matched_sum FROM l GROUP BY ALL)
 SELECT be.feature_id, be.library_id, be.spectrum_id, n_matched, n_unmatched, n_library_matched, n_library_unmatched, n_library_matched AS n_connectors, library_matched_sum FROM be JOIN q2 USING (feature_id) JOIN l2 USING (feature_id)""",
    "removed_fragments": _KEYED + " SELECT polarity, round(mz, 4) AS mz, n_keys, round(fraction, 6) AS fraction, 100 * fraction >= 50 AS removed FROM bg WHERE fraction >= 0.05",
    "cleaned_scans": _KEYED + """, h AS (SELECT DISTINCT polarity, m FROM x WHERE EXISTS (SELECT 1 FROM bg WHERE bg.polarity = x.polarity AND 100 * fraction >= 50 AND abs(bg.mz - x.m) <= x.m * 1e-5)),
 r AS (SELECT kp.id, kp.m > kp.ref * (1 + 10e-6) AS above, h.m IS NOT NULL AS hit FROM kp LEFT JOIN h ON h.polarity = kp.polarity AND h.m = kp.m)
 SELECT id, count(*) AS n_peaks, count(*) FILTER (above) AS n_above, count(*) FILTER (hit) AS n_background, count(*) FILTER (NOT above AND NOT hit) AS n_left FROM r GROUP BY ALL""",
    "flat_filtered": _AVERAGE + " SELECT sample_id, count(*) FILTER (round(intensity + 1e-8, 6) >= 10) AS n_kept, count(*) AS n_bins FROM av GROUP BY ALL",
    "predicted_formulas": _FORMULAS + " SELECT feature_id, adduct, formula, round(err, 9) AS mass_error, round(ppm, 5) AS mass_error_ppm, CAST(rank AS INT) AS rank FROM fr WHERE rank <= 5",
    "top_formulas": _FORMULAS + " SELECT feature_id, adduct, formula, round(ppm, 5) AS mass_error_ppm, CAST(place AS INT) AS place FROM ft WHERE place <= 3",
    "features_for_prediction": _FORMULAS + " SELECT rep.feature_id, mz, coalesce(CASE WHEN source IN ('target_list', 'ms2') THEN compound_name END, formula || ' + ' || adduct) AS compound_name, best_score FROM rep LEFT JOIN ft ON ft.feature_id = rep.feature_id AND place = 1",
    "feature_hits": _BASE + """, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY feature_id ORDER BY ff DESC, score DESC, id) AS INT) AS place FROM firsts)
 SELECT feature_id, place, id, compound_name, score, inchikey IS NOT NULL AND place = min(place) OVER (PARTITION BY feature_id, inchikey) AS first_of_compound FROM r""",
    "peak_categories": _AVERAGE + """, ks AS (SELECT f.feature_id, mz, CASE WHEN EXISTS (SELECT 1 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn FROM ms2_annotations) n WHERE rn = 1 AND score BETWEEN 0 AND 1 AND n.feature_id = f.feature_id) THEN 'annotated'
  WHEN EXISTS (SELECT 1 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn FROM ms2_associations) a WHERE rn = 1 AND a.feature_id = f.feature_id) THEN 'non_annotated' ELSE 'no_ms2' END AS category FROM f WHERE mz IS NOT NULL),
 v AS (SELECT DISTINCT mz FROM av), nr AS (SELECT v.mz, category, row_number() OVER (PARTITION BY v.mz ORDER BY abs(v.mz - ks.mz), ks.mz, feature_id) AS rn FROM v, ks)
 SELECT sample_id, category, count(*) AS n_peaks, round(max(intensity) + 1e-8, 6) AS highest, CASE category WHEN 'no_ms2' THEN 1 WHEN 'non_annotated' THEN 2 ELSE 3 END AS place FROM av JOIN nr ON nr.mz = av.mz AND rn = 1 GROUP BY ALL""",
}
