"""MS2 side: associations, purity, annotation ranks, candidates, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionloom.functions import chemistry, search, spectral
from ionloom.operators import aggregates, joins, ranks, windows
from ionloom.operators.lifecycle import latest, move_rows, upsert
from ionloom.plans import ms1_queries
from ionloom.plans.ms1_queries import features, scans
from ionloom.sources.tables import table


def associations(spark: SparkSession, d: str) -> DataFrame:
    """MS2 scans, of repeated deliveries the last; NaN as NULL, polarity spelt one way."""
    df = latest(table(spark, d, "ms2_associations"), ["id"], ["loaded_at"])
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    return df.withColumns({c: real(c) for c in ("rt", "ppm_offset", "precursor_mz", "isolation_window_target", "fragmentation_factor")} | {"polarity": spectral.normalize_polarity(F.col("polarity"))})


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """Library candidates with a score from 0 to 1, of repeated deliveries the last."""
    df = latest(table(spark, d, "ms2_annotations"), ["id"], ["loaded_at"])
    return df.where("score between 0 and 1").withColumn("inchikey", F.nullif(F.upper(F.trim("inchikey")), F.lit("")))


def scan_association(spark: SparkSession, d: str) -> DataFrame:
    """Each MS2 scan with the feature nearest in ppm to its precursor, inside the isolation window, or none."""
    a = associations(spark, d).select("id", "isolation_window_target", F.coalesce("precursor_mz", "isolation_window_target").alias("match_mz"), F.when(F.col("precursor_mz").isNotNull(), "precursor_mz").when(F.col("isolation_window_target").isNotNull(), "isolation_window_target").otherwise("none").alias("matched_by"))
    pairs = joins.ppm_join(a.where("match_mz is not null"), features(spark, d).where("mz is not null").select("feature_id", F.col("mz").alias("fmz")), "match_mz", "fmz", 10.0)
    window = F.coalesce(F.abs(F.col("fmz") - F.col("isolation_window_target")) <= 0.5, F.lit(True))
    best = pairs.where(window).groupBy("id").agg(F.min_by(F.struct("feature_id", "fmz"), F.struct(F.abs((F.col("match_mz") - F.col("fmz")) / F.col("fmz")), "fmz", "feature_id")).alias("b"))
    return a.join(best, "id", "left").select("id", "matched_by", F.col("b.feature_id").alias("feature_id"), F.round(spectral.ppm_between(F.col("match_mz"), F.col("b.fmz")), 3).alias("ppm"))


def precursor_key_counts(spark: SparkSession, d: str) -> DataFrame:
    """Scans per precursor key: the nearest feature, or a negative m/z bin."""
    a = associations(spark, d).where("precursor_mz is not null").select("id", "precursor_mz")
    hit = joins.nearest_ppm(a, features(spark, d).where("mz is not null").select("mz", "feature_id"), ["id"], "precursor_mz", "mz", 10.0, ["feature_id"])
    return windows.precursor_keys(hit, "feature_id", "precursor_mz", 10.0).groupBy("key").agg(F.count(F.lit(1)).alias("n_scans"))


def parent_scan(spark: SparkSession, d: str) -> DataFrame:
    """The last MS1 scan at or before each MS2 scan, of the same sample and polarity."""
    left = associations(spark, d).where("rt is not null and polarity is not null").select("id", "sample_id", "polarity", "rt")
    right = scans(spark, d).where("rt is not null and polarity is not null").select("sample_id", "polarity", F.col("rt").alias("rt1"), F.col("scan_id").alias("parent_scan_id"))
    return joins.asof(left, right, "rt", "rt1", "parent_scan_id", ["sample_id", "polarity"], width=300.0).select("id", "parent_scan_id")


def scan_purity(spark: SparkSession, d: str) -> DataFrame:
    """Share of the parent spectrum's intensity in the isolation window (half a dalton to both sides) that lies within 25 ppm of the scan's precursor."""
    s = scans(spark, d)
    links = parent_scan(spark, d).where("parent_scan_id is not null").join(associations(spark, d).select("id", "sample_id", "precursor_mz", "isolation_window_target"), "id")
    rows = links.join(s.select("sample_id", F.col("scan_id").alias("parent_scan_id"), "mz", "intensity"), ["sample_id", "parent_scan_id"])
    centre, ref = F.coalesce("isolation_window_target", "precursor_mz"), F.coalesce("precursor_mz", "isolation_window_target")
    w = spectral.window_bounds(centre, F.lit(None).cast("double"), F.lit(None).cast("double"), 0.5)
    p = spectral.purity_fraction(spectral.peaks(F.col("mz"), F.col("intensity")), w["lo"], w["hi"], ref, 25.0)
    return rows.where(ref.isNotNull()).select("id", F.round(p, 6).alias("purity_score"))


def unassociated_recheck(spark: SparkSession, d: str) -> DataFrame:
    """Unmatched MS2 scans per sample, and those that a feature lies near after all (wider tolerance, inside the window)."""
    a = associations(spark, d).where("feature_id is null").select("id", "sample_id", "isolation_window_target", F.coalesce("precursor_mz", "isolation_window_target").alias("m"))
    hits = joins.ppm_join(a.where("m is not null"), features(spark, d).where("mz is not null").select(F.col("mz").alias("fmz")), "m", "fmz", 50.0).where(F.coalesce(F.abs(F.col("fmz") - F.col("isolation_window_target")) <= 0.5, F.lit(True))).select("id").distinct()
    return a.join(hits.withColumn("hit", F.lit(True)), "id", "left").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_unassociated"), F.count_if("hit").alias("n_near_a_feature"))


def feature_ms2_summary(spark: SparkSession, d: str) -> DataFrame:
    a = associations(spark, d).where("feature_id is not null")
    out = a.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_scans"), F.count_distinct("sample_id").alias("n_samples"), F.round(F.avg("fragmentation_factor"), 9).alias("mean_factor"), F.count_if(F.col("n_peaks") <= 1).alias("n_single_peak"), F.count_if(F.col("flat_fragmentation") == 1).alias("n_flat"))
    middle = ranks.percentiles(a, ["feature_id"], "n_peaks", [0.5]).select("feature_id", F.get("q", F.lit(0)).alias("median_peaks"))
    return out.join(middle, "feature_id", "left")


def annotation_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of candidates: within the scan, within the feature (the richest within tolerance first), and of scans by their best."""
    a = annotations(spark, d).select("id", "sample_id", "scan_id", "feature_id", "score", "n_matched_peaks").where("feature_id is not null and n_matched_peaks is not null")
    a = windows.rank_in_group(a, ["sample_id", "scan_id"], [F.desc("score"), F.asc("id")], "rank_in_scan")
    a = windows.rank_with_tolerance(a, ["feature_id"], "score", "n_matched_peaks", ["id"], 0.05, "rank_feature")
    a = windows.rank_with_tolerance(a, ["feature_id", "sample_id"], "score", "n_matched_peaks", ["id"], 0.05, "rank_feature_sample")
    a = windows.rank_by_best(a, ["feature_id"], ["sample_id", "scan_id"], "score", "scan_rank_feature")
    return a.select("id", "rank_in_scan", "rank_feature", "rank_feature_sample", "scan_rank_feature")


def compound_scores(spark: SparkSession, d: str) -> DataFrame:
    a = annotations(spark, d).where("feature_id is not null")
    return aggregates.compound_scores(a, "feature_id", "inchikey", "score", ["id"], ["id", "compound_name", "compound_formula"], ["sample_id", "scan_id"]).select("feature_id", "inchikey", "best_score", F.col("id").alias("best_id"), "compound_name", "compound_formula", "n_rows", "n_scans")


def consensus_scan(spark: SparkSession, d: str) -> DataFrame:
    """The MS2 scan that represents each feature; the fragmentation factor stands in for purity."""
    best = annotations(spark, d).groupBy("sample_id", "scan_id").agg(F.max("score").alias("best_score"))
    s = associations(spark, d).where("feature_id is not null and n_peaks is not null").join(best, ["sample_id", "scan_id"], "left")
    out = windows.consensus(s, ["feature_id"], "n_peaks", "fragmentation_factor", "best_score", ["sample_id", "scan_id", "id"], min_purity=0.2)
    return out.select("feature_id", "id", F.round("consensus_score", 10).alias("consensus_score"), "n_scans", "n_considered")


def consensus_by_purity(spark: SparkSession, d: str) -> DataFrame:
    """The MS2 scan that represents each feature by the purity of its precursor; an unknown purity counts as neutral and bars no scan."""
    best = annotations(spark, d).groupBy("sample_id", "scan_id").agg(F.max("score").alias("best_score"))
    s = associations(spark, d).where("feature_id is not null and n_peaks is not null").join(best, ["sample_id", "scan_id"], "left").join(scan_purity(spark, d), "id", "left")
    out = windows.consensus(s, ["feature_id"], "n_peaks", "purity_score", "best_score", ["sample_id", "scan_id", "id"], min_purity=0.2, keep_unknown=True)
    return out.select("feature_id", "id", F.round("consensus_score", 10).alias("consensus_score"), "n_scans", "n_considered")


def annotation_outcome(spark: SparkSession, d: str) -> DataFrame:
    """What became of each feature with MS2: all scans skipped, annotated, no shared fragments, no candidates."""
    a = associations(spark, d).where("feature_id is not null")
    usable = a.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_scans"), F.count_if(F.coalesce(F.col("flat_fragmentation"), F.lit(0)) == 1).alias("n_flat"))
    c = table(spark, d, "ms2_annotations").where("feature_id is not null").groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("n_matched_peaks") > 0).alias("n_matched"))
    outcome = F.when(F.col("n_flat") == F.col("n_scans"), "all_scans_skipped").when(F.col("n_matched") > 0, "annotated").when(F.col("n_candidates") > 0, "no_shared_fragments").otherwise("no_candidates")
    return usable.join(c, "feature_id", "left").select("feature_id", outcome.alias("outcome"))


def candidate_names(spark: SparkSession, d: str) -> DataFrame:
    """Up to five names per feature, by best score."""
    best = annotations(spark, d).where("feature_id is not null and compound_name is not null").groupBy("feature_id", "compound_name").agg(F.max("score").alias("s"))
    top = windows.rank_in_group(best, ["feature_id"], [F.desc("s"), F.asc("compound_name")], "n").where("n <= 5")
    return top.groupBy("feature_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "compound_name"))), lambda x: x["compound_name"]), "; ").alias("names"))


def library(spark: SparkSession, d: str) -> DataFrame:
    """Distinct library compounds (of several names the first, a missing one last) with the m/z of each of their ions that a polarity allows."""
    c = table(spark, d, "ms2_annotations").where("compound_id is not null").groupBy("library_id", "compound_id").agg(F.min_by(F.struct("compound_name", "compound_formula"), F.struct(F.col("compound_name").isNull(), "compound_name", F.col("compound_formula").isNull(), "compound_formula")).alias("c")).select("library_id", "compound_id", "c.*")
    c = c.withColumn("mass", chemistry.neutral_mass(F.col("compound_formula"))).where("mass is not null")
    # 16 fixed rows.
    ions = c.crossJoin(F.broadcast(chemistry.adducts(spark)))
    return ions.select("library_id", "compound_id", "compound_name", "compound_formula", "adduct", chemistry.adduct_mz(F.col("mass"), F.col("charge"), F.col("molecules"), F.col("delta")).alias("ref_mz"))


def precursor_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Library ions within 5 ppm of a feature, ranked by distance; near-equal distances share a tie rank."""
    lib = library(spark, d).where("library_id = 1")
    pairs = joins.ppm_join(features(spark, d).where("mz is not null").select("feature_id", "mz"), lib, "mz", "ref_mz", 5.0)
    pairs = pairs.withColumn("ppm", spectral.ppm_between(F.col("mz"), F.col("ref_mz"))).withColumn("abs_ppm", F.round(F.abs("ppm"), 6)).withColumn("spread", F.lit(0.5))
    ranked = windows.rank_in_group(pairs, ["feature_id"], [F.asc("abs_ppm"), F.asc("compound_id"), F.asc("adduct")], "rank")
    return windows.tie_ranks(ranked, ["feature_id"], "abs_ppm", "spread", ["compound_id", "adduct"]).select("feature_id", "compound_id", "compound_name", "compound_formula", "adduct", F.round("ppm", 4).alias("ppm_error"), "rank", "tie_rank")


def representative_annotation(spark: SparkSession, d: str) -> DataFrame:
    """One identity per feature: target list before MS2 before precursor m/z before predicted formula; features without any are kept."""
    f = features(spark, d).select("feature_id", "mz", "origin")
    a = annotations(spark, d).where("feature_id is not null and n_matched_peaks is not null").withColumn("adduct", chemistry.tidy_adduct(F.col("adduct")))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), ",")
    injected = a.where("library_id = 2").join(f.where("origin = 'injected'").select("feature_id"), "feature_id", "left_semi")
    target = injected.groupBy("feature_id").agg(joined("compound_name").alias("t_name"), joined("compound_formula").alias("t_formula"), F.nullif(joined("inchikey"), F.lit("")).alias("t_key"))
    ms2 = windows.first_with_tolerance(a, ["feature_id"], "score", "n_matched_peaks", ["id"], ["id", "compound_name", "compound_formula", "inchikey", "score", "n_matched_peaks"], 0.05).select("feature_id", F.col("compound_name").alias("m_name"), F.col("compound_formula").alias("m_formula"), F.col("inchikey").alias("m_key"), F.col("score").alias("best_score"), "n_matched_peaks", F.col("id").alias("m_id"))
    pc = precursor_candidates(spark, d)
    # Window counts group NULLs together, as a NULL-safe comparison would.
    same = F.count(F.lit(1)).over(Window.partitionBy("feature_id", "compound_formula", "adduct"))
    pre = pc.withColumn("n_same", same).withColumn("n_precursor_candidates", F.count(F.lit(1)).over(Window.partitionBy("feature_id"))).where("rank = 1")
    p_name = F.concat(F.coalesce("compound_formula", "compound_name"), F.coalesce(F.concat(F.lit(" + "), "adduct"), F.lit("")), F.lit(" ("), F.col("n_same").cast("string"), F.when(F.col("n_same") == 1, " candidate)").otherwise(" candidates)"))
    pre = pre.select("feature_id", p_name.alias("p_name"), F.col("compound_formula").alias("p_formula"), F.col("ppm_error").alias("precursor_ppm"), "n_precursor_candidates")
    wide = joins.ppm_join(f.select("feature_id", "mz").where("mz is not null"), library(spark, d).where("library_id = 3"), "mz", "ref_mz", 25.0)
    pred = windows.rank_in_group(wide.withColumn("_d", F.round(F.abs(spectral.ppm_between(F.col("mz"), F.col("ref_mz"))), 6)), ["feature_id"], [F.asc("_d"), F.asc("compound_formula"), F.asc("adduct")], "n").where("n = 1").select("feature_id", F.col("compound_formula").alias("f_formula"), F.concat("compound_formula", F.lit(" + "), "adduct").alias("f_name"))
    out = f.join(target, "feature_id", "left").join(ms2, "feature_id", "left").join(pre, "feature_id", "left").join(pred, "feature_id", "left")
    source = F.when(F.col("t_name").isNotNull(), "target_list").when(F.col("m_id").isNotNull(), "ms2").when(F.col("p_name").isNotNull(), "precursor").when(F.col("f_name").isNotNull(), "predicted")
    return out.select("feature_id", "mz", F.coalesce("t_name", "m_name", "p_name", "f_name").alias("compound_name"), F.coalesce("t_formula", "m_formula", "p_formula", "f_formula").alias("compound_formula"), F.coalesce("t_key", "m_key").alias("inchikey"), source.alias("source"), "best_score", "n_matched_peaks", "precursor_ppm", F.coalesce("n_precursor_candidates", F.lit(0).cast("bigint")).alias("n_precursor_candidates"))


def feature_categories(spark: SparkSession, d: str) -> DataFrame:
    """Features per category: target, annotated, precursor only, with MS2, without."""
    r = representative_annotation(spark, d).select("feature_id", "source")
    with_ms2 = associations(spark, d).where("feature_id is not null").select("feature_id").distinct().withColumn("ms2", F.lit(True))
    category = F.when(F.col("source") == "target_list", "target_list").when(F.col("source") == "ms2", "annotated").when(F.col("source").isin("precursor", "predicted"), "predicted").when(F.col("ms2").isNull(), "no_ms2").otherwise("non_annotated")
    return r.join(with_ms2, "feature_id", "left").groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n_features"))


def candidate_lists(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by MS2 and by precursor side by side, also where a feature has one kind only."""
    ms2 = annotations(spark, d).where("feature_id is not null and compound_name is not null").groupBy("feature_id").agg(F.count_distinct("compound_name").alias("n_ms2"))
    pre = precursor_candidates(spark, d).groupBy("feature_id").agg(F.count_distinct("compound_id").alias("n_precursor"))
    zero = F.lit(0).cast("bigint")
    return ms2.join(pre, "feature_id", "full").select("feature_id", F.coalesce("n_ms2", zero).alias("n_ms2"), F.coalesce("n_precursor", zero).alias("n_precursor"))


def target_matches(spark: SparkSession, d: str) -> DataFrame:
    """Target ions per polarity matched to the nearest feature, or to be injected."""
    ions = library(spark, d).where("library_id = 2 and adduct in ('[M+H]+', '[M-H]-')").withColumn("target_id", F.concat_ws(":", "compound_id", "adduct"))
    hit = joins.nearest_ppm(ions, features(spark, d).where("mz is not null").select("mz", "feature_id"), ["target_id"], "ref_mz", "mz", 10.0, ["feature_id"])
    return hit.select("compound_id", "adduct", "feature_id", F.when(F.col("feature_id").isNull(), "injected").otherwise("existing").alias("match_type"))


def injected_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Unmatched target ions of either polarity closer than 10 ppm as one injected feature."""
    free = target_matches(spark, d).where("match_type = 'injected'").join(library(spark, d).where("library_id = 2"), ["compound_id", "adduct"]).select("ref_mz", F.concat_ws(":", "compound_id", "adduct").alias("sample_key"), F.lit(0).alias("idx"))
    return windows.align_across(free, "ref_mz", "sample_key", "idx", 10.0).select("feature_mz", "n_members")


def annotation_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Features with a best score of at least each cutoff, and the median lead of the best over the second compound."""
    best = annotations(spark, d).where("feature_id is not null and inchikey is not null").groupBy("feature_id", "inchikey").agg(F.max("score").alias("s"))
    top = windows.rank_in_group(best, ["feature_id"], [F.desc("s"), F.asc("inchikey")], "n").where("n <= 2").groupBy("feature_id").agg(F.max("s").alias("first"), F.min(F.when(F.col("n") == 2, F.col("s"))).alias("second"))
    cutoffs = F.explode(F.array(*[F.lit(x) for x in (0.2, 0.5, 0.8)])).alias("cutoff")
    lead = ranks.percentiles(top.select((F.col("first") - F.col("second")).alias("lead")), [], "lead", [0.5]).first()
    counts = top.select("*", cutoffs).groupBy("cutoff").agg(F.count_if(F.col("first") >= F.col("cutoff")).alias("n_features"))
    return counts.withColumn("median_lead", F.round(F.lit(lead["q"][0] if lead else None).cast("double"), 6))


def protected_features(spark: SparkSession, d: str) -> DataFrame:
    """Injected features and those with MS2: never isotopes."""
    return features(spark, d).where("origin = 'injected'").select("feature_id").union(associations(spark, d).where("feature_id is not null").select("feature_id")).distinct()


def features_without_isotopes(spark: SparkSession, d: str) -> DataFrame:
    """Features that stay once isotope candidates that are not protected are moved out."""
    iso = ms1_queries.isotope_candidates(spark, d).select(F.col("isotope_id").alias("feature_id")).distinct().join(protected_features(spark, d), "feature_id", "left_anti")
    stay, _ = move_rows(features(spark, d).select("feature_id", "mz"), iso, ["feature_id"])
    return stay


def features_updated(spark: SparkSession, d: str) -> DataFrame:
    """Features with the isotopes' rows put in their place where the number is the same."""
    iso = latest(table(spark, d, "feature_isotopes"), ["feature_id"], ["loaded_at"]).select("feature_id", "mz").withColumn("origin", F.lit("isotope"))
    return upsert(features(spark, d).select("feature_id", "mz", "origin"), iso, ["feature_id"])


def feature_search(spark: SparkSession, d: str) -> DataFrame:
    """Candidates found by part of a name, or features by an m/z range or the beginning of their m/z."""
    names = annotations(spark, d).select("feature_id", "compound_name").where(search.matches_name("Ol", F.col("compound_name")))
    f = features(spark, d).where(search.matches_mz("400-300", F.col("mz")) | search.matches_mz("50", F.col("mz"))).select("feature_id", "mz")
    return f.join(names.groupBy("feature_id").agg(F.count_distinct("compound_name").alias("n_names")), "feature_id", "left")


QUERIES = {f.__name__: f for f in (representative_annotation, scan_association, precursor_key_counts, parent_scan, scan_purity, unassociated_recheck, feature_ms2_summary, annotation_ranks, compound_scores, consensus_scan, consensus_by_purity, annotation_outcome, candidate_names, precursor_candidates, feature_categories, candidate_lists, target_matches, injected_clusters, annotation_funnel, protected_features, features_without_isotopes, features_updated, feature_search)}

_MASSES = ", ".join(f"('{e}', {m!r})" for e, m in chemistry.MASS.items())
_ADDUCTS = ", ".join(f"('{a}', {z}, {n}, {chemistry.adduct_delta(e, z)!r})" for a, _, z, n, e in chemistry.ADDUCTS)
_BASE = ms1_queries._BASE + f""", a AS (
  SELECT * REPLACE (CASE WHEN isnan(rt) THEN NULL ELSE rt END AS rt, CASE WHEN isnan(precursor_mz) THEN NULL ELSE precursor_mz END AS precursor_mz, CASE WHEN isnan(fragmentation_factor) THEN NULL ELSE fragmentation_factor END AS fragmentation_factor,
    CASE WHEN isnan(isolation_window_target) THEN NULL ELSE isolation_window_target END AS isolation_window_target,
    CASE WHEN lower(trim(polarity)) IN ('+', 'p', '1', '1+', '+1') OR lower(trim(polarity)) LIKE 'pos%' THEN 'POSITIVE' WHEN lower(trim(polarity)) IN ('-', 'n', '-1', '1-') OR lower(trim(polarity)) LIKE 'neg%' THEN 'NEGATIVE' END AS polarity)
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn FROM ms2_associations) WHERE rn = 1
), n AS (
  SELECT * REPLACE (nullif(upper(trim(inchikey)), '') AS inchikey) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn FROM ms2_annotations) WHERE rn = 1 AND score BETWEEN 0 AND 1
), masses(el, mass) AS (VALUES {_MASSES}), adds(adduct, charge, molecules, delta) AS (VALUES {_ADDUCTS}
), comp AS (
  SELECT library_id, compound_id, min(struct_pack(a := compound_name, b := compound_formula)) AS c FROM ms2_annotations WHERE compound_id IS NOT NULL GROUP BY ALL
), parts AS (
  SELECT library_id, compound_id, c.a AS compound_name, c.b AS compound_formula, unnest(regexp_extract_all(c.b, '[A-Z][a-z]?[0-9]*')) AS p FROM comp WHERE regexp_matches(c.b, '^([A-Z][a-z]?[0-9]*)+$')
), lib AS (
  SELECT library_id, compound_id, compound_name, compound_formula, adduct, (molecules * sum(mass * coalesce(TRY_CAST(regexp_extract(p, '[0-9]+$') AS INT), 1)) + delta) / abs(charge) AS ref_mz
  FROM parts JOIN masses ON el = regexp_extract(p, '^[A-Za-z]+'), adds GROUP BY library_id, compound_id, compound_name, compound_formula, adduct, molecules, delta, charge
), pcand AS (
  SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY abs_ppm, compound_id, adduct) AS rank FROM (
    SELECT feature_id, compound_id, compound_name, compound_formula, adduct, (mz - ref_mz) / ref_mz * 1e6 AS ppm, round(abs((mz - ref_mz) / ref_mz * 1e6), 6) AS abs_ppm
    FROM f JOIN lib ON library_id = 1 AND f.mz BETWEEN ref_mz - ref_mz * 5e-6 AND ref_mz + ref_mz * 5e-6)
), near AS (
  SELECT *, score >= max(score) OVER (PARTITION BY feature_id) - 0.05 AS nf, score >= max(score) OVER (PARTITION BY feature_id, sample_id) - 0.05 AS ns FROM n WHERE feature_id IS NOT NULL AND n_matched_peaks IS NOT NULL
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY nf DESC, n_matched_peaks DESC, score DESC, id) = 1 AS ff, row_number() OVER (PARTITION BY feature_id, sample_id ORDER BY ns DESC, n_matched_peaks DESC, score DESC, id) = 1 AS fs FROM near
), rep AS (
  SELECT f.feature_id, f.mz, coalesce(t_name, m.compound_name, p_name, f_name) AS compound_name, coalesce(t_formula, m.compound_formula, p_formula, f_formula) AS compound_formula, coalesce(t_key, m.inchikey) AS inchikey,
    CASE WHEN t.feature_id IS NOT NULL THEN 'target_list' WHEN m.feature_id IS NOT NULL THEN 'ms2' WHEN p.feature_id IS NOT NULL THEN 'precursor' WHEN q.feature_id IS NOT NULL THEN 'predicted' END AS source,
    m.score AS best_score, m.n_matched_peaks, precursor_ppm, coalesce(n_precursor_candidates, 0) AS n_precursor_candidates
  FROM f
  LEFT JOIN (SELECT n.feature_id, string_agg(DISTINCT compound_name, ',' ORDER BY compound_name) AS t_name, string_agg(DISTINCT compound_formula, ',' ORDER BY compound_formula) AS t_formula, string_agg(DISTINCT inchikey, ',' ORDER BY inchikey) AS t_key
    FROM n JOIN f ON f.feature_id = n.feature_id AND origin = 'injected' WHERE library_id = 2 AND n_matched_peaks IS NOT NULL GROUP BY ALL) t ON t.feature_id = f.feature_id
  LEFT JOIN (SELECT * FROM firsts WHERE ff) m ON m.feature_id = f.feature_id
  LEFT JOIN (SELECT feature_id, coalesce(compound_formula, compound_name) || coalesce(' + ' || adduct, '') || ' (' || n_same || CASE n_same WHEN 1 THEN ' candidate)' ELSE ' candidates)' END AS p_name, compound_formula AS p_formula, round(ppm, 4) AS precursor_ppm, n_precursor_candidates
    FROM (SELECT *, count(*) OVER (PARTITION BY feature_id, compound_formula, adduct) AS n_same, count(*) OVER (PARTITION BY feature_id) AS n_precursor_candidates FROM pcand) WHERE rank = 1) p ON p.feature_id = f.feature_id
  LEFT JOIN (SELECT feature_id, compound_formula AS f_formula, compound_formula || ' + ' || adduct AS f_name FROM (
      SELECT feature_id, compound_formula, adduct, row_number() OVER (PARTITION BY feature_id ORDER BY round(abs((mz - ref_mz) / ref_mz * 1e6), 6), compound_formula, adduct) AS rn
      FROM f JOIN lib ON library_id = 3 AND f.mz BETWEEN ref_mz - ref_mz * 25e-6 AND ref_mz + ref_mz * 25e-6) WHERE rn = 1) q ON q.feature_id = f.feature_id
)"""

_PURITY = """, sw AS (
  SELECT id, coalesce(isolation_window_target, precursor_mz) AS c, coalesce(precursor_mz, isolation_window_target) AS ref, mz, intensity FROM (
    SELECT l.id, l.precursor_mz, l.isolation_window_target, l.sample_id, r.scan_id FROM (SELECT * FROM a WHERE rt IS NOT NULL AND polarity IS NOT NULL) l
    ASOF JOIN (SELECT sample_id, polarity, rt, max(scan_id) AS scan_id FROM s WHERE rt IS NOT NULL AND polarity IS NOT NULL GROUP BY ALL) r ON l.sample_id = r.sample_id AND l.polarity = r.polarity AND l.rt >= r.rt) k JOIN s ON s.sample_id = k.sample_id AND s.scan_id = k.scan_id
), si AS (
  SELECT * FROM (SELECT id, c, ref, CAST(unnest(mz) AS DOUBLE) AS m, CAST(unnest(intensity) AS DOUBLE) AS i FROM sw) WHERE m BETWEEN c - 0.5 AND c + 0.5
), sb AS (SELECT id, quantile_cont(i, 0.1) AS base FROM si GROUP BY ALL
), ss AS (SELECT id, sum(greatest(0, i - base)) AS whole, sum(greatest(0, i - base)) FILTER (m BETWEEN greatest(c - 0.5, ref * (1 - 25e-6)) AND least(c + 0.5, ref * (1 + 25e-6))) AS own FROM si JOIN sb USING (id) GROUP BY ALL
), pu AS (SELECT sw.id, round(CASE WHEN whole > 0 THEN coalesce(own, 0) / whole ELSE 0 END, 6) AS purity_score FROM sw LEFT JOIN ss USING (id) WHERE ref IS NOT NULL)"""

ORACLE = {
    "scan_purity": _BASE + _PURITY + " SELECT id, purity_score FROM pu",
    "consensus_by_purity": _BASE + _PURITY + """, b AS (SELECT sample_id, scan_id, max(score) AS best FROM n GROUP BY ALL),
 k AS (SELECT a.*, best, least(1, n_peaks / 10.0) * greatest(0, least(1, coalesce(purity_score, 0.5))) * coalesce(best, 1) AS cs, coalesce(purity_score >= 0.2, true) AS ok, count(*) OVER (PARTITION BY feature_id) AS n_scans FROM a LEFT JOIN b USING (sample_id, scan_id) LEFT JOIN pu ON pu.id = a.id WHERE feature_id IS NOT NULL AND n_peaks IS NOT NULL),
 c AS (SELECT *, count(*) OVER (PARTITION BY feature_id) AS n_considered, row_number() OVER (PARTITION BY feature_id ORDER BY cs DESC, coalesce(best, -1) DESC, n_peaks DESC, sample_id, scan_id, id) AS rk FROM k WHERE ok)
 SELECT feature_id, id, round(cs, 10) AS consensus_score, n_scans, n_considered FROM c WHERE rk = 1""",
    "precursor_candidates": _BASE + """, tr AS (SELECT *, (SELECT count(*) FROM pcand q WHERE q.feature_id = p.feature_id AND q.rank <= p.rank AND NOT EXISTS (SELECT 1 FROM pcand o WHERE o.feature_id = q.feature_id AND o.rank < q.rank AND q.abs_ppm - o.abs_ppm <= 0.5)) AS loose FROM pcand p)
 SELECT feature_id, compound_id, compound_name, compound_formula, adduct, round(ppm, 4) AS ppm_error, CAST(rank AS INT) AS rank, CAST(loose AS INT) AS tie_rank FROM tr""",
    "representative_annotation": _BASE + " SELECT * FROM rep",
    "scan_association": _BASE + """, m AS (SELECT id, isolation_window_target AS t, coalesce(precursor_mz, isolation_window_target) AS m, CASE WHEN precursor_mz IS NOT NULL THEN 'precursor_mz' WHEN isolation_window_target IS NOT NULL THEN 'isolation_window_target' ELSE 'none' END AS matched_by FROM a),
 b AS (SELECT id, feature_id, mz, row_number() OVER (PARTITION BY id ORDER BY abs((m - mz) / mz), mz, feature_id) AS rn FROM m JOIN f ON m BETWEEN mz - mz * 1e-5 AND mz + mz * 1e-5 AND coalesce(abs(mz - t) <= 0.5, true))
 SELECT m.id, matched_by, feature_id, round((m - mz) / mz * 1e6, 3) AS ppm FROM m LEFT JOIN b ON b.id = m.id AND rn = 1""",
    "precursor_key_counts": _BASE + """, m AS (SELECT id, precursor_mz AS m FROM a WHERE precursor_mz IS NOT NULL), b AS (SELECT id, feature_id, row_number() OVER (PARTITION BY id ORDER BY abs((m - mz) / mz), mz, feature_id) AS rn FROM m JOIN f ON m BETWEEN mz - mz * 1e-5 AND mz + mz * 1e-5)
 SELECT coalesce(feature_id, CAST(-1 - floor(ln(m) / ln(1.00001)) AS BIGINT)) AS key, count(*) AS n_scans FROM m LEFT JOIN b ON b.id = m.id AND rn = 1 GROUP BY ALL""",
    "parent_scan": _BASE + """, l AS (SELECT id, sample_id, polarity, rt FROM a WHERE rt IS NOT NULL AND polarity IS NOT NULL), r AS (SELECT sample_id, polarity, rt, max(scan_id) AS scan_id FROM s WHERE rt IS NOT NULL AND polarity IS NOT NULL GROUP BY ALL)
 SELECT l.id, r.scan_id AS parent_scan_id FROM l ASOF LEFT JOIN r ON l.sample_id = r.sample_id AND l.polarity = r.polarity AND l.rt >= r.rt""",
    "unassociated_recheck": _BASE + """, u AS (SELECT id, sample_id, isolation_window_target AS t, coalesce(precursor_mz, isolation_window_target) AS m FROM a WHERE feature_id IS NULL)
 SELECT sample_id, count(*) AS n_unassociated, count(*) FILTER (EXISTS (SELECT 1 FROM f WHERE u.m BETWEEN f.mz - f.mz * 5e-5 AND f.mz + f.mz * 5e-5 AND coalesce(abs(f.mz - u.t) <= 0.5, true))) AS n_near_a_feature FROM u GROUP BY ALL""",
    "feature_ms2_summary": _BASE + " SELECT feature_id, count(*) AS n_scans, count(DISTINCT sample_id) AS n_samples, round(avg(fragmentation_factor), 9) AS mean_factor, count(*) FILTER (n_peaks <= 1) AS n_single_peak, count(*) FILTER (flat_fragmentation = 1) AS n_flat, CAST(median(n_peaks) AS DOUBLE) AS median_peaks FROM a WHERE feature_id IS NOT NULL GROUP BY ALL",
    "annotation_ranks": _BASE + """, b AS (SELECT feature_id, sample_id, scan_id, max(score) AS best FROM near GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY best DESC, sample_id, scan_id) AS scan_rank_feature FROM b)
 SELECT id, CAST(row_number() OVER (PARTITION BY x.sample_id, x.scan_id ORDER BY score DESC, id) AS INT) AS rank_in_scan, CAST(row_number() OVER (PARTITION BY x.feature_id ORDER BY ff DESC, score DESC, id) AS INT) AS rank_feature,
  CAST(row_number() OVER (PARTITION BY x.feature_id, x.sample_id ORDER BY fs DESC, score DESC, id) AS INT) AS rank_feature_sample, CAST(scan_rank_feature AS INT) AS scan_rank_feature
 FROM firsts x JOIN r ON r.feature_id = x.feature_id AND r.sample_id = x.sample_id AND r.scan_id = x.scan_id""",
    "compound_scores": _BASE + """ SELECT feature_id, inchikey, best_score, b.i AS best_id, b.c AS compound_name, b.f AS compound_formula, n_rows, n_scans FROM (
  SELECT feature_id, inchikey, max(score) AS best_score, arg_min(struct_pack(i := id, c := compound_name, f := compound_formula), struct_pack(s := -score, i := id)) AS b, count(*) AS n_rows, count(DISTINCT (sample_id, scan_id)) AS n_scans
  FROM n WHERE feature_id IS NOT NULL AND inchikey IS NOT NULL GROUP BY ALL)""",
    "consensus_scan": _BASE + """, b AS (SELECT sample_id, scan_id, max(score) AS best FROM n GROUP BY ALL),
 k AS (SELECT a.*, best, least(1, n_peaks / 10.0) * greatest(0, least(1, coalesce(fragmentation_factor, 0.5))) * coalesce(best, 1) AS cs, coalesce(fragmentation_factor >= 0.2, false) AS ok, count(*) OVER (PARTITION BY feature_id) AS n_scans FROM a LEFT JOIN b USING (sample_id, scan_id) WHERE feature_id IS NOT NULL AND n_peaks IS NOT NULL),
 c AS (SELECT *, count(*) OVER (PARTITION BY feature_id) AS n_considered, row_number() OVER (PARTITION BY feature_id ORDER BY cs DESC, coalesce(best, -1) DESC, n_peaks DESC, sample_id, scan_id, id) AS rk FROM k WHERE ok)
 SELECT feature_id, id, round(cs, 10) AS consensus_score, n_scans, n_considered FROM c WHERE rk = 1""",
    "annotation_outcome": _BASE + """, u AS (SELECT feature_id, count(*) AS n_scans, count(*) FILTER (coalesce(flat_fragmentation, 0) = 1) AS n_flat FROM a WHERE feature_id IS NOT NULL GROUP BY ALL), c AS (SELECT feature_id, count(*) AS nc, count(*) FILTER (n_matched_peaks > 0) AS nm FROM ms2_annotations WHERE feature_id IS NOT NULL GROUP BY ALL)
 SELECT u.feature_id, CASE WHEN n_flat = n_scans THEN 'all_scans_skipped' WHEN nm > 0 THEN 'annotated' WHEN nc > 0 THEN 'no_shared_fragments' ELSE 'no_candidates' END AS outcome FROM u LEFT JOIN c USING (feature_id)""",
    "candidate_names": _BASE + """, b AS (SELECT feature_id, compound_name, max(score) AS s FROM n WHERE feature_id IS NOT NULL AND compound_name IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY s DESC, compound_name) AS rk FROM b)
 SELECT feature_id, string_agg(compound_name, '; ' ORDER BY rk) AS names FROM r WHERE rk <= 5 GROUP BY ALL""",
    "feature_categories": _BASE + """ SELECT CASE WHEN source = 'target_list' THEN source WHEN source = 'ms2' THEN 'annotated' WHEN source IN ('precursor', 'predicted') THEN 'predicted' WHEN NOT EXISTS (SELECT 1 FROM a WHERE a.feature_id = rep.feature_id) THEN 'no_ms2' ELSE 'non_annotated' END AS category, count(*) AS n_features FROM rep GROUP BY 1""",
    "candidate_lists": _BASE + """, x AS (SELECT feature_id, count(DISTINCT compound_name) AS n_ms2 FROM n WHERE feature_id IS NOT NULL AND compound_name IS NOT NULL GROUP BY ALL), y AS (SELECT feature_id, count(DISTINCT compound_id) AS n_precursor FROM pcand GROUP BY ALL)
 SELECT coalesce(x.feature_id, y.feature_id) AS feature_id, coalesce(n_ms2, 0) AS n_ms2, coalesce(n_precursor, 0) AS n_precursor FROM x FULL JOIN y ON x.feature_id = y.feature_id""",
    "target_matches": _BASE + """, t AS (SELECT compound_id, adduct, ref_mz FROM lib WHERE library_id = 2 AND adduct IN ('[M+H]+', '[M-H]-')), b AS (SELECT compound_id, adduct, feature_id, row_number() OVER (PARTITION BY compound_id, adduct ORDER BY abs((ref_mz - mz) / mz), mz, feature_id) AS rn FROM t JOIN f ON ref_mz BETWEEN mz - mz * 1e-5 AND mz + mz * 1e-5)
 SELECT t.compound_id, t.adduct, feature_id, CASE WHEN feature_id IS NULL THEN 'injected' ELSE 'existing' END AS match_type FROM t LEFT JOIN b ON b.compound_id = t.compound_id AND b.adduct = t.adduct AND rn = 1""",
    "annotation_funnel": _BASE + """, b AS (SELECT feature_id, inchikey, max(score) AS s FROM n WHERE feature_id IS NOT NULL AND inchikey IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY s DESC, inchikey) AS rk FROM b),
 t AS (SELECT feature_id, max(s) AS first, min(s) FILTER (rk = 2) AS second FROM r WHERE rk <= 2 GROUP BY ALL), c AS (SELECT unnest([0.2, 0.5, 0.8]::DOUBLE[]) AS cutoff)
 SELECT cutoff, count(*) FILTER (first >= cutoff) AS n_features, round(median(first - second), 6) AS median_lead FROM t, c GROUP BY ALL""",
    "protected_features": _BASE + " SELECT feature_id FROM f WHERE origin = 'injected' UNION SELECT feature_id FROM a WHERE feature_id IS NOT NULL",
    "features_without_isotopes": _BASE + """, k AS (SELECT unnest([1, 2, 3]) AS k), z AS (SELECT unnest([1, 2]) AS z), m AS (SELECT feature_id AS mono_id, mz + k * 1.0033548 / z AS e FROM f, k, z)
 SELECT feature_id, mz FROM f WHERE NOT (EXISTS (SELECT 1 FROM m WHERE f.mz BETWEEN e - e * 25e-6 AND e + e * 25e-6 AND mono_id != f.feature_id) AND coalesce(origin, '') != 'injected' AND NOT EXISTS (SELECT 1 FROM a WHERE a.feature_id = f.feature_id))""",
    "features_updated": _BASE + """, i AS (SELECT feature_id, mz, 'isotope' AS origin FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY loaded_at DESC) AS rn FROM feature_isotopes) WHERE rn = 1)
 SELECT feature_id, mz, origin FROM f WHERE feature_id NOT IN (SELECT feature_id FROM i) UNION ALL SELECT * FROM i""",
    "feature_search": _BASE + """ SELECT feature_id, mz, n_names FROM f LEFT JOIN (SELECT feature_id, count(DISTINCT compound_name) AS n_names FROM n WHERE contains(lower(compound_name), 'ol') GROUP BY ALL) USING (feature_id) WHERE mz BETWEEN 300 AND 400 OR starts_with(printf('%.4f', mz), '50')""",
}
