"""The staged run: each stage writes a table from those before it, with the arguments that are logged for it.

A stage that was run before with the same arguments, and whose inputs have not
been made anew since, is skipped. Tables are those of ionloom.project.Project,
so a stage that fails leaves the table of the run before.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions import chemistry, spectral
from ionloom.operators import aggregates, annotate, cleaning, isotopes, joins, lifecycle, ranks, spatial, windows
from ionloom.plans import annotation_queries, ms2_queries, spatial_queries
from ionloom.plans.ms1_queries import mapped, scans
from ionloom.plans.ms2_queries import associations
from ionloom.project import Project
from ionloom.session import stored

CONFIG_VERSION = 1


def load_config(path: str) -> dict:
    """A JSON or TOML configuration of this version, with a section of arguments per stage; another version, stage or argument is refused."""
    if path.endswith(".toml"):
        import tomllib

        with open(path, "rb") as f:
            config = tomllib.load(f)
    else:
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
    if config.get("version") != CONFIG_VERSION:
        raise ValueError(f"configuration of version {config.get('version')}, not {CONFIG_VERSION}")
    known = {s.name: set(s.arguments) for s in STAGES}
    for name, arguments in config.get("stages", {}).items():
        if name not in known or not set(arguments) <= known[name]:
            raise ValueError(f"no such stage or argument: {name} {sorted(set(arguments) - known.get(name, set()))}")
    return config


@dataclass
class Context:
    """What a stage works with: the source tables and what earlier stages have written."""

    spark: SparkSession
    source: str
    project: Project

    def table(self, name: str) -> DataFrame:
        return self.project.read(name)


@dataclass
class Stage:
    name: str
    build: Callable[..., DataFrame]
    arguments: Mapping = field(default_factory=dict)
    inputs: Sequence[str] = ()


def process_samples(c: Context, bin_width: float, lo: float, hi: float, baseline_factor: float, prominence_factor: float, merge_ppm: float, filter_mad: bool, n_mads: float, height: float) -> DataFrame:
    """Peaks of each sample's averaged spectrum, filtered by MAD or by a fixed height."""
    average = aggregates.average_spectrum(scans(c.spark, c.source), mapped(c.spark, c.source), ["sample_id"], "scan_id", "pixel_id", lo, hi, bin_width)
    found = stored(windows.centroids(average, ["sample_id"], "bin", "mz", "intensity", bin_width, baseline_factor, prominence_factor, merge_ppm=merge_ppm))
    if not filter_mad:
        return found.where(F.col("intensity") >= height)
    limit = aggregates.mad_threshold(found, ["sample_id"], "intensity", n_mads)
    return found.join(limit, "sample_id").where(F.col("intensity") > F.col("threshold")).drop("threshold")


def align_mz(c: Context, ppm: float) -> DataFrame:
    """Features: peaks aligned over samples, with their number in each sample's list."""
    peaks = ranks.ranked(c.table("process_samples"), ["sample_id"], [F.asc("mz"), F.asc("intensity")], "idx").withColumn("idx", F.col("idx").cast("bigint"))
    found = windows.align_across(peaks, "mz", "sample_id", "idx", ppm)
    return ranks.ranked(found, [], [F.asc("feature_mz"), F.desc("n_members"), F.asc(F.to_json("members"))], "feature_id").select(F.col("feature_id").cast("bigint").alias("feature_id"), F.col("feature_mz").alias("mz"), "members", F.lit("aligned").alias("origin"))


def match_target_list(c: Context, ppm: float, adducts: Sequence[str]) -> DataFrame:
    """Target ions with the nearest feature, or none."""
    ions = ms2_queries.library(c.spark, c.source).where(F.col("library_id") == 2).where(F.col("adduct").isin(*adducts)).withColumn("_id", F.concat_ws(":", "compound_id", "adduct"))
    near = joins.nearest_ppm(ions, c.table("align_mz").select("feature_id", F.col("mz").alias("fmz")), ["_id"], "ref_mz", "fmz", ppm, ["feature_id"])
    return near.select("compound_id", "compound_name", "adduct", "ref_mz", "feature_id", F.col("matched_mz").alias("feature_mz"), spectral.ppm_between(F.col("matched_mz"), F.col("ref_mz")).alias("ppm_diff"), F.when(F.col("feature_id").isNull(), "injected").otherwise("existing").alias("match_type"))


def features(c: Context, ppm: float) -> DataFrame:
    """Aligned features and those injected for targets found nowhere, close targets as one."""
    aligned = c.table("align_mz")
    free = c.table("match_target_list").where("match_type = 'injected'").select("ref_mz", F.concat_ws(":", "compound_id", "adduct").alias("key"), F.lit(0).alias("idx"))
    last = aligned.agg(F.max("feature_id")).first()[0] or 0
    new = ranks.ranked(windows.align_across(free, "ref_mz", "key", "idx", ppm).select("feature_mz").distinct(), [], [F.asc("feature_mz")], "n")
    return aligned.select("feature_id", "mz", "members", "origin").unionByName(new.select((F.col("n") + last).cast("bigint").alias("feature_id"), F.col("feature_mz").alias("mz"), F.lit(None).cast("map<bigint,bigint>").alias("members"), F.lit("injected").alias("origin")))


def assemble_matrix(c: Context, ppm: float) -> DataFrame:
    """Mean intensity of each feature on each pixel."""
    values = aggregates.quantify(scans(c.spark, c.source), c.table("features"), ["sample_id"], "scan_id", "feature_id", "mz", ppm)
    return aggregates.pixel_matrix(values, mapped(c.spark, c.source), ["sample_id"], "scan_id", "pixel_id", "feature_id")


def detect_isotopes(c: Context, ppm: float, max_isotopes: int, max_charge: int, min_corr: float) -> DataFrame:
    """Isotopes accepted by the votes of samples; injected features and those of targets are protected."""
    m, f = c.table("assemble_matrix"), c.table("features")
    n = mapped(c.spark, c.source).groupBy("sample_id").agg(F.count_distinct("pixel_id").alias("n"))
    links = stored(isotopes.link_isotopes(f, m, n, "sample_id", "pixel_id", "feature_id", "mz", "value", ppm, max_isotopes, max_charge, min_corr))
    protected = f.where("origin = 'injected'").select("feature_id").unionByName(c.table("match_target_list").where("feature_id is not null").select("feature_id")).distinct()
    return aggregates.isotope_vote(links, m.select("sample_id", "feature_id").distinct(), protected, "sample_id", max_isotopes)


def kept_features(c: Context) -> DataFrame:
    """Features without the accepted isotopes: what all later stages work with."""
    stay, _ = lifecycle.move_rows(c.table("features"), c.table("detect_isotopes").select(F.col("isotope_id").alias("feature_id")), ["feature_id"])
    return stay


def kept_matrix(c: Context) -> DataFrame:
    return c.table("assemble_matrix").join(c.table("kept_features").select("feature_id"), "feature_id", "left_semi")


def group_ms2(c: Context, ppm: float, half_window: float) -> DataFrame:
    """Each MS2 scan with the kept feature nearest to its precursor, if it lies in the isolation window."""
    a = associations(c.spark, c.source).select("id", "sample_id", "scan_id", "rt", "polarity", "n_peaks", "precursor_mz", "isolation_window_target", "flat_fragmentation", "fragmentation_factor").withColumn("_m", F.coalesce("precursor_mz", "isolation_window_target"))
    pairs = joins.ppm_join(a.where("_m is not null").select("id", "_m", "isolation_window_target"), c.table("kept_features").select("feature_id", F.col("mz").alias("fmz")), "_m", "fmz", ppm)
    inside = pairs.where(F.coalesce(F.abs(F.col("fmz") - F.col("isolation_window_target")) <= half_window, F.lit(True)))
    best = inside.groupBy("id").agg(F.min_by("feature_id", F.struct(F.abs((F.col("_m") - F.col("fmz")) / F.col("fmz")), "fmz", "feature_id")).alias("feature_id"))
    return a.drop("_m").join(best, "id", "left")


def ms2_spectra(c: Context) -> DataFrame:
    """One row per MS2 scan with its feature and peaks; see annotation_queries for what stands in for MS2 peaks."""
    peaks = annotation_queries.ms2_spectra(c.spark, c.source).select("id", "peaks")
    rows = c.table("group_ms2").select("id", "sample_id", "scan_id", "feature_id", "polarity", "precursor_mz", (F.col("flat_fragmentation") == 1).alias("is_flat")).join(peaks, "id")
    return lifecycle.latest(rows, ["sample_id", "scan_id"], ["id"])


def ms2_cleaning(c: Context, ppm: float, min_percent: float) -> DataFrame:
    """Fragments that recur whatever the precursor feature."""
    peaks = c.table("ms2_spectra").where("polarity is not null and precursor_mz is not null").select("polarity", F.coalesce("feature_id", -1 - spectral.log_bin(F.col("precursor_mz"), ppm)).alias("key"), F.explode("peaks").alias("x")).select("polarity", "key", "x.m")
    return cleaning.removed_background(windows.background(peaks, "m", "polarity", "key", ppm), min_percent)


def precursor_purity(c: Context) -> DataFrame:
    return annotation_queries.purity_table(c.spark, c.source)


def annotate_ms2(c: Context, candidate_ppm: float, fragment_ppm: float, noise_threshold: float, mz_power: float, int_power: float, score_weight_dot: float, score_weight_lib_coverage: float, score_weight_emp_coverage: float, min_matched_peaks: int, min_purity_score: float | None) -> DataFrame:
    """Scored library candidates of each usable scan."""
    purity = c.table("precursor_purity").select("id", F.col("purity_score").alias("purity"))
    spectra = c.table("ms2_spectra").join(purity, "id", "left")
    library = stored(annotation_queries.library_spectra(c.spark, c.source, spectra))
    used = annotate.usable(spectra, min_purity_score)
    found = annotate.candidates(used, c.table("kept_features"), library, candidate_ppm)
    rows = annotate.scored(used, found, library, fragment_ppm, noise_threshold, mz_power, int_power, (score_weight_dot, score_weight_lib_coverage, score_weight_emp_coverage))
    return annotate.ranked_rows(rows, min_matched_peaks)


def annotate_precursor(c: Context, ppm: float) -> DataFrame:
    """Library ions near each kept feature, nearest first."""
    pairs = joins.ppm_join(c.table("kept_features").select("feature_id", "mz"), ms2_queries.library(c.spark, c.source).where("library_id = 1"), "mz", "ref_mz", ppm)
    pairs = pairs.withColumn("ppm_error", spectral.ppm_between(F.col("mz"), F.col("ref_mz")))
    return windows.rank_in_group(pairs, ["feature_id"], [F.asc(F.abs("ppm_error")), F.asc("compound_id"), F.asc("adduct")], "rank")


def ms2_consensus(c: Context, target_peaks: float, neutral: float, min_purity: float) -> DataFrame:
    """The scan that represents each feature."""
    best = c.table("annotate_ms2").groupBy("sample_id", "scan_id").agg(F.max("score").alias("best_score"))
    s = c.table("group_ms2").where("feature_id is not null and n_peaks is not null").join(best, ["sample_id", "scan_id"], "left").join(c.table("precursor_purity").select("id", "purity_score"), "id", "left")
    return windows.consensus(s, ["feature_id"], "n_peaks", "purity_score", "best_score", ["sample_id", "scan_id", "id"], target_peaks, neutral, min_purity, keep_unknown=True).drop("rt")


def normalise(c: Context, mode: str, reference_mz: float | None, reference_ppm: float) -> DataFrame:
    """log1p(value * median / reference) per pixel, by total ion current or by a reference ion; the median over all pixels of all samples."""
    s = scans(c.spark, c.source)
    pixels = mapped(c.spark, c.source)
    if mode == "tic":
        own = s.select("sample_id", "scan_id", "tic")
    elif mode == "reference_mz" and reference_mz:
        target = c.spark.createDataFrame([(0, float(reference_mz))], "feature_id int, mz double")
        own = s.select("sample_id", "scan_id").join(aggregates.quantify(s, target, ["sample_id"], "scan_id", "feature_id", "mz", reference_ppm), ["sample_id", "scan_id"], "left").select("sample_id", "scan_id", F.coalesce("value", F.lit(0.0)).alias("tic"))
    else:
        raise ValueError("mode is tic, or reference_mz with a reference_mz")
    reference = pixels.join(own, ["sample_id", "scan_id"]).groupBy("sample_id", "pixel_id").agg(F.avg("tic").alias("_ref"))
    middle = ranks.percentiles(reference, [], "_ref", [0.5]).first()
    median = float(middle["q"][0]) if middle else 0.0
    rows = c.table("kept_matrix").join(reference.where("_ref > 0 and not isnan(_ref)"), ["sample_id", "pixel_id"])
    return rows.select("sample_id", "pixel_id", "feature_id", F.log1p(F.col("value") * median / F.col("_ref")).alias("value"))


def grid(c: Context) -> DataFrame:
    return spatial_queries.grid_indices(c.spark, c.source)


def fill_blanks(c: Context, radius: int, fraction: float) -> DataFrame:
    """The normalised layer with blank pixels filled."""
    edges = spatial.neighbours(c.table("grid"), ["sample_id"], "pixel_id", radius=radius)
    m = c.table("normalise").join(c.table("grid").select("sample_id", "pixel_id"), ["sample_id", "pixel_id"], "left_semi")
    return spatial.fill_blanks(m, edges, ["sample_id"], "pixel_id", ["feature_id"], "value", fraction)


def spatial_correlation(c: Context) -> DataFrame:
    """Per sample and feature Moran's I of the filled layer and, per threshold of local I, how many pixels exceed it."""
    edges = stored(spatial.neighbours(c.table("grid"), ["sample_id"], "pixel_id", rook=True))
    touched, images = spatial.image_moran(c.table("fill_blanks"), c.table("grid"), edges, ["sample_id"], "pixel_id", "feature_id", "value")
    rows = touched.select("sample_id", "feature_id", "local_i", F.lit(1).cast("bigint").alias("n")).unionByName(images.where("n_rest > 0").select("sample_id", "feature_id", F.col("rest_i").alias("local_i"), F.col("n_rest").alias("n")))
    above = spatial.above_thresholds(rows, ["sample_id", "feature_id"], "local_i", weight="n").groupBy("sample_id", "feature_id").agg(F.array_sort(F.collect_list(F.struct("threshold_index", "n_above", "n_finite"))).alias("above"))
    return spatial.image_global(touched, images, ["sample_id"], "feature_id").join(above, ["sample_id", "feature_id"], "left")


def feature_correlation(c: Context, min_abs: float, rank: bool) -> DataFrame:
    """Pairs of features that are found together, or shun each other, on a sample's pixels."""
    n = mapped(c.spark, c.source).groupBy("sample_id").agg(F.count_distinct("pixel_id").alias("n"))
    return aggregates.correlation_pairs(c.table("normalise"), n, ["sample_id"], "pixel_id", "feature_id", "value", rank, min_abs=min_abs)


def summary_report(c: Context) -> DataFrame:
    """One row of JSON: how many rows each stage gave, features by origin, MS2 scans with a feature, outcomes of the vote."""
    counts = {s.name: c.table(s.name).count() for s in STAGES if s.name != "summary_report" and c.project.has(s.name)}
    origin = {r["origin"]: r["count"] for r in c.table("kept_features").groupBy("origin").count().collect()}
    ms2 = c.table("group_ms2").agg(F.count(F.lit(1)).alias("n"), F.count("feature_id").alias("associated")).first()
    text = json.dumps({"rows": counts, "features": origin, "ms2_scans": ms2["n"], "ms2_associated": ms2["associated"]}, sort_keys=True)
    return c.spark.createDataFrame([(text,)], "report string")


ADDUCTS = [a for a, *_ in chemistry.ADDUCTS if a in ("[M+H]+", "[M-H]-")]
#: The order of a full run.
STAGES = [
    Stage("process_samples", process_samples, {"bin_width": 0.001, "lo": 70.0, "hi": 1000.0, "baseline_factor": 100.0, "prominence_factor": 0.1, "merge_ppm": 5.0, "filter_mad": True, "n_mads": 2.5, "height": 0.0}),
    Stage("align_mz", align_mz, {"ppm": 5.0}, ["process_samples"]),
    Stage("match_target_list", match_target_list, {"ppm": 10.0, "adducts": ADDUCTS}, ["align_mz"]),
    Stage("features", features, {"ppm": 10.0}, ["align_mz", "match_target_list"]),
    Stage("assemble_matrix", assemble_matrix, {"ppm": 5.0}, ["features"]),
    Stage("detect_isotopes", detect_isotopes, {"ppm": 5.0, "max_isotopes": 3, "max_charge": 1, "min_corr": 0.5}, ["assemble_matrix", "features", "match_target_list"]),
    Stage("kept_features", kept_features, {}, ["features", "detect_isotopes"]),
    Stage("kept_matrix", kept_matrix, {}, ["assemble_matrix", "kept_features"]),
    Stage("group_ms2", group_ms2, {"ppm": 10.0, "half_window": 0.5}, ["kept_features"]),
    Stage("ms2_spectra", ms2_spectra, {}, ["group_ms2"]),
    Stage("ms2_cleaning", ms2_cleaning, {"ppm": 10.0, "min_percent": 50.0}, ["ms2_spectra"]),
    Stage("precursor_purity", precursor_purity, {}),
    Stage("annotate_ms2", annotate_ms2, {"candidate_ppm": 10.0, "fragment_ppm": 10.0, "noise_threshold": 0.01, "mz_power": 2.0, "int_power": 0.5, "score_weight_dot": 1.0, "score_weight_lib_coverage": 0.5, "score_weight_emp_coverage": 0.5, "min_matched_peaks": 1, "min_purity_score": None}, ["ms2_spectra", "precursor_purity", "kept_features"]),
    Stage("annotate_precursor", annotate_precursor, {"ppm": 5.0}, ["kept_features"]),
    Stage("ms2_consensus", ms2_consensus, {"target_peaks": 10.0, "neutral": 0.5, "min_purity": 0.2}, ["group_ms2", "annotate_ms2", "precursor_purity"]),
    Stage("normalise", normalise, {"mode": "tic", "reference_mz": None, "reference_ppm": 5.0}, ["kept_matrix"]),
    Stage("grid", grid, {}),
    Stage("fill_blanks", fill_blanks, {"radius": 1, "fraction": 0.6}, ["normalise", "grid"]),
    Stage("spatial_correlation", spatial_correlation, {}, ["fill_blanks", "grid"]),
    Stage("feature_correlation", feature_correlation, {"min_abs": 0.5, "rank": False}, ["normalise"]),
    Stage("summary_report", summary_report, {}, ["kept_features", "group_ms2", "feature_correlation", "spatial_correlation", "ms2_consensus"]),
]
#: Stages that are run again when MS2 annotation is.
MS2_STAGES = ("group_ms2", "ms2_spectra", "ms2_cleaning", "precursor_purity", "annotate_ms2", "annotate_precursor", "ms2_consensus")


def _arguments(stage: Stage, config: Mapping | None) -> dict:
    return {**stage.arguments, **((config or {}).get("stages", {}).get(stage.name, {}))}


def run(spark: SparkSession, source: str, out: str, run_id: str, stages: list[Stage] | None = None, config: Mapping | None = None, skip_done: bool = True, on_step: Callable[[str, str], None] = lambda name, status: None) -> list[str]:
    """Runs the stages in order; each result is a table of the project under out. Gives the names of those that ran.

    config: arguments that take the place of a stage's own, as load_config reads them.
    """
    project = Project.create(spark, out)
    context = Context(spark, source, project)
    ran: list[str] = []
    for stage in STAGES if stages is None else stages:
        arguments = _arguments(stage, config)
        said = json.dumps(arguments, sort_keys=True)
        done = project.read("commands").where((F.col("command_name") == stage.name) & (F.col("run_id") == run_id)).orderBy(F.desc("executed_at"), "command_id").first() if skip_done else None
        if done is not None and done["arguments"] == said and project.has(stage.name) and not set(stage.inputs) & set(ran):
            on_step(stage.name, "skipped")
            continue
        on_step(stage.name, "started")
        project.write(stage.name, stage.build(context, **arguments), as_is=True)
        project.log(stage.name, run_id, arguments)
        on_step(stage.name, "done")
        ran.append(stage.name)
    return ran


def reannotate(spark: SparkSession, source: str, out: str, run_id: str, settings: Mapping | None = None, stages: list[Stage] | None = None) -> str:
    """Runs the MS2 stages anew with other arguments (settings: see load_config) and keeps the tables before as an entry of the history, to which Project.restore goes back. If a stage fails all tables are as before. Gives the new entry."""
    project = Project.create(spark, out)
    chosen = [s for s in STAGES if s.name in MS2_STAGES] if stages is None else stages
    names = [s.name for s in chosen]
    if project.read("annotation_history").isEmpty():
        project.record(names, {})
    before = {n: project.version(n) for n in names}
    try:
        run(spark, source, out, run_id, chosen, settings, skip_done=False)
    except Exception:
        for name, version in before.items():
            project.point(name, version)
        raise
    return project.record(names, settings or {})
