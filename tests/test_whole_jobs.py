"""Queries over small made-up tables, against results worked out by hand or brute force."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from ionloom.operators import spatial
from ionloom.plans import ms1_queries, ms2_queries, pipeline, spatial_queries
from ionloom.project import Project

AT = dt.datetime(2024, 1, 1)
D = 1.0033548


def _write(spark, d, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame([(*r, AT) for r in rows], schema + ", loaded_at timestamp").coalesce(1).write.parquet(f"{d}/{name}.parquet")


SCANS = "sample_id long, scan_id long, rt double, n_peaks int, tic double, polarity string, mz array<float>, intensity array<float>"
FEATURES = "feature_id long, mz double, members map<string,int>, origin string, mz_weighted double, mz_spread_ppm double"
ASSOCIATIONS = "id long, sample_id long, scan_id long, feature_id long, match_key string, precursor_mz double, isolation_window_target double, ppm_offset double, rt double, collision_energy double, n_peaks int, polarity string, fragmentation_factor double, flat_fragmentation int"


@pytest.fixture(scope="module")
def isotope_dir(spark, tmp_path_factory):
    """Two samples of six pixels. 1 has the isotopes 2 and 3; 5 is at the distance from 4 but elsewhere on the slide; 7 is too strong for M+1 of 6; 9 is the isotope of 8 but has MS2; 11 is 15 ppm off."""
    d = str(tmp_path_factory.mktemp("isotopes"))
    up, down = np.arange(1.0, 7.0), np.arange(6.0, 0.0, -1.0)
    f = {1: (300.0, 100 * up), 2: (300.0 + D, 15 * up), 3: (300.0 + 2 * D, 2 * up), 4: (400.0, 100 * up), 5: (400.0 + D, 15 * down), 6: (500.0, 100 * up), 7: (500.0 + D, 80 * up), 8: (600.0, 100 * up), 9: (600.0 + D, 15 * up), 10: (700.0, 100 * up), 11: ((700.0 + D) * (1 + 15e-6), 15 * up)}
    scans = [(s, p, float(p), len(f), 1.0, "+", [float(m) for m, _ in f.values()], [float(v[p]) for _, v in f.values()]) for s in (1, 2) for p in range(6)]
    members = {"slide_00001_pos": 1, "slide_00002_pos": 1}
    _write(
        spark, d,
        ms1_scans=(scans, SCANS),
        pixel_ms1_scans=([(s, p, p) for s in (1, 2) for p in range(6)], "sample_id long, pixel_id long, scan_id long"),
        features=([(k, m, members, "aligned", m, 1.0) for k, (m, _) in f.items()], FEATURES),
        ms2_associations=([(1, 1, 100, 9, "9", f[9][0], f[9][0], 0.0, 1.0, 20.0, 9, "+", 0.5, 0)], ASSOCIATIONS),
    )
    return d


def test_isotope_votes_come_from_the_images(spark, isotope_dir):
    got = {(r["mono_id"], r["isotope_id"]): r for r in spatial_queries.isotope_votes(spark, isotope_dir).collect()}
    assert set(got) == {(1, 2), (1, 3)}
    assert [(got[k]["k"], got[k]["n_samples_linked"], got[k]["n_samples_both"]) for k in sorted(got)] == [(1, 2, 2), (2, 2, 2)]
    assert [got[k]["intensity_ratio"] for k in sorted(got)] == pytest.approx([0.15, 0.02]) and [got[k]["spatial_corr"] for k in sorted(got)] == pytest.approx([1.0, 1.0])
    assert ms1_queries.isotope_candidates(spark, isotope_dir).where("isotope_id in (5, 7, 9, 11)").select("isotope_id").distinct().count() == 4


def test_images_of_all_features_against_dense_ones(spark):
    """Image 1 varies, 2 has one value, 3 is constant; pixel 99 has no neighbour."""
    g = np.random.default_rng(5)
    at = {p: (p % 6, p // 6) for p in range(30)} | {99: (20, 20)}
    v = {(1, p): float(x) for p, x in zip(at, np.where(g.random(31) < 0.5, 0, g.integers(1, 9, 31)), strict=True)} | {(2, p): 4.0 * (p == 8) for p in at} | {(3, p): 0.1 for p in at}
    pixels = spark.createDataFrame([("s", p, *xy) for p, xy in at.items()], "s string, p int, gx int, gy int")
    dense = spark.createDataFrame([("s", p, f, x) for (f, p), x in v.items()], "s string, p int, f int, v double")
    edges = spatial.neighbours(pixels, ["s"], "p", rook=True)
    touched, images = spatial.image_moran(dense.where("v > 0"), pixels, edges, ["s"], "p", "f", "v")
    local = {(r["f"], r["p"]): r["local_i"] for r in spatial.image_local(touched, images, pixels, edges, ["s"], "p", "f").collect()}
    want = {(r["f"], r["p"]): r["local_i"] for r in spatial.local_moran(dense, edges, ["s"], "p", "v", ["f"]).collect()}
    assert set(local) == set(want) == set(v)
    assert all((local[k] is None) == (want[k] is None) and local[k] == pytest.approx(want[k], abs=1e-12) for k in v if k[0] != 3) and all(local[3, p] is None for p in at)
    got = {r["f"]: (r["moran_i"], r["n_pixels"]) for r in spatial.image_global(touched, images, ["s"], "f").collect()}
    whole = {r["f"]: r["moran_i"] for r in spatial.global_moran(dense, edges, ["s"], "p", "v", ["f"]).collect()}
    assert got[1] == (pytest.approx(whole[1]), 31) and got[2] == (pytest.approx(whole[2]), 31) and got[3] == (None, 31)


def test_stages_work_on_each_feature(spark, tmp_path):
    """Feature 1 has a hole in the middle of a 3 x 3 grid, feature 2 one in a corner; each is filled by itself."""
    d = str(tmp_path)
    a, b = 300.0, 500.0
    scans = [(1, p, float(p), 2, 1.0, "+", [a, b], [0.0 if p == 4 else 10.0 + p, 0.0 if p == 0 else 50.0]) for p in range(9)]
    _write(
        spark, d,
        ms1_scans=(scans, SCANS),
        pixel_ms1_scans=([(1, p, p) for p in range(9)], "sample_id long, pixel_id long, scan_id long"),
        spatial_pixels=([(1, p, p % 3, p // 3, float(p), p + 0.5) for p in range(9)], "sample_id long, pixel_id long, x int, y int, t_start double, t_end double"),
        features=([(1, a, None, "aligned", a, 1.0), (2, b, None, "aligned", b, 1.0)], FEATURES),
    )
    filled = {(r["feature_id"], r["pixel_id"]): r["value"] for r in spatial_queries.feature_fill_blanks(spark, d).collect()}
    assert filled == {(1, 4): pytest.approx(np.mean([10.0 + p for p in range(9) if p != 4])), (2, 0): 50.0}
    assert {(r["feature_id"], r["pixel_id"]) for r in spatial_queries.feature_local_moran(spark, d).collect()} == {(f, p) for f in (1, 2) for p in range(9)}
    top = {(r["feature_id"], r["threshold_index"]): (r["n_above"], r["n_finite"]) for r in spatial_queries.feature_moran_thresholds(spark, d).collect()}
    assert top[1, 0][1] == top[2, 0][1] == 9 and len(top) == 242


def test_only_accepted_isotopes_are_moved_out(spark, isotope_dir):
    kept = {r["feature_id"] for r in spatial_queries.features_after_isotopes(spark, isotope_dir).collect()}
    assert kept == set(range(1, 12)) - {2, 3}


def test_consensus_goes_by_purity(spark, tmp_path):
    """Scan 1 has the better factor, scan 2 the purer precursor; feature 2's only scan has no parent and no factor."""
    d = str(tmp_path)
    row = lambda i, f, rt, factor: (i, 1, i, f, str(f), 300.0, 300.0, 0.0, rt, 20.0, 10, "+", factor, 0)
    _write(
        spark, d,
        ms1_scans=([(1, 1, 1.0, 3, 1.0, "+", [300.0, 300.2, 299.8], [20.0, 10.0, 100.0]), (1, 2, 3.0, 3, 1.0, "+", [300.0, 300.2, 299.8], [100.0, 10.0, 40.0])], SCANS),
        ms2_associations=([row(1, 1, 2.0, 0.9), row(2, 1, 4.0, 0.1), row(3, 2, None, None)], ASSOCIATIONS),
        features=([(1, 300.0, None, "aligned", 300.0, 1.0)], FEATURES),
        ms2_annotations=([(1, 9, 9, 9, 0.5, "K")], "id long, sample_id long, scan_id long, feature_id long, score double, inchikey string"),
    )
    got = {r["feature_id"]: (r["id"], r["consensus_score"], r["n_scans"], r["n_considered"]) for r in ms2_queries.consensus_by_purity(spark, d).collect()}
    # Baselines (10th percentile) of 12 and 16: purities 8 / 96 and 84 / 108.
    assert got == {1: (2, pytest.approx(84 / 108, abs=1e-5), 2, 1), 2: (3, 0.5, 1, 1)}


def test_a_whole_run_on_the_isotopes(spark, isotope_dir, tmp_path):
    """From scans to the report: what the isotope stage takes out is gone from all that follows."""
    d, out = isotope_dir, str(tmp_path / "run")
    _write(
        spark, d,
        spatial_pixels=([(s, p, p % 3, p // 3, float(p), p + 0.5) for s in (1, 2) for p in range(6)], "sample_id long, pixel_id long, x int, y int, t_start double, t_end double"),
        ms2_annotations=([(1, 1, 100, 9, 2, 5, 77, "target", "C20H20O3", "K", "[M+H]+", 0.9, 3)], "id long, sample_id long, scan_id long, feature_id long, library_id int, library_spectrum_id long, compound_id long, compound_name string, compound_formula string, inchikey string, adduct string, score double, n_matched_peaks int"),
    )
    seen = []
    config = {"stages": {"process_samples": {"baseline_factor": -1.0, "prominence_factor": 0.0, "filter_mad": False}, "normalise": {"mode": "reference_mz", "reference_mz": 700.0}}}
    ran = pipeline.run(spark, d, out, "r1", config=config, on_step=lambda name, status: seen.append((name, status)))
    assert ran == [s.name for s in pipeline.STAGES] and ("align_mz", "done") in seen
    t = Project(spark, out).read
    mz = {r["feature_id"]: round(r["mz"], 2) for r in t("features").collect()}
    assert {300.0, 301.0, 302.01, 400.0, 700.0} <= set(mz.values())
    gone = {mz[r["isotope_id"]] for r in t("detect_isotopes").collect()}
    assert {301.0, 302.01} <= gone and not gone & {mz[r["feature_id"]] for r in t("kept_features").collect()} and not gone & {mz[r["feature_id"]] for r in t("normalise").select("feature_id").distinct().collect()}
    assert t("match_target_list").count() == 2 and t("group_ms2").count() == 1 and t("summary_report").count() == 1
    # Feature 700 is its own reference: the same everywhere.
    ref = next(k for k, v in mz.items() if v == 700.0)
    assert len({round(r["value"], 9) for r in t("normalise").where(f"feature_id = {ref}").collect()}) == 1
    assert pipeline.run(spark, d, out, "r1", config=config) == []
    again = pipeline.run(spark, d, out, "r1", config={"stages": {**config["stages"], "fill_blanks": {"radius": 2}}})
    assert again == ["fill_blanks", "spatial_correlation", "summary_report"]
