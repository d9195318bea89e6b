"""Annotation and formula prediction against results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from ionloom.functions import spectral
from ionloom.operators import annotate, formulas

PEAKS = "array<struct<m:double,i:double>>"
SCANS = f"sample_id int, scan_id int, feature_id int, polarity string, is_flat boolean, purity double, peaks {PEAKS}"
LIBRARY = f"library_id int, spectrum_id int, ref_mz double, polarity string, peaks {PEAKS}"


@pytest.fixture(scope="module")
def case(spark):
    p = [(100.0, 50.0), (150.0, 100.0), (200.0, 20.0)]
    scans = [
        (1, 1, 7, "POSITIVE", False, 0.9, p), (1, 2, 7, "POSITIVE", False, 0.1, p[:1]), (1, 3, 7, "POSITIVE", True, 0.9, p), (1, 4, 7, None, False, None, p[1:]),
        (1, 5, 8, "NEGATIVE", True, 0.9, p), (1, 6, 9, "NEGATIVE", False, 0.9, [(77.0, 1.0)]), (1, 7, 10, "POSITIVE", False, 0.9, p), (1, 8, None, "POSITIVE", False, 0.9, p), (1, 9, 7, "POSITIVE", None, None, None),
    ]
    library = [(1, 1, 300.0, "POSITIVE", p), (1, 2, 300.002, None, p[:2]), (2, 1, 300.0, "NEGATIVE", p), (2, 2, 300.004, "POSITIVE", p), (2, 3, 500.0, "NEGATIVE", p), (2, 4, 300.0, "POSITIVE", [])]
    features = [(7, 300.0), (8, 400.0), (9, 500.0), (10, 600.0), (11, None)]
    return spark.createDataFrame(scans, SCANS), spark.createDataFrame(library, LIBRARY), spark.createDataFrame(features, "feature_id int, mz double")


def test_candidates_by_distance_and_polarity(case):
    scans, library, features = case
    got = {(r["feature_id"], r["_pol"], r["library_id"], r["spectrum_id"]) for r in annotate.candidates(annotate.usable(scans), features, library).collect()}
    # 300.002 is 6.7 ppm off, 300.004 more than 10; a scan of unknown polarity goes with all.
    assert got == {(7, "POSITIVE", 1, 1), (7, "POSITIVE", 1, 2), (7, "POSITIVE", 2, 4), *((7, "", lib, s) for lib, s in ((1, 1), (1, 2), (2, 1), (2, 4))), (9, "NEGATIVE", 2, 3)}


def test_rows_and_outcomes(case):
    scans, library, features = case
    used = annotate.usable(scans)
    found = annotate.candidates(used, features, library)
    rows = annotate.scored(used, found, library)
    got = {(r["scan_id"], r["library_id"], r["spectrum_id"]): r for r in annotate.ranked_rows(rows).collect()}
    assert set(got) == {(1, 1, 1), (1, 1, 2), (2, 1, 1), (2, 1, 2), (4, 1, 1), (4, 1, 2), (4, 2, 1)}
    assert got[1, 1, 1]["score"] == pytest.approx(1) and got[1, 1, 1]["rank_ms2"] == 1 and got[1, 1, 1]["n_matched_peaks"] == 3
    # Two of the query's three peaks have a partner.
    assert got[1, 1, 2]["score"] == pytest.approx((2 / 3) ** 0.5) and got[1, 1, 2]["rank_ms2"] == 2
    assert sorted(got[4, *k]["rank_ms2"] for k in ((1, 1), (1, 2), (2, 1))) == [1, 2, 3]
    assert {r["scan_id"] for r in annotate.ranked_rows(rows, 3).collect()} == {1}
    end = {r["feature_id"]: r for r in annotate.outcomes(scans, found, rows).collect()}
    assert {k: r["outcome"] for k, r in end.items()} == {7: "annotated", 8: "all_scans_skipped", 9: "no_shared_fragments", 10: "no_candidates"}
    assert (end[7]["n_scans"], end[7]["n_skipped_flat"], end[7]["n_skipped_unreadable"], end[7]["n_candidates"], end[7]["best_n_matched_peaks"]) == (5, 1, 1, 7, 3)


def test_impure_scans_are_left_out_and_counted(case):
    scans, library, features = case
    used = annotate.usable(scans, 0.5)
    assert {r["scan_id"] for r in used.collect()} == {1, 4, 6, 7}
    found = annotate.candidates(used, features, library)
    end = {r["feature_id"]: r for r in annotate.outcomes(scans, found, annotate.scored(used, found, library), 4, 0.5).collect()}
    assert end[7]["n_skipped_purity"] == 1 and end[7]["outcome"] == "no_shared_fragments" and end[7]["best_n_matched_peaks"] == 3


def test_scored_as_the_expression_on_whole_spectra(spark, case):
    scans, library, features = case
    used = annotate.usable(scans)
    every = used.withColumnRenamed("peaks", "q").join(library.withColumnRenamed("peaks", "l").drop("polarity"), F.lit(True)).where("feature_id = 7").withColumn("m", spectral.reverse_dot_product(F.col("q"), F.col("l")))
    want = {(r["scan_id"], r["library_id"], r["spectrum_id"]): r["m"]["score"] for r in every.collect()}
    for r in annotate.scored(used, annotate.candidates(used, features, library), library).where("feature_id = 7").collect():
        assert r["score"] == pytest.approx(want[r["scan_id"], r["library_id"], r["spectrum_id"]])


def test_mirror(spark):
    df = spark.createDataFrame([([(100.0, 5.0), (100.0005, 9.0), (300.0, 1.0)], [(100.0, 2.0), (400.0, 3.0)])], f"q {PEAKS}, l {PEAKS}")
    m = df.select(annotate.mirror(F.col("q"), F.col("l")).alias("m")).first()["m"]
    pairs = lambda x: [tuple(p) for p in x]
    assert pairs(m["matched"]) == [(100.0, 5.0), (100.0005, 9.0)] and pairs(m["unmatched"]) == [(300.0, 1.0)]
    assert pairs(m["library_matched"]) == [(100.0, -2.0)] and pairs(m["library_unmatched"]) == [(400.0, -3.0)]
    assert [(c["library_mz"], c["query_mz"]) for c in m["connectors"]] == [(100.0, 100.0005)]


def test_formulas_of_known_ions(spark):
    glucose, caffeine = 180.06338810418, 194.08037557892
    rows = [(1, glucose + 1.00727646688), (2, caffeine + 1.00727646688), (3, glucose - 1.00727646688), (4, None), (5, 0.5), (6, float("nan"))]
    df = spark.createDataFrame(rows, "feature_id int, mz double")
    got = formulas.predict(df, ["[M+H]+", "[M-H]-"], error_ppm=2.0).collect()
    top = {(r["feature_id"], r["adduct"]): r for r in got if r["rank"] == 1}
    assert top[1, "[M+H]+"]["formula"] == top[3, "[M-H]-"]["formula"] == "C6H12O6" and top[2, "[M+H]+"]["formula"] == "C8H10N4O2"
    assert all(abs(r["mass_error_ppm"]) <= 2.001 and r["rank"] <= 5 for r in got) and {r["feature_id"] for r in got} == {1, 2, 3}


def test_formulas_against_brute_force(spark):
    m, bounds = {"C": 12.0, "H": 1.00782503207, "N": 14.0030740048, "O": 15.99491461956}, {"C": 12, "N": 3, "O": 6}
    mass, ppm = 151.0633, 30.0
    want = set()
    for c in range(1, 13):
        for n in range(min(3, int(c * 1.3)) + 1):
            for o in range(min(6, int(c * 1.2)) + 1):
                for h in range(0, 40):
                    total = c * m["C"] + h * m["H"] + n * m["N"] + o * m["O"]
                    double = 2 * c + 2 + n - h
                    if abs(total - mass) <= (mass + 1.00727646688) * ppm * 1e-6 and 0.1 * c <= h <= 3.1 * c and double >= 0 and double % 2 == 0:
                        want.add("".join(f"{e}{k if k > 1 else ''}" for e, k in (("C", c), ("H", h), ("N", n), ("O", o)) if k))
    df = spark.createDataFrame([(1, mass + 1.00727646688)], "feature_id int, mz double")
    assert {r["formula"] for r in formulas.predict(df, ["[M+H]+"], ppm, 100, bounds=bounds).collect()} == want and want
    assert formulas.predict(df, ["[M+H]+"], ppm, 1, bounds=bounds).count() == 1
    for bad in ([], ["[M+X]"]):
        with pytest.raises(ValueError):
            formulas.predict(df, bad)
