import json

import pytest
from pyspark.sql import functions as F

from ionloom.functions.spectral import peaks
from ionloom.operators import cleaning, exports
from ionloom.plans import pipeline
from ionloom.project import Project
from ionloom.sources import datasets, library


def arrays(mz, i):
    return peaks(F.array(*map(F.lit, map(float, mz))), F.array(*map(F.lit, map(float, i))))


def test_cleaning(spark):
    p = arrays([100, 500, 500.004, 501.003], [1, 1, 1, 1])
    r = spark.range(1).select(F.size(cleaning.below_precursor(p, F.lit(500.0), F.lit(1))), F.size(cleaning.below_precursor(p, F.lit(500.0), F.lit(2))), F.size(cleaning.below_precursor(p, F.lit(None).cast("double"), F.lit(1)))).first()
    assert tuple(r) == (3, 4, 4)
    found = cleaning.removed_background(spark.createDataFrame([("P", 150.0, 0.6), ("P", 200.0, 0.1), ("P", 300.0, 0.01)], "pol string, mz double, fraction double"))
    assert {x["mz"]: x["removed"] for x in found.collect()} == {150.0: True, 200.0: False}
    left = cleaning.without_background(spark.createDataFrame([("P", 150.0005), ("P", 150.0005), ("N", 150.0), ("P", 200.0)], "pol string, m double"), found, ["pol"], "m")
    assert sorted(map(tuple, left.collect())) == [("N", 150.0), ("P", 200.0)]


def test_parent_and_snap(spark):
    ms1 = spark.createDataFrame([(1, 10, 1.0, "P"), (1, 11, 2.0, "P"), (1, 12, 2.5, "N")], "s int, scan int, rt double, polarity string")
    ms2 = spark.createDataFrame([(1, 90, 3.0, "P", 10), (1, 91, 3.0, "P", None), (1, 92, 3.0, "P", 77), (1, 93, 0.5, "P", None)], "s int, id int, rt double, polarity string, parent int")
    got = {r["id"]: r["parent_scan"] for r in cleaning.resolve_parent(ms2, ms1, "s", "parent", "rt", "scan").collect()}
    assert got == {90: 10, 91: 11, 92: 11, 93: None}
    p = arrays([499.999, 500.0, 500.001, 500.002], [1, 5, 9, 4])
    r = spark.range(1).select(cleaning.snap_precursor(p, F.lit(500.0)).alias("a"), cleaning.snap_precursor(p, F.lit(700.0)).alias("b"), cleaning.matched_pairs(p, arrays([500.0, 10.0], [1, 1]), 5.0).alias("m")).first()
    assert r["a"]["mz"] == pytest.approx(500.0009, abs=2e-4) and r["b"]["mz"] == 700.0 and [tuple(x) for x in r["m"]] == [(500.0, 500.001)]


def test_exports(spark):
    matrix = spark.createDataFrame([("a", 1, 7, 2.0), ("a", 2, 8, 3.0)], "s string, pixel_id int, f int, v double")
    pixels = spark.createDataFrame([("a", 1, 0, 0), ("a", 2, 1, 0), ("a", 3, 2, 0)], "s string, pixel_id int, x int, y int")
    features = spark.createDataFrame([(7, 100.12346), (8, 90.5), (9, None)], "f int, mz double")
    t = exports.integration_table(matrix, pixels, features, ["s"], "pixel_id", "f", "mz", "v").orderBy("pixel_id")
    assert t.columns == ["s", "pixel_id", "x", "y", "90.5000", "100.1235"] and [tuple(r)[4:] for r in t.collect()] == [(0.0, 2.0), (3.0, 0.0), (0.0, 0.0)]
    axis = spark.createDataFrame([(100.1234561,), (5.0,)], "mz double")
    notes = spark.createDataFrame([(1, 100.1234563, "x", 0.5)], "feature_id int, mz double, name string, score double")
    assert sorted(map(tuple, exports.annotation_columns(axis, notes, "mz").select("feature_id", "name", "score").collect())) == [(-1, "", None), (1, "x", 0.5)]
    assert json.loads(exports.report({"p": pixels}))["p"][0]["x"] == 0
    with pytest.raises(ValueError):
        exports.report({"p": pixels}, 2)
    assert exports.upsampled(pixels, ["s"], "x", "y", 2).count() == 12
    rgb = exports.composite(spark.createDataFrame([(1, 0.6, 0.1, 0.0), (1, 0.6, 0.1, 0.0)], "p int, r double, g double, b double"), ["p"], "r", "g", "b").first()
    assert tuple(rgb) == (1, 255, 51, 0)


def test_library_and_datasets(spark):
    meta = spark.createDataFrame([(1, "CAS Number", "50-99-7"), (1, "cas", " "), (1, "Precursor_Type", "[M+H]+"), (2, "other", "x")], "spectrum_id int, key string, value string")
    assert {r["spectrum_id"]: (r["adduct"], r["cas"], r["hmdb"]) for r in library.extras(meta).collect()} == {1: ("[M+H]+", "50-99-7", None), 2: (None, None, None)}
    spectrum = spark.createDataFrame([(1, 1, 1, 181.07), (2, 1, None, 181.0707)], "spectrum_id int, compound_id int, adduct_id int, precursor_mz double")
    compound = spark.createDataFrame([(1, "glucose", "C6H12O6", "K")], "compound_id int, name string, formula string, inchikey string")
    ions = spark.createDataFrame([(1, "[M+H]+", 1, 1, 1.00727646)], "adduct_id int, adduct string, charge int, molecules int, delta double")
    assert [r["ref_mz"] for r in library.with_reference_mz(spectrum, compound, ions).orderBy("spectrum_id").collect()] == [pytest.approx(181.07066, abs=1e-4), 181.0707]
    rows = spark.createDataFrame([("s", "12-s", 0, 0, 1.0), ("s", "odd", 1, 0, 2.0)], "sample string, name string, x int, y int, v double")
    pixels = spark.createDataFrame([("s", 12, 5, 5), ("s", 13, 1, 0)], "sample string, pixel_id bigint, x int, y int")
    assert sorted((r["name"], r["pixel_id"]) for r in datasets.match_pixels(rows, pixels, "sample", "name").collect()) == [("12-s", 12), ("odd", 13)]
    assert set(datasets.inspect(rows)["sample_columns"]) == {"sample", "name"}
    with pytest.raises(Exception, match="no pixel"):
        datasets.match_pixels(rows, pixels.limit(0), "sample", "name").collect()


def test_rasters(spark, tmp_path):
    ramp = exports.colour_ramp([(0, 0, 0), (255, 255, 255)], 3)
    assert ramp == [0, 0x808080, 0xFFFFFF]
    df = spark.createDataFrame([(1, 0, 0, -5.0), (1, 0, 1, 1.0), (1, 1, 0, 9.0), (1, 1, 1, None), (2, 0, 0, float("nan"))], "s int, y int, x int, v double").withColumns({"lo": F.lit(0.0), "hi": F.lit(2.0)})
    shown = exports.colourised(df, "v", "lo", "hi", ramp)
    assert [r["rgba"] for r in shown.orderBy("s", "y", "x").collect()] == [0xFF, 0x808080FF, 0xFFFFFFFF, 0, 0]
    exports.write_rasters(shown, ["s"], str(tmp_path / "r"))
    exports.write_rasters(shown.where("s = 2"), ["s"], str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).groupBy("s").count().count() == 2


def test_pipeline_skips_done_stages_and_restores_on_failure(spark, tmp_path):
    n = {"calls": 0}

    def build(c, a):
        n["calls"] += 1
        if n["calls"] == 5:
            raise RuntimeError("stage fails")
        return c.spark.range(n["calls"] * a)

    stages = [pipeline.Stage("one", build, {"a": 1}), pipeline.Stage("two", lambda c: c.table("one"), {}, ["one"])]
    out = str(tmp_path / "out")
    run = lambda **kw: pipeline.run(spark, "", out, "r", stages, **kw)
    assert run() == ["one", "two"] and run() == []
    # Other arguments, or inputs made anew, call for another run; the arguments logged are those used.
    assert run(config={"stages": {"one": {"a": 10}}}) == ["one", "two"]
    project = Project(spark, out)
    assert project.read("two").count() == 20 and project.read("commands").where("command_name = 'one'").count() == 2
    pipeline.reannotate(spark, "", out, "r", {}, stages)
    assert project.read("one").count() == 3 and project.history().count() == 2
    first = project.history().first()["entry_id"]
    n["calls"] = 4
    with pytest.raises(RuntimeError):
        pipeline.reannotate(spark, "", out, "r", {}, stages)
    assert project.read("one").count() == 3
    project.restore(first)
    assert project.read("one").count() == 20
    for text in ('{"version": 9}', '{"version": 1, "stages": {"none": {}}}', '{"version": 1, "stages": {"align_mz": {"x": 1}}}'):
        (tmp_path / "c.json").write_text(text)
        with pytest.raises(ValueError):
            pipeline.load_config(str(tmp_path / "c.json"))
    (tmp_path / "c.toml").write_text("version = 1\n[stages.align_mz]\nppm = 7.0\n")
    assert pipeline.load_config(str(tmp_path / "c.toml"))["stages"] == {"align_mz": {"ppm": 7.0}}
