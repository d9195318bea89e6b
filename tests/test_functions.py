import math
import random

import pytest
from pyspark.sql import functions as F

from ionloom.functions import chemistry, search, spectral


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def arrays(mz, i):
    return spectral.peaks(F.array(*map(F.lit, map(float, mz))), F.array(*map(F.lit, map(float, i))))


def test_polarity(spark):
    cases = {"+": "POSITIVE", "pos": "POSITIVE", " Positive": "POSITIVE", "POSITIVE scan": "POSITIVE", "-": "NEGATIVE", "neg": "NEGATIVE", "": None, "weird": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", spectral.normalize_polarity(F.col("p"))).collect()} == cases


def brute_score(q, l, ppm, noise):
    """The same score by plain loops."""
    def clean(p):
        top = max((i for _, i in p), default=0)
        return [(m, i / top) for m, i in p if i / top >= noise] if top > 0 else p

    q, l = clean(q), clean(l)  # noqa: E741
    if not q or not l:
        return 0.0, 0
    w = lambda m, i: i**0.5 * m**2.0
    pairs = [(m, i, max((x for n, x in q if abs(n - m) <= m * ppm * 1e-6), default=None)) for m, i in l]
    emp = sum(any(abs(n - m) <= m * ppm * 1e-6 for n, _ in l) for m, _ in q)
    lq = sum(w(m, i) * w(m, x or 0) for m, i, x in pairs)
    norm = math.sqrt(sum(w(m, i) ** 2 for m, i, _ in pairs)) * math.sqrt(sum(w(m, x or 0) ** 2 for m, _, x in pairs))
    n = sum(x is not None for *_, x in pairs)
    dot = lq / norm if norm else 0.0
    return dot * math.sqrt(n / len(l)) * math.sqrt(emp / len(q)), n


def test_score_identical_disjoint_and_random(spark):
    mz, i = [80.05, 120.08, 160.10, 200.12, 240.15], [100, 500, 250, 900, 50]
    same = one(spark, spectral.reverse_dot_product(arrays(mz, i), arrays(mz, i)).alias("m"))["m"]
    assert same["score"] == pytest.approx(1) and same["lib_coverage"] == 1 and same["n_matched_peaks"] == 5
    none = one(spark, spectral.reverse_dot_product(arrays([100, 150, 200], [1, 2, 3]), arrays([300, 350, 400], [1, 2, 3])).alias("m"))["m"]
    assert none["score"] == 0 and none["n_matched_peaks"] == 0
    r = random.Random(2)
    for _ in range(6):
        q = [(r.choice([100, 200, 300, 400]) + r.random() * 0.01, r.random()) for _ in range(6)]
        l = [(r.choice([100, 200, 300, 500]) + r.random() * 0.01, r.random()) for _ in range(5)]  # noqa: E741
        got = one(spark, spectral.reverse_dot_product(arrays(*zip(*q)), arrays(*zip(*l)), ppm=30.0).alias("m"))["m"]
        want, n = brute_score(q, l, 30.0, 0.01)
        assert got["score"] == pytest.approx(want) and got["n_matched_peaks"] == n
    empty = F.array().cast("array<struct<m:double,i:double>>")
    assert one(spark, spectral.reverse_dot_product(empty, arrays(mz, i)).alias("m"))["m"]["score"] == 0


def test_spectrum_measures(spark):
    p = arrays([100, 101, 300], [50, 25, 25])
    r = one(
        spark,
        spectral.fragmentation_factor(p, F.lit(100.5)).alias("factor"),
        spectral.fragmentation_factor(arrays([1.0], [0.0]), F.lit(1.0)).alias("dark"),
        spectral.is_flat(arrays([1, 2, 3], [10, 11, 10])).alias("flat"),
        spectral.is_flat(arrays([1, 2], [10, 10])).alias("few"),
        spectral.base_peak(arrays([5, 3, 9], [7, 7, 1])).alias("base"),
        F.size(spectral.noise_filtered(arrays([1, 2, 3], [1000, 5, 800]), 0.01)).alias("kept"),
        spectral.window_bounds(F.lit(500.0), F.lit(0.0), F.lit(float("nan")), 0.7).alias("w"),
        spectral.max_m1_ratio(F.lit(300.0), F.lit(1)).alias("ratio"),
    )
    assert r["factor"] == pytest.approx(0.25) and r["dark"] is None and r["flat"] and not r["few"] and r["base"] == 3 and r["kept"] == 2
    assert tuple(r["w"]) == pytest.approx((499.3, 500.7)) and r["ratio"] == pytest.approx(1.1 * 0.0107 * 300 / 14 + 0.02)


def test_purity(spark):
    r = one(
        spark,
        spectral.purity_fraction(arrays([499.8, 500.0, 500.2], [0, 100, 0]), F.lit(499.5), F.lit(500.5), F.lit(500.0)).alias("alone"),
        spectral.purity_fraction(arrays([499.8, 500.0, 500.4], [0, 5, 100]), F.lit(499.5), F.lit(500.5), F.lit(500.0)).alias("minor"),
        spectral.purity_fraction(arrays([400.0], [5]), F.lit(499.5), F.lit(500.5), F.lit(500.0)).alias("none"),
    )
    assert r["alone"] > 0.8 and r["minor"] < 0.15 and r["none"] == 0
    terms = one(spark, spectral.peak_term(F.lit(5), 10), spectral.peak_term(F.lit(50), 10), spectral.peak_term(F.lit(3), 0), spectral.purity_term(F.lit(None).cast("double"), 0.5), spectral.purity_term(F.lit(1.7), 0.5), spectral.purity_term(F.lit(-0.2), 0.5))
    assert tuple(terms) == (0.5, 1, 1, 0.5, 1, 0)


def test_chemistry(spark):
    r = one(spark, chemistry.neutral_mass(F.lit("C6H12O6")), chemistry.neutral_mass(F.lit("C6H12Xx")), chemistry.neutral_mass(F.lit("")), chemistry.n_decimals(F.lit(760.59)), chemistry.reference_mz(F.lit(760.59), F.lit(760.5851)), chemistry.reference_mz(F.lit(760.5852), F.lit(1.0)), chemistry.area_factor(F.lit("mm"), F.lit("um")), chemistry.pixel_area(F.lit(10), F.lit(0.0)))
    assert r[0] == pytest.approx(180.06339, abs=1e-4) and r[1] is None and r[2] is None and r[3] == 2 and r[4] == 760.5851 and r[5] == 760.5852 and r[6] == 1e6 and r[7] is None
    ions = {x["adduct"]: x for x in chemistry.adducts(spark).collect()}
    assert len(ions) == 16 and ions["[M+H]+"]["delta"] == pytest.approx(chemistry.PROTON, abs=1e-6) and ions["[M+2H]2+"]["charge"] == 2
    said = spark.createDataFrame([("[m+h]+",), ("M+H",), ("[M+H]1+",), ("[M-H]-",), ("odd",), (None,)], "a string")
    assert [x[0] for x in said.select(chemistry.tidy_adduct(F.col("a"))).collect()] == ["[M+H]+", "[M+H]+", "[M+H]+", "[M-H]-", "odd", None]


def test_search(spark):
    df = spark.createDataFrame([(1, "Glucose", 180.0634), (2, None, 500.25), (3, "fructose", None)], "i int, n string, mz double")
    found = lambda c: [r[0] for r in df.where(c).orderBy("i").collect()]
    assert found(search.matches_name(" ", F.col("n"))) == [1, 2, 3] and found(search.matches_name("OSE", F.col("n"))) == [1, 3]
    assert found(search.matches_mz("600-100", F.col("mz"))) == [1, 2] and found(search.matches_mz("180.06", F.col("mz"))) == [1] and found(search.matches_mz("x", F.col("mz"))) == []
    r = one(spark, search.filled_layer(F.lit("TIC_filled_r2")), search.category_colours(F.lit("a=00FF00,b,c=12")), search.channels(F.lit("500.1:ff0000:0:1:0.5,bad")), search.snap_threshold(F.lit(0.37)), search.snap_threshold(F.lit(99.0)))
    assert tuple(r[0]) == ("TIC", 2) and r[1] == {"a": "00ff00"} and len(r[2]) == 1 and r[2][0]["gamma"] == 0.5 and r[3] == pytest.approx(0.35) and r[4] == 5.0
