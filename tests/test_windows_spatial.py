import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.operators import aggregates, isotopes, ranks, spatial, windows


def plain_align(peaks, ppm):
    out, held = [], []
    for m, s, i in sorted(peaks):
        mean = np.mean([x[0] for x in held]) if held else m
        if held and (abs(m - mean) / mean * 1e6 > ppm or s in {x[1] for x in held}):
            out.append(held)
            held = []
        held.append((m, s, i))
    return sorted((round(float(np.mean([x[0] for x in c])), 4), len(c)) for c in [*out, held] if c)


def test_alignment_meets_the_plain_loop_and_fixture(spark):
    r = random.Random(4)
    peaks = [(round(100 + r.randrange(400) * 0.0007, 4), r.randrange(5), k) for k in range(300)]
    df = spark.createDataFrame(peaks, "mz double, s int, i int")
    got = sorted((x["feature_mz"], x["n_members"]) for x in windows.align_across(df, "mz", "s", "i", 10.0).collect())
    assert got == plain_align(peaks, 10.0)
    fixture = [(100.0, "A", 0), (200.0, "A", 1), (500.0, "A", 2), (100.0005, "B", 0), (300.0, "B", 1), (500.0002, "B", 2), (200.001, "C", 0), (300.0, "C", 1)]
    rows = windows.align_across(spark.createDataFrame(fixture, "mz double, s string, i int"), "mz", "s", "i", 10.0).collect()
    assert sorted(tuple(sorted(x["members"].items())) for x in rows) == [(("A", 0), ("B", 0)), (("A", 1), ("C", 0)), (("A", 2), ("B", 2)), (("B", 1), ("C", 1))]


def test_suppression(spark):
    df = spark.createDataFrame([(300.0, 10.0), (100.0001, 500.0), (100.0, 50.0), (200.0, 20.0)], "mz double, i double")
    assert sorted(x["mz"] for x in windows.suppress_near(df, "mz", "i", 5.0).collect()) == [100.0001, 200.0, 300.0]
    assert windows.suppress_near(df.limit(0), "mz", "i", 5.0).count() == 0


def test_islands_over_buckets(spark):
    values = [0.1, 0.2, 0.9, 1.05, 5.0, 5.0, 9.95, 10.05, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = sorted((x["v"], x["island"]) for x in windows.islands(df, "v", lambda a, b: a - b > 0.3, width=1.0).collect())
    assert [i for _, i in got] == [1, 1, 2, 2, 3, 3, 4, 4]


def test_ranks(spark):
    df = spark.createDataFrame([("f", 1, 0.90, 3), ("f", 2, 0.83, 9), ("f", 3, 0.80, 1), ("g", 4, 0.5, 1), ("g", 5, 0.5, 1)], "f string, id int, score double, n int")
    rank = lambda t: {x["id"]: x["r"] for x in windows.rank_with_tolerance(df, ["f"], "score", "n", ["id"], t, "r").collect()}
    assert rank(0.1) == {2: 1, 1: 2, 3: 3, 4: 1, 5: 2} and rank(0.05) == {1: 1, 2: 2, 3: 3, 4: 1, 5: 2}
    scans = spark.createDataFrame([("f", 1, 0.2), ("f", 1, 0.9), ("f", 2, 0.5), (None, 3, 0.1)], "f string, scan int, score double")
    got = {(x["f"], x["scan"]): x["r"] for x in windows.rank_by_best(scans, ["f"], ["scan"], "score", "r").collect()}
    assert got == {("f", 1): 1, ("f", 2): 2, (None, 3): 1}
    ties = spark.createDataFrame([("f", 1, 0.1, 0.5), ("f", 2, 0.5, 0.5), ("f", 3, 0.65, 0.5), ("f", 4, 2.0, 0.5)], "f string, id int, ppm double, spread double")
    assert {x["id"]: x["tie_rank"] for x in windows.tie_ranks(ties, ["f"], "ppm", "spread", ["id"]).collect()} == {1: 1, 2: 1, 3: 2, 4: 3}


def test_consensus(spark):
    df = spark.createDataFrame([(7, 1, 0.3, 3, None), (7, 2, 0.95, 15, None), (7, 3, 0.6, 8, None), (8, 1, 0.1, 5, 0.9)], "f int, scan int, purity double, n int, best double")
    got = {x["f"]: x for x in windows.consensus(df, ["f"], "n", "purity", "best", ["scan"]).collect()}
    assert got[7]["scan"] == 2 and got[7]["n_considered"] == 3 and 8 in got
    assert [x["f"] for x in windows.consensus(df, ["f"], "n", "purity", "best", ["scan"], min_purity=0.5).collect()] == [7]


def test_background(spark):
    rows = [(150.0, "P", 1)] * 10 + [(150.0005, "P", 2), (300.0, "P", 2)]
    got = {round(x["mz"]): (x["n_keys"], x["n_total"]) for x in windows.background(spark.createDataFrame(rows, "mz double, pol string, k int"), "mz", "pol", "k").collect()}
    assert got == {150: (2, 2), 300: (1, 2)}


@pytest.mark.parametrize("block", [150, 20_000])
def test_centroids_find_planted_peaks(spark, block):
    """Of every group, however the axis is cut; bins that are empty need no row."""
    x = np.arange(0, 2000) * 0.01 + 100
    planted = {"a": (103.123, 110.5, 117.777), "b": (104.4,)}
    rows = [(g, i, float(a), float(b)) for g, at in planted.items() for i, (a, b) in enumerate(zip(x, np.full(len(x), 1.0) + sum(500 * np.exp(-0.5 * ((x - c) / 0.02) ** 2) for c in at), strict=True)) if not 1500 < i < 1600]
    df = spark.createDataFrame(rows, "s string, bin long, x double, y double")
    found = windows.centroids(df, ["s"], "bin", "x", "y", 0.01, baseline_factor=10, block=block).collect()
    for g, at in planted.items():
        assert sorted(r["mz"] for r in found if r["s"] == g) == pytest.approx(at, abs=0.006)
    assert windows.centroids(df.limit(0), ["s"], "bin", "x", "y", 0.01).count() == 0


def test_bin_decimals():
    assert [windows.bin_decimals(w) for w in (1.0, 0.5, 0.1, 0.01, 0.002, 0.0001)] == [0, 1, 1, 2, 3, 4]


@pytest.mark.parametrize("held", [0, 1_000_000])
def test_exact_percentiles_of_groups_of_any_size(spark, held):
    r = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n in (("hot", 3000), ("one", 1), ("two", 2)) for v in r.choice([1.0, 2.5, 7.0, r.random()], n)] + [("hot", None), ("hot", float("nan")), ("none", None)] + [(None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.1, 0.5, 0.995, 1.0]
    got = {x["g"]: x for x in ranks.percentiles(df.where("g is not null"), ["g"], "v", shares, held).collect()}
    assert set(got) == {"hot", "one", "two"}
    for g, x in got.items():
        v = [b for a, b in rows if a == g and b is not None and b == b]
        assert x["n"] == len(v) and list(x["q"]) == pytest.approx(list(np.quantile(v, shares)))
    whole = ranks.percentiles(df, [], "v", [0.5], held).first()
    assert whole["q"][0] == pytest.approx(np.median([b for _, b in rows if b is not None and b == b]))
    assert ranks.percentiles(df.limit(0), ["g"], "v", [0.5], held).count() == 0


@pytest.mark.parametrize("held", [0, 1_000_000])
def test_ranks_by_ranges(spark, held):
    rows = [("hot" if k % 3 else None, k, (k * 7919) % 13) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, id int, v int").repartition(7)
    got = {x["id"]: x["r"] for x in ranks.ranked(df, ["g"], [F.desc("v"), F.asc("id")], "r", held).collect()}
    for g in ("hot", None):
        order = sorted((-v, k) for h, k, v in rows if h == g)
        assert all(got[k] == n for n, (_, k) in enumerate(order, 1))


def grid(spark, values):
    rows = [("s", y * len(values[0]) + x, x * 10, y * 5, float(v)) for y, row in enumerate(values) for x, v in enumerate(row)]
    g = spatial.grid_indices(spark.createDataFrame(rows, "s string, p int, x int, y int, v double"), ["s"])
    return g


def test_fill_blanks(spark):
    g = grid(spark, [[1, 2, 3], [4, 0, 6], [7, 8, 9]])
    out = spatial.fill_blanks(g.select("s", "p", "v"), spatial.neighbours(g, ["s"], "p"), ["s"], "p", [], "v").where("filled").collect()
    assert [(r["p"], r["v"]) for r in out] == [(4, 5.0)]
    g = grid(spark, [[5, 0, 0], [5, 0, 0], [5, 0, 0]])
    assert spatial.fill_blanks(g.select("s", "p", "v"), spatial.neighbours(g, ["s"], "p"), ["s"], "p", [], "v").where("filled").count() == 0


def test_moran_against_numpy(spark):
    v = np.random.default_rng(0).random((6, 5))
    g = grid(spark, v.tolist())
    edges = spatial.neighbours(g, ["s"], "p", rook=True)
    z = v - v.mean()
    lag = np.zeros_like(z)
    pairs = s0 = 0
    for i in range(6):
        for j in range(5):
            n = [z[a, b] for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if 0 <= a < 6 and 0 <= b < 5]
            lag[i, j] = np.mean(n)
            pairs += z[i, j] * sum(n)
            s0 += len(n)
    got = {r["p"]: r["local_i"] for r in spatial.local_moran(g, edges, ["s"], "p", "v").collect()}
    assert [got[k] for k in sorted(got)] == pytest.approx((z / v.var() * lag).ravel().tolist())
    assert spatial.global_moran(g, edges, ["s"], "p", "v").first()["moran_i"] == pytest.approx(30 / s0 * pairs / (z**2).sum())
    flat = grid(spark, [[1, 1], [1, 1]])
    assert all(r["local_i"] is None for r in spatial.local_moran(flat, spatial.neighbours(flat, ["s"], "p", rook=True), ["s"], "p", "v").collect())
    above = {r["threshold_index"]: r["n_above"] for r in spatial.above_thresholds(spatial.local_moran(g, edges, ["s"], "p", "v"), ["s"], "local_i").collect()}
    want = (z / v.var() * lag).ravel()
    assert all(above[k] == int((want > -1 + 0.05 * k).sum()) for k in range(121))


def test_affine_and_polygon(spark):
    m = (2.0, 0.5, 10.0, -0.25, 1.5, 3.0)
    pts = [(0.0, 0.0), (4.0, 1.0), (2.0, 7.0), (9.0, 3.0)]
    df = spark.createDataFrame([(x, y, m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]) for x, y in pts], "x double, y double, u double, v double")
    assert spatial.fit_affine(df, "x", "y", "u", "v") == pytest.approx(m)
    turned = spark.createDataFrame([(x, y, -2 * y + 1, 2 * x - 3) for x, y in pts], "x double, y double, u double, v double")
    assert spatial.fit_similarity(turned, "x", "y", "u", "v") == pytest.approx((0, -2, 1, 2, 0, -3), abs=1e-9)
    with pytest.raises(ValueError):
        spatial.fit_affine(df.limit(2), "x", "y", "u", "v")
    inside = df.where(spatial.in_polygon(F.col("x"), F.col("y"), [(1, 0), (5, 0), (5, 5), (1, 5)])).collect()
    assert [(r["x"], r["y"]) for r in inside] == [(4.0, 1.0)]
    assert df.where(spatial.in_polygon(F.col("x"), F.col("y"), [(0, 0), (9, 9)])).count() == 0


def test_calibration(spark):
    df = spark.createDataFrame([("a", float(x), 2.0 * x + 3) for x in range(5)] + [("b", float(x), 5.0) for x in range(3)] + [("c", 1.0, 1.0), ("c", None, 2.0)], "k string, x double, y double")
    got = {r["k"]: r for r in aggregates.calibration(df, ["k"], "x", "y").collect()}
    a, b = got["a"], got["b"]
    assert (a["slope"], a["intercept"], a["r2"]) == pytest.approx((2, 3, 1)) and a["lod"] == pytest.approx(0, abs=1e-6)
    assert b["slope"] == 0 and b["lod"] is None and got["c"]["slope"] is None
    assert aggregates.calibration(df, ["k"], "x", "y", "1/x2").where("k = 'a'").first()["slope"] == pytest.approx(2)
    assert spark.range(1).select(aggregates.interpolate(F.lit(11.0), F.lit(2.0), F.lit(3.0)), aggregates.interpolate(F.lit(1.0), F.lit(0.0), F.lit(3.0))).first()[:] == (4.0, None)


@pytest.mark.parametrize("rank", [False, True])
def test_correlation_against_numpy(spark, rank):
    g = np.random.default_rng(3)
    x = np.where(g.random((40, 4)) < 0.5, 0, g.integers(1, 6, (40, 4))).astype(float)
    m = spark.createDataFrame([("s", p, f, float(x[p, f])) for p in range(40) for f in range(4) if x[p, f]] + [("s", p, 9, 3.0) for p in range(40)], "s string, p int, f int, v double")
    n = spark.createDataFrame([("s", 40)], "s string, n long")
    ranked = x
    if rank:
        ranked = np.stack([[np.sum(c < v) + (np.sum(c == v) + 1) / 2 for v in c] for c in x.T], axis=1)
    want = np.corrcoef(ranked.T)
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in aggregates.correlation_pairs(m, n, ["s"], "p", "f", "v", rank).collect()}
    assert set(got) == {(a, b) for a in range(4) for b in range(a + 1, 4)}
    assert all(v == pytest.approx(want[k]) for k, v in got.items())
    # Cut into tiles and lots the products are the same.
    tiles = aggregates.correlation_pairs(m, n, ["s"], "p", "f", "v", rank, pixels_per_lot=7, features_per_tile=1)
    assert {(r["feature_a"], r["feature_b"]): r["r"] for r in tiles.collect()} == {k: pytest.approx(v) for k, v in got.items()}
    if not rank:
        one = {r["f"]: r["r"] for r in aggregates.correlation_with(m, n, ["s"], "p", "f", "v", 2).collect()}
        assert one == {f: pytest.approx(want[2, f]) for f in (0, 1, 3)}


def test_correlation_from_a_bound_on(spark):
    """Features 0 and 1 are never on one pixel and fill it all: r is -1."""
    x = np.zeros((40, 4))
    x[:20, 0], x[20:, 1], x[:3, 2], x[3:5, 3] = 5.0, 5.0, 1.0, 1.0
    m = spark.createDataFrame([("s", p, f, float(x[p, f])) for p in range(40) for f in range(4) if x[p, f]], "s string, p int, f int, v double")
    n = spark.createDataFrame([("s", 40)], "s string, n long")
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in aggregates.correlation_pairs(m, n, ["s"], "p", "f", "v", min_abs=0.25).collect()}
    want = np.corrcoef(x.T)
    assert got == {(a, b): pytest.approx(want[a, b]) for a in range(4) for b in range(a + 1, 4) if abs(want[a, b]) >= 0.25} and got[0, 1] == pytest.approx(-1)


def test_isotope_vote_and_links(spark):
    links = spark.createDataFrame([(s, 1, 2, 1, 1, r, c) for s, r, c in (("a", 0.2, 0.9), ("b", 0.3, 0.8))] + [("a", 1, 3, 2, 1, 0.1, 0.9)], "sample string, mono_id int, isotope_id int, k int, z int, ratio double, corr double")
    present = spark.createDataFrame([(s, f) for s in "abc" for f in (1, 2, 3)], "sample string, feature_id int")
    none = present.select("feature_id").limit(0)
    got = aggregates.isotope_vote(links, present, none).collect()
    assert [(r["isotope_id"], r["n_samples_linked"], r["n_samples_both"], r["intensity_ratio"], r["spatial_corr"]) for r in got] == [(2, 2, 3, pytest.approx(0.25), pytest.approx(0.85))]
    assert aggregates.isotope_vote(links, present, spark.createDataFrame([(2,)], "feature_id int")).count() == 0
    features = spark.createDataFrame([(1, 300.0), (2, 301.0033548), (3, 302.0067096), (4, 400.0)], "f int, mz double")
    matrix = spark.createDataFrame([("a", p, f, v * (p + 1.0)) for p in range(6) for f, v in ((1, 10.0), (2, 1.5), (3, 0.1), (4, 3.0))], "s string, p int, f int, v double")
    out = isotopes.link_isotopes(features, matrix, spark.createDataFrame([("a", 6)], "s string, n long"), "s", "p", "f", "mz", "v")
    assert sorted((r["mono_id"], r["isotope_id"], r["k"]) for r in out.collect()) == [(1, 2, 1), (1, 3, 2)]


def test_weighted_mz_and_range(spark):
    df = spark.createDataFrame([(1, 100.0, 3.0), (1, 100.0001, 1.0), (2, 50.0, 0.0)], "f int, mz double, w double")
    got = {r["f"]: r for r in aggregates.weighted_mz(df, ["f"], "mz", "w").collect()}
    assert got[1]["mz_weighted"] == pytest.approx(100.000025) and got[1]["mz_spread_ppm"] == pytest.approx(0.5, abs=0.01) and got[2]["mz_spread_ppm"] is None
    assert aggregates.value_range(df, ["f"], "w").where("f = 2").first()["vmax"] == 1.0


def test_components(spark):
    chain = [(1, k, k + 1) for k in range(100, 140)] + [(1, 7, 5), (1, 9, 5), (2, 5, 100)]
    got = {(r["s"], r["node"]): r["component"] for r in isotopes.components(spark.createDataFrame(chain, "s int, a int, b int"), "s", "a", "b").collect()}
    assert all(got[1, k] == 100 for k in range(100, 141)) and {got[1, k] for k in (5, 7, 9)} == {5} and got[2, 100] == got[2, 5] == 5
    assert isotopes.components(spark.createDataFrame([], "s int, a int, b int"), "s", "a", "b").count() == 0


def test_claims_as_in_turn(spark):
    """Random images: what the connected parts claim is what going through all features of a sample in turn claims."""
    r = np.random.default_rng(8)
    mz = {k: 300 + 1.0033548 * (k % 12) + 20 * (k // 12) for k in range(48)}
    base = r.random(20)
    images = {(s, k): np.where(r.random(20) < 0.9, base * 10 ** r.uniform(0, 3) + 0.3 * r.random(20), 0) for s in (1, 2) for k in mz}
    m = spark.createDataFrame([(s, p, k, float(v)) for (s, k), image in images.items() for p, v in enumerate(image) if v > 0], "s int, p int, f int, v double")
    f = spark.createDataFrame(list(mz.items()), "f int, mz double")
    n = spark.createDataFrame([(1, 20), (2, 20)], "s int, n int")
    got = {(x["s"], x["mono_id"], x["isotope_id"], x["k"], x["z"]) for x in isotopes.link_isotopes(f, m, n, "s", "p", "f", "mz", "v").collect()}
    want = set()
    for s in (1, 2):
        h = {k: images[s, k].mean() for k in mz}
        taken = set()
        for a in sorted(mz, key=lambda k: (-h[k], k)):
            if a in taken:
                continue
            chain = []
            for k in (1, 2, 3):
                fits = []
                for b in mz:
                    e = mz[a] + k * 1.0033548
                    if b == a or b in taken or abs(mz[b] - e) > e * 5e-6 or not h[b] < h[a] or (k == 1 and h[b] / h[a] > 1.1 * 0.0107 * mz[a] / 14 + 0.02):
                        continue
                    on = images[s, a] > 0
                    corr = np.corrcoef(images[s, a][on], images[s, b][on])[0, 1]
                    if corr >= 0.5:
                        fits.append((corr, mz[b], b))
                if not fits:
                    break
                chain.append((s, a, max(fits)[2], k, 1))
            want |= set(chain)
            taken |= {c[2] for c in chain} | ({a} if chain else set())
    assert got == want and len(want) > 5


def test_violin(spark):
    r = np.random.default_rng(4)
    v = np.r_[r.normal(0, 1, 3000), r.normal(6, 0.5, 1000)]
    rows = [("a", float(x)) for x in v] + [("flat", 2.0), ("flat", 2.0), ("one", 1.0), ("a", None), ("a", float("nan"))]
    got = aggregates.violin(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()
    a = sorted((x["x"], x["density"]) for x in got if x["g"] == "a")
    width = v.std(ddof=1) * len(v) ** -0.2
    for x, d in a[::7]:
        assert d == pytest.approx(np.exp(-0.5 * ((x - v) / width) ** 2).sum() / (len(v) * width * np.sqrt(2 * np.pi)), rel=0.01, abs=1e-4)
    assert len(a) == 64 and all(x["density"] is None for x in got if x["g"] in ("flat", "one"))
