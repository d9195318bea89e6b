import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.llm import nearest_time, quantiles, topn


def brute_top(rows, n):
    best = {}
    for g, i, s in rows:
        if None not in (g, i, s) and not math.isnan(s):
            best.setdefault(g, {})[i] = max(s, best.get(g, {}).get(i, -math.inf))
    return {(g, i, s, k + 1) for g, of in best.items() for k, (i, s) in enumerate(sorted(of.items(), key=lambda x: (-x[1], x[0]))[:n])}


def test_top_n_meets_brute_force(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 2, 3]), f"i{r.randrange(40)}", r.choice([0.1, 0.5, 0.5, 0.9, r.random()])) for _ in range(3000)]
    rows += [(None, "x", 1.0), (4, None, 1.0), (5, "x", None), (6, "x", float("nan")), (7, "only", 0.2)] + rows[:40]
    for parts in (1, 7):
        df = spark.createDataFrame([(*x, "extra") for x in rows], "g int, item string, score double, bound string").repartition(parts)
        for n in (1, 5):
            assert {tuple(x) for x in topn.top_n(df, "g", "item", "score", n).collect()} == brute_top(rows, n)
    assert topn.top_n(df.limit(0), "g", "item", "score", 3).count() == 0


def brute_pairs(left, right, tolerance):
    tick = lambda x: math.floor(abs(x) * 1000 + 0.5) * (1 if x >= 0 else -1)
    ok = lambda x: x is not None and not math.isnan(x)
    out = set()
    for e, k, t in left:
        near = [(abs(tick(u) - tick(t)), tick(u), j) for f, j, u in right if None not in (e, k, f, j) and e == f and ok(t) and ok(u) and abs(tick(u) - tick(t)) <= tolerance]
        if near:
            out.add((e, k, min(near)[2]))
    return out


def test_nearest_time_meets_brute_force(spark):
    r = random.Random(2)
    nan = float("nan")
    make = lambda n, step: [(r.randrange(3), k, r.randrange(0, 40_000, step) / 1000) for k in range(n)]
    left, right = make(300, 7), make(120, 11)
    left += [(1, 900, None), (1, 901, nan), (None, 902, 1.0), (1, None, 1.0)] + left[:20]
    right += [(1, 900, None), (1, 901, nan), (None, 5, 1.0), (1, 950, right[0][2]), (1, 951, right[0][2])] + right[:9]
    l = spark.createDataFrame([(*x, 1.0) for x in left], "e int, k int, t double, lo double")  # noqa: E741
    q = spark.createDataFrame([(*x, 1.0) for x in right], "e int, j int, t double, lo double")
    for tolerance in (1, 50, 2000):
        got = {tuple(x) for x in nearest_time.pair_nearest(l, q, ["e"], "t", "t", "k", "j", tolerance).collect()}
        assert got == brute_pairs(left, right, tolerance)
    assert nearest_time.pair_nearest(l.limit(0), q, ["e"], "t", "t", "k", "j", 5).count() == 0
    with pytest.raises(ValueError):
        nearest_time.pair_nearest(l, l, ["e"], "t", "t", "k", "k", 5)


def test_tie_goes_to_the_earlier(spark):
    one = spark.createDataFrame([(1, 10, 5.0)], "e int, k int, t double")
    two = spark.createDataFrame([(1, 7, 6.0), (1, 8, 4.0)], "e int, j int, t double")
    assert [tuple(x) for x in nearest_time.pair_nearest(one, two, ["e"], "t", "t", "k", "j", 1000).collect()] == [(1, 10, 8)]


@pytest.mark.parametrize("high", [False, True])
@pytest.mark.parametrize("kind", ["normal", "sorted", "skewed"])
def test_sketch_error_is_within_what_is_stated(kind, high):
    rng = np.random.default_rng(0)
    x = {"normal": rng.normal(size=200_000), "sorted": np.arange(200_000.0), "skewed": rng.pareto(1.5, 200_000)}[kind]
    sketches = []
    for part in np.array_split(x, 23):
        s = quantiles.Sketch(64, high)
        for chunk in np.array_split(part, 5):
            s.update(chunk)
        sketches.append(quantiles.Sketch.from_bytes(s.to_bytes()))
    whole = sketches[0]
    for s in sketches[1:]:
        whole.merge(s)
    assert whole.n == len(x) == sum(len(v) << h for h, v in enumerate(whole.levels))
    assert sum(map(len, whole.levels)) < 8000
    ordered = np.sort(x)
    for q in (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999):
        rank = np.searchsorted(ordered, whole.quantile([q])[0], side="right") / len(x)
        assert abs(rank - q) <= 3 * quantiles.RSE / 64 * ((1 - q) if high else q) + 2 / len(x)


def test_percentiles_of_partitions_and_loads_combine(spark):
    r = random.Random(6)
    rows = [(g, k % 5, r.gauss(g, 1)) for g in (1, 2) for k in range(4000 if g == 1 else 30)]
    rows += [(1, 0, None), (2, 0, float("nan")), (None, 0, 1.0)]
    df = spark.createDataFrame(rows, "g int, load int, v double").repartition(6)
    whole = quantiles.merged(quantiles.sketches(df, ["g"], "v"), ["g"], 6, fan_in=2)
    daily = quantiles.merged(quantiles.sketches(df, ["g", "load"], "v"), ["g", "load"], 6)
    loads = quantiles.merged(daily.withColumn("part", daily["load"].cast("bigint")).drop("load"), ["g"], 5)
    named, n = quantiles.numbered(daily.drop("part").withColumn("load", F.when(F.col("load") != 3, F.concat(F.lit("day "), F.col("load")))), "load")
    assert n == 5
    for sketch in (whole, loads, quantiles.merged(named, ["g"], n, fan_in=2)):
        got = {x["g"]: x for x in quantiles.percentiles(sketch, ["g"]).collect()}
        assert set(got) == {1, 2} and got[1]["n"] == 4000 and got[2]["n"] == 30
        assert got[2]["max_rank_error"] == 0
        for g in (1, 2):
            v = sorted(x for h, _, x in rows if h == g and x is not None and not math.isnan(x))
            for name, q in (("p05", 0.05), ("p50", 0.5), ("p99", 0.99)):
                rank = np.searchsorted(v, got[g][name], side="right") / len(v)
                assert abs(rank - q) <= got[g]["max_rank_error"] * min(q, 1 - q) + 1.01 / len(v)
    assert quantiles.percentiles(quantiles.merged(quantiles.sketches(df.limit(0), ["g"], "v"), ["g"], 1), ["g"]).count() == 0


def test_top_n_prunes_many_small_groups(spark, monkeypatch):
    monkeypatch.setattr(topn, "PRUNE_ROWS", 50)
    r = random.Random(5)
    rows = [(r.randrange(400), f"i{r.randrange(9)}", r.random()) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g int, item string, score double").coalesce(1)
    assert {tuple(x) for x in topn.top_n(df, "g", "item", "score", 2).collect()} == brute_top(rows, 2)
