import math
import random

from ionloom.operators import intervals

SCHEMA = "e int, a double, b double, t_start double"


def brute(rows):
    by, gaps, periods = {}, set(), set()
    for e, a, b in rows:
        if None in (e, a, b) or math.isnan(a) or math.isnan(b) or b < a or math.isinf(b) or math.isinf(a):
            continue
        by.setdefault(e, []).append((round(a * 1000), round(b * 1000)))
    for e, spans in by.items():
        begin = end = None
        for s, t in sorted(spans):
            if begin is None:
                begin, end = s, t
            elif s > end:
                gaps.add((e, end, s))
                periods.add((e, begin, end))
                begin, end = s, t
            else:
                end = max(end, t)
        periods.add((e, begin, end))
    return gaps, periods


def check(spark, rows, width):
    df = spark.createDataFrame([(*r, 1.0) for r in rows], SCHEMA)  # a further column with a common name
    d = intervals.valid_dwells(df, ["e"], "a", "b", 1000)
    gaps, periods = brute(rows)
    assert sorted(map(tuple, intervals.gaps(d, ["e"], width).collect())) == sorted(gaps)
    assert sorted(map(tuple, intervals.periods(d, ["e"], width).collect())) == sorted(periods)


def test_random_intervals_meet_brute_force(spark):
    r = random.Random(5)
    rows = []
    for _ in range(600):
        a = r.randrange(0, 4000) / 100
        rows.append((r.randrange(4), a, a + r.choice([0, 0.01, 0.2, 1.5, 9.0])))
    rows += rows[:50]
    for width in (100, 1000, 300_000):
        check(spark, rows, width)


def test_long_interval_bridges_shards_and_hides_inner_gaps(spark):
    check(spark, [(1, 0.0, 10.0), (1, 2.1, 2.2), (1, 2.5, 2.6), (1, 12.0, 13.0)], 500)


def test_nulls_nan_wrong_order_infinite_touching_and_point(spark):
    nan = float("nan")
    check(spark, [(1, None, 2.0), (None, 1.0, 2.0), (1, nan, 2.0), (1, 1.0, nan), (1, 3.0, 1.0), (1, 0.0, float("inf")), (1, 5.0, 6.0), (1, 6.0, 7.0), (1, 8.0, 8.0), (1, -3.0, -2.5)], 1000)


def test_empty(spark):
    check(spark, [], 1000)
