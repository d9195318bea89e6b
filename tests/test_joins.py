import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ionloom.operators import joins

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
mzs = st.lists(st.one_of(st.none(), st.floats(50, 51, allow_nan=False), st.just(float("nan"))), max_size=12)
times = st.lists(st.one_of(st.none(), st.integers(0, 60).map(lambda x: x / 4)), max_size=14)


def real(x):
    return x is not None and not math.isnan(x)


def rows(spark, values, name):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"{name}_id int, {name} double")


@FEW
@given(a=mzs, b=mzs)
def test_ppm_join(spark, a, b):
    got = {(r["l_id"], r["r_id"]) for r in joins.ppm_join(rows(spark, a, "l"), rows(spark, b, "r"), "l", "r", 3000.0).collect()}
    assert got == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if real(x) and real(y) and y - y * 0.003 <= x <= y + y * 0.003}


@FEW
@given(a=mzs, b=mzs)
def test_nearest_ppm_keeps_every_left_row(spark, a, b):
    got = sorted((r["l_id"], r["r_id"]) for r in joins.nearest_ppm(rows(spark, a, "l"), rows(spark, b, "r"), ["l_id"], "l", "r", 3000.0, ["r_id"]).collect())
    want = []
    for i, x in enumerate(a):
        near = [(abs((x - y) / y), y, j) for j, y in enumerate(b) if real(x) and real(y) and y - y * 0.003 <= x <= y + y * 0.003]
        want.append((i, min(near)[2] if near else None))
    assert got == sorted(want)


@FEW
@given(points=times, spans=st.lists(st.tuples(st.integers(0, 40), st.integers(-3, 30)), max_size=8))
def test_interval_join(spark, points, spans):
    s = spark.createDataFrame([(i, a / 4, (a + w) / 4, 0) for i, (a, w) in enumerate(spans)], "s_id int, lo double, hi double, p_id int")
    got = sorted((r["p_id"], r["s_id"]) for r in joins.interval_join(rows(spark, points, "p"), s, "p", "lo", "hi", width=2.0).collect())
    assert got == sorted((i, j) for i, x in enumerate(points) if x is not None for j, (a, w) in enumerate(spans) if a / 4 <= x <= (a + w) / 4)


@FEW
@given(left=times, right=times)
def test_asof_and_nearest(spark, left, right):
    l, r = rows(spark, left, "l"), rows(spark, right, "r")  # noqa: E741
    back = {x["l_id"]: x["r_id"] for x in joins.asof(l, r, "l", "r", "r_id", width=3.0).collect()}
    ahead = {x["l_id"]: x["r_id"] for x in joins.asof(l, r, "l", "r", "r_id", direction="forward", width=3.0).collect()}
    near = {x["l_id"]: x["r_id"] for x in joins.nearest(l, r, "l", "r", "r_id", width=3.0).collect()}
    known = [(y, j) for j, y in enumerate(right) if y is not None]
    assert len(back) == len(ahead) == len(near) == len(left)
    for i, x in enumerate(left):
        before = [(y, j) for y, j in known if x is not None and y <= x]
        after = [(y, j) for y, j in known if x is not None and y >= x]
        assert back[i] == (max(before)[1] if before else None)
        assert ahead[i] == (min(after)[1] if after else None)
        if x is not None:
            assert near[i] == (min((abs(x - y), y, j) for y, j in known)[2] if known else None)


def test_keys_and_fixture_cases(spark):
    scans = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "scan_id int, rt double")
    pixels = spark.createDataFrame([(1, 0.5, 2.5), (2, 2.6, 4.5)], "pixel_id int, a double, b double")
    got = sorted((r["pixel_id"], r["scan_id"]) for r in joins.interval_join(scans, pixels, "rt", "a", "b").collect())
    assert got == [(1, 1), (1, 2), (2, 3), (2, 4)]
    assert joins.interval_join(scans, pixels.limit(0), "rt", "a", "b").count() == 0
    keyed = joins.asof(spark.createDataFrame([("a", 5.0), ("b", 5.0), (None, 5.0)], "k string, t double"), spark.createDataFrame([("a", 4.0, 1)], "k string, u double, v int"), "t", "u", "v", ["k"])
    assert {(r["k"], r["v"]) for r in keyed.collect()} == {("a", 1), ("b", None), (None, None)}
