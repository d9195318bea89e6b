import datetime as dt

import pytest

from ionloom.operators import wide
from ionloom.operators.wide import Attribute

ATTRS = [
    Attribute("size", "double", "um", {"um": 1.0, "µm": 1.0, "mm": 1000.0}, ("raster_step",)),
    Attribute("count", "int"),
    Attribute("on", "boolean"),
    Attribute("start", "timestamp", None, {}, ("run started",)),
    Attribute("tissue", "string"),
]


def run(spark, rows, segment=2):
    df = spark.createDataFrame(rows, "sample_id bigint, key string, value string")
    out = wide.stitch(df, ATTRS, "sample_id", "key", "value", segment)
    return {r["sample_id"]: r for r in out.collect()}, {tuple(r) for r in wide.issues(out, ATTRS, "sample_id").collect()}


def test_typed_values_spellings_and_issues(spark):
    utc = dt.datetime(2025, 1, 21, 7, 18, 54)
    rows, issues = run(
        spark,
        [
            (1, " Raster-Step:", "0,05 mm"), (1, "SIZE", "50 um"), (1, "count", "46 573"), (1, "Count", "4.657300e+04"), (1, "on", "Yes"), (1, "start", "21.01.2025 07:18:54"), (1, "RunStarted", "2025-01-21T09:18:54+02:00"), (1, "tissue", " Liver "), (1, "tissue", "LIVER"),
            (2, "size", "five um"), (2, "size", "n/a"), (2, "count", "12.5"), (2, "on", "maybe"), (2, "start", "2025-02-30T08:15:00Z"), (2, "tissue", "unknown"),
            (3, "size", "1 um"), (3, "size", "1.01 um"), (3, "count", "1,000"), (3, "count", "1001"), (3, "on", "1"), (3, "on", "off"), (3, "tissue", "a"), (3, "tissue", "b"),
            (4, "other", "x"), (5, None, "x"), (6, "size", None), (None, "size", "1"), (7, "size", "1..5"), (7, "size", "3 um"), (7, "count", "7"), (7, "count", "7"),
        ],
    )
    assert set(rows) == {1, 2, 3, 4, 5, 6, 7}
    one = rows[1]
    assert one["size"] == pytest.approx(50.0) and one["count"] == 46573 and one["on"] is True and one["tissue"] == "LIVER"
    assert one["start"] == utc or one["start"].replace(tzinfo=None) == utc
    assert rows[7]["size"] == 3.0 and rows[7]["count"] == 7
    assert all(rows[k][a.name] is None for k in (4, 5, 6) for a in ATTRS)
    assert issues == {(2, "size", "unreadable"), (2, "count", "unreadable"), (2, "on", "unreadable"), (2, "start", "unreadable"), (3, "size", "conflict"), (3, "count", "conflict"), (3, "on", "conflict"), (3, "tissue", "conflict")}


def test_many_segments_keep_positions(spark):
    rows, _ = run(spark, [(i, "count", str(i * 3)) for i in range(0, 400, 2)] + [(i, "tissue", f"t{i}") for i in range(0, 400, 5)], 16)
    assert len(rows) == 240
    assert all(r["count"] == (k * 3 if k % 2 == 0 else None) and r["tissue"] == (f"t{k}" if k % 5 == 0 else None) for k, r in rows.items())


def test_ordinals_are_dense_and_in_order(spark):
    df = spark.createDataFrame([(x * 7 % 101,) for x in range(300)] + [(None,)], "e int")
    got = sorted(map(tuple, wide.ordinals(df, "e").collect()))
    assert got == [(e, e) for e in range(101)]


def test_empty_and_clash(spark):
    rows, issues = run(spark, [])
    assert rows == {} and issues == set()
    with pytest.raises(ValueError):
        wide.stitch(spark.createDataFrame([], "size bigint, key string, value string"), ATTRS, "size", "key", "value")


def test_ambiguous_name_means_neither(spark):
    attrs = [Attribute("a", "string", aliases=("x",)), Attribute("b", "string", aliases=("X",))]
    df = spark.createDataFrame([(1, "x", "v"), (1, "b", "w")], "e bigint, key string, value string")
    r = wide.stitch(df, attrs, "e", "key", "value").first()
    assert r["a"] is None and r["b"] == "w"
