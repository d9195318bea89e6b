from pyspark.sql import functions as F

from ionloom.operators import references


def test_missing_null_repeated_and_clashing(spark):
    child = spark.createDataFrame([(1, 10, {"a": 1}), (2, 11, None), (3, None, None), (4, 11, None), (4, 11, None), (5, 12, None)], "id int, ref int, note map<string,int>")
    parent = spark.createDataFrame([(10, 1), (10, 1), (None, 1), (12, 2)], "ref int, id int")
    assert {tuple(r) for r in references.missing_keys(child, ["ref"], parent, ["ref"]).collect()} == {(11, 3)}
    rows = references.orphan_rows(child, ["ref"], parent, ["ref"])
    assert sorted(r["id"] for r in rows.collect()) == [2, 4, 4]
    report = references.by_period(rows.withColumn("at", F.lit("2025-01")), [], F.col("at"), "ref").collect()
    assert [tuple(r) for r in report] == [("2025-01", 3, 1)]


def test_two_part_keys_and_empty_tables(spark):
    child = spark.createDataFrame([(1, 1), (1, None), (2, 1)], "s int, k int")
    parent = spark.createDataFrame([(2, 1)], "sample int, scan int")
    assert [tuple(r) for r in references.orphan_rows(child, ["s", "k"], parent, ["sample", "scan"]).collect()] == [(1, 1)]
    assert references.orphan_rows(child.limit(0), ["s", "k"], parent, ["sample", "scan"]).count() == 0
    assert references.orphan_rows(child, ["s", "k"], parent.limit(0), ["sample", "scan"]).count() == 2
