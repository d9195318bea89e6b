import pytest

from ionloom.plans import spatial_queries

D = 1.0033548
PIXELS = 60_000


@pytest.fixture
def small_broadcasts(spark):
    """No table of more than 8 MB in memory (an empty one may take 4) may be sent to all tasks."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", str(8 << 20))
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_links_of_a_large_image_without_large_broadcasts(spark, small_broadcasts, tmp_path):
    """One sample of many pixels, whose files are far below the size at which Spark broadcasts a file: 2 and 3 are the isotopes of 1; 4 is at the distance from 3 but is seen on two pixels only; 5 and 6 are at the distance, on two pixels."""
    d = str(tmp_path)
    mz = {1: 300.0, 2: 300.0 + D, 3: 300.0 + 2 * D, 4: 300.0 + 3 * D, 5: 500.0, 6: 500.0 + D}
    height = {1: 100.0, 2: 15.0, 3: 2.0, 4: 1.0, 5: 10.0, 6: 1.0}
    at = "timestamp'2024-01-01' AS loaded_at"
    some = "id < 2 AND id >= 0"
    masses = ", ".join(f"CAST({mz[k]!r} AS FLOAT)" for k in (1, 2, 3))
    more = ", ".join(f"CAST({mz[k]!r} AS FLOAT)" for k in (4, 5, 6))
    heights, high = (", ".join(f"CAST({height[k]!r} * (1 + id % 7) AS FLOAT)" for k in ks) for ks in ((1, 2, 3), (4, 5, 6)))
    scans = spark.range(PIXELS).selectExpr("1L AS sample_id", "id AS scan_id", "CAST(id AS DOUBLE) AS rt", "3 AS n_peaks", "1D AS tic", "'+' AS polarity", f"IF({some}, array({masses}, {more}), array({masses})) AS mz", f"IF({some}, array({heights}, {high}), array({heights})) AS intensity", at)
    scans.write.parquet(f"{d}/ms1_scans.parquet")
    spark.range(PIXELS).selectExpr("1L AS sample_id", "id AS pixel_id", "id AS scan_id", at).write.parquet(f"{d}/pixel_ms1_scans.parquet")
    spark.createDataFrame(list(mz.items()), "feature_id long, mz double").selectExpr("*", at).write.parquet(f"{d}/features.parquet")
    got = {(r["mono_id"], r["isotope_id"]): r for r in spatial_queries.isotope_links(spark, d).collect()}
    assert {k: (r["k"], r["ratio"], r["corr"]) for k, r in got.items()} == {(1, 2): (1, 0.15, 1.0), (1, 3): (2, 0.02, 1.0)}
