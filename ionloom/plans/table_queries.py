"""Tables that views show: regions and groups, layers, correlation and Moran tables, imported datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionloom.operators import aggregates, exports, joins, ranks, spatial
from ionloom.plans import annotation_queries, ms1_queries, ms2_queries, spatial_queries
from ionloom.plans.ms1_queries import features, mapped, scans
from ionloom.session import stored
from ionloom.sources.tables import table

#: Two regions, one within the other, as a user might draw them.
REGIONS = {"organ": spatial_queries.ROI, "spot": [(3.0, 2.0), (6.0, 2.0), (6.0, 5.0), (3.0, 5.0)]}


def region_groups(spark: SparkSession, d: str) -> DataFrame:
    """Values by sample and region: a pixel in two regions counts in both, one in none is outside; zeros, not detected, are left out."""
    image = spatial_queries._image(spark, d).where("v > 0")
    names = F.filter(F.array(*[F.when(spatial.in_polygon(F.col("gx") + 0.5, F.col("gy") + 0.5, v), n) for n, v in REGIONS.items()]), lambda x: x.isNotNull())
    rows = image.select("sample_id", "v", F.explode(F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("outside")))).alias("region"))
    return rows.groupBy("sample_id", "region").agg(F.count(F.lit(1)).alias("n_pixels"), F.round(F.avg("v"), 6).alias("mean_v"), F.round(F.min("v"), 6).alias("lowest"), F.round(F.max("v"), 6).alias("highest"))


# Colours between which the ramp runs.
ANCHORS = [(0, 0, 32), (64, 16, 128), (224, 96, 64), (255, 240, 160)]


def raster_colours(spark: SparkSession, d: str) -> DataFrame:
    """Each sample's image as a raster of colours, scaled to its colour range."""
    image = spatial_queries._image(spark, d)
    scaled = image.join(aggregates.value_range(image, ["sample_id"], "v"), "sample_id")
    return exports.colourised(scaled, "v", "vmin", "vmax", exports.colour_ramp(ANCHORS)).select("sample_id", "gy", "gx", "rgba")


def obs_categories(spark: SparkSession, d: str) -> DataFrame:
    """Distinct polarities of the scans on pixels over all samples, in order."""
    on = mapped(spark, d).join(scans(spark, d).select("sample_id", "scan_id", "polarity"), ["sample_id", "scan_id"]).where("polarity is not null").select("polarity").distinct()
    # One row per category.
    return on.withColumn("place", F.row_number().over(Window.orderBy("polarity")))


def _two(matrix: DataFrame) -> list[int]:
    """The two features on most pixels: analyte and reference."""
    top = matrix.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "feature_id").limit(2).collect()
    return [r["feature_id"] for r in top]


def region_signal(spark: SparkSession, d: str) -> DataFrame:
    """Per sample the mean, over the region's pixels with a positive reference, of the analyte by the reference."""
    m = stored(ms1_queries._matrix(spark, d))
    two = _two(m)
    if len(two) < 2:
        return spark.createDataFrame([], "sample_id bigint, n_pixels bigint, ratio double")
    inside = spatial_queries._grid(spark, d).where(spatial.in_polygon(F.col("gx") + 0.5, F.col("gy") + 0.5, spatial_queries.ROI)).select("sample_id", "pixel_id")
    one = lambda f, name: m.where(F.col("feature_id") == f).select("sample_id", "pixel_id", F.col("value").alias(name))
    both = inside.join(one(two[0], "a"), ["sample_id", "pixel_id"], "left").join(one(two[1], "r"), ["sample_id", "pixel_id"], "left")
    return both.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_pixels"), F.round(F.avg(F.when(F.col("r") > 0, F.coalesce("a", F.lit(0.0)) / F.col("r"))), 6).alias("ratio"))


def feature_normalised(spark: SparkSession, d: str) -> DataFrame:
    """The matrix normalised to one feature, that on most pixels: log1p of value times median by reference, the median over all pixels that have a scan."""
    m = stored(ms1_queries._matrix(spark, d))
    two = _two(m)
    if not two:
        return m.select("sample_id", "pixel_id", "feature_id", F.col("value").alias("normalised"))
    reference = m.where(F.col("feature_id") == two[0]).select("sample_id", "pixel_id", F.col("value").alias("ref"))
    every = mapped(spark, d).select("sample_id", "pixel_id").distinct().join(reference, ["sample_id", "pixel_id"], "left").select(F.coalesce("ref", F.lit(0.0)).alias("ref"))
    # Most pixels lack any one feature here; the mean stands in where the median is 0.
    middle, mean = ranks.percentiles(every, [], "ref", [0.5]).first(), every.agg(F.avg("ref")).first()[0]
    scale = middle["q"][0] if middle["q"][0] > 0 else mean
    return m.join(reference.where("ref > 0"), ["sample_id", "pixel_id"]).select("sample_id", "pixel_id", "feature_id", F.round(F.log1p(F.col("value") * float(scale) / F.col("ref")), 6).alias("normalised"))


def correlation_table(spark: SparkSession, d: str) -> DataFrame:
    """The feature on most pixels against every other: r per sample, averaged over those that have one, best first."""
    m = stored(ms1_queries._matrix(spark, d))
    two = _two(m)
    if not two:
        return spark.createDataFrame([], "feature_id bigint, n_samples bigint, mean_r double, place int")
    n = mapped(spark, d).groupBy("sample_id").agg(F.count_distinct("pixel_id").alias("n"))
    rows = aggregates.correlation_with(m, n, ["sample_id"], "pixel_id", "feature_id", "value", two[0]).groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.avg("r"), 6).alias("mean_r"))
    return ranks.ranked(rows, [], [F.desc("mean_r"), F.asc("feature_id")], "place")


def moran_table(spark: SparkSession, d: str) -> DataFrame:
    """Moran's I per feature with a column's worth of samples: how many have one, the mean, and each sample's value as text."""
    flat = spatial_queries.feature_global_moran(spark, d).where("moran_i is not null")
    listed = F.array_sort(F.collect_list(F.struct("sample_id", "moran_i")))
    text = F.array_join(F.transform(listed, lambda x: F.concat(x["sample_id"].cast("string"), F.lit(":"), F.format_string("%.4f", x["moran_i"] + 1e-9))), " ")
    # A feature has no more values than there are samples.
    return flat.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.avg("moran_i") + 1e-9, 5).alias("mean_i"), text.alias("by_sample"))


def dataset_features(spark: SparkSession, d: str) -> DataFrame:
    """The m/z axis of an imported dataset (here that of the isotope table) with our feature within 10 ppm and its name; NULL where there is none."""
    axis = table(spark, d, "feature_isotopes").where("mz is not null").select("mz").distinct()
    names = ms2_queries.representative_annotation(spark, d).select("feature_id", "compound_name")
    near = joins.nearest_ppm(axis, features(spark, d).where("mz is not null").select(F.col("mz").alias("fmz"), "feature_id"), ["mz"], "mz", "fmz", 10.0, ["feature_id"])
    return near.join(names, "feature_id", "left").select("mz", "feature_id", "compound_name")


def tic_violins(spark: SparkSession, d: str) -> DataFrame:
    """Density of the logarithm of the total ion current per sample, at 64 points."""
    rows = scans(spark, d).where("tic > 0").select("sample_id", F.log10("tic").alias("v"))
    return aggregates.violin(rows, ["sample_id"], "v").select("sample_id", "point", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


def base_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Per sample the strongest peaks of its MS2 spectra: how many spectra have one, their median and maximum."""
    top = annotation_queries.ms2_spectra(spark, d).where("size(peaks) > 0").select("sample_id", F.array_max(F.transform("peaks", lambda x: x["i"])).alias("top"))
    middle = ranks.percentiles(top, ["sample_id"], "top", [0.5]).select("sample_id", "n", F.round(F.get("q", F.lit(0)), 4).alias("median_top"))
    return middle.join(top.groupBy("sample_id").agg(F.round(F.max("top"), 4).alias("highest")), "sample_id")


def target_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per adduct the target ions, compounds, those found, those to inject, and features that they name."""
    m = ms2_queries.target_matches(spark, d)
    found = F.col("match_type") == "existing"
    return m.groupBy("adduct").agg(F.count(F.lit(1)).alias("n_ions"), F.count_distinct("compound_id").alias("n_compounds"), F.count_if(found).alias("n_existing"), F.count_if(~found).alias("n_injected"), F.count_distinct("feature_id").alias("n_features"))


def annotation_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    """Features by how many compounds lie within 0.05 of their best score, and how many of them have the same best compound in every scan."""
    a = ms2_queries.annotations(spark, d).where("feature_id is not null and inchikey is not null").select("feature_id", "sample_id", "scan_id", "inchikey", "score")
    per = a.groupBy("feature_id", "inchikey").agg(F.max("score").alias("s"))
    best = per.groupBy("feature_id").agg(F.max("s").alias("_b"))
    near = per.join(best, "feature_id").where("s >= _b - 0.05").groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_near"))
    scan = a.groupBy("feature_id", "sample_id", "scan_id").agg(F.min_by("inchikey", F.struct(-F.col("score"), "inchikey")).alias("k")).groupBy("feature_id").agg((F.count_distinct("k") == 1).alias("agrees"))
    return near.join(scan, "feature_id").groupBy("n_near").agg(F.count(F.lit(1)).alias("n_features"), F.count_if("agrees").alias("n_agreeing"))


def feature_value_range(spark: SparkSession, d: str) -> DataFrame:
    """Per feature, pooled over samples: least and greatest detected value, and the 1st and 99th percentile."""
    m = stored(ms1_queries._matrix(spark, d).where("value > 0"))
    q = ranks.percentiles(m, ["feature_id"], "value", [0.01, 0.99])
    ends = m.groupBy("feature_id").agg(F.round(F.min("value"), 4).alias("lowest"), F.round(F.max("value"), 4).alias("highest"))
    return q.join(ends, "feature_id").select("feature_id", "n", "lowest", F.round(F.get("q", F.lit(0)), 4).alias("p01"), F.round(F.get("q", F.lit(1)), 4).alias("p99"), "highest")


def feature_overview(spark: SparkSession, d: str) -> DataFrame:
    """Every feature with its identity, its best MS2 scan, what became of its annotation and its candidates' names."""
    r = ms2_queries.representative_annotation(spark, d).select("feature_id", "mz", "compound_name", "source", "best_score")
    scan = ms2_queries.consensus_scan(spark, d).select("feature_id", F.col("id").alias("best_scan"))
    return r.join(scan, "feature_id", "left").join(ms2_queries.annotation_outcome(spark, d), "feature_id", "left").join(ms2_queries.candidate_names(spark, d), "feature_id", "left")


QUERIES = {f.__name__: f for f in (tic_violins, base_peaks, target_summary, annotation_ambiguity, feature_value_range, feature_overview, region_groups, raster_colours, obs_categories, region_signal, feature_normalised, correlation_table, moran_table, dataset_features)}


def _inside(vertices: list[tuple[float, float]]) -> str:
    parts = [f"CAST((({y1} > gy + 0.5) != ({y2} > gy + 0.5)) AND gx + 0.5 < ({x2} - {x1}) * (gy + 0.5 - {y1}) / ({y2} - {y1}) + {x1} AS INT)" for (x1, y1), (x2, y2) in zip(vertices, [*vertices[1:], vertices[0]], strict=True) if y1 != y2]
    return f"({' + '.join(parts)}) % 2 = 1"


_BASE = spatial_queries._BASE
_CHOSEN = ", ch AS (SELECT feature_id, row_number() OVER (ORDER BY count(*) DESC, feature_id) AS k FROM mx GROUP BY feature_id)"
_RAMP = "[" + ", ".join(map(str, exports.colour_ramp(ANCHORS))) + "]"
ORACLE = {
    "tic_violins": ms1_queries._BASE + """, vv AS (SELECT sample_id, log10(tic) AS v FROM s WHERE tic > 0), st AS (SELECT sample_id, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS w FROM vv GROUP BY ALL),
 hs AS (SELECT sample_id, least(511, floor((v - lo) / ((hi - lo) / 512))) AS b, count(*) AS c FROM vv JOIN st USING (sample_id) WHERE hi > lo GROUP BY ALL), gr AS (SELECT st.*, CAST(k AS INT) AS point, lo + (hi - lo) * k / 63 AS x FROM st, range(64) t(k)),
 de AS (SELECT gr.sample_id, point, any_value(x) AS x, sum(c * exp(-0.5 * pow((x - (lo + (b + 0.5) * (hi - lo) / 512)) / w, 2))) / any_value(n * w * 2.5066282746310002) AS density FROM gr JOIN hs USING (sample_id) GROUP BY ALL)
 SELECT gr.sample_id, gr.point, round(gr.x, 6) AS x, round(density, 6) AS density FROM gr LEFT JOIN de ON de.sample_id = gr.sample_id AND de.point = gr.point""",
    "base_peaks": annotation_queries._BASE + " SELECT sample_id, count(*) AS n, round(median(CAST(list_max(intensity) AS DOUBLE)), 4) AS median_top, round(max(CAST(list_max(intensity) AS DOUBLE)), 4) AS highest FROM sp WHERE len(intensity) > 0 GROUP BY ALL",
    "target_summary": f"SELECT adduct, count(*) AS n_ions, count(DISTINCT compound_id) AS n_compounds, count(*) FILTER (match_type = 'existing') AS n_existing, count(*) FILTER (match_type = 'injected') AS n_injected, count(DISTINCT feature_id) AS n_features FROM ({ms2_queries.ORACLE['target_matches']}) GROUP BY ALL",
    "annotation_ambiguity": _BASE + """, pe AS (SELECT feature_id, inchikey, max(score) AS s FROM n WHERE feature_id IS NOT NULL AND inchikey IS NOT NULL GROUP BY ALL), ne AS (SELECT feature_id, count(*) AS n_near FROM (SELECT *, max(s) OVER (PARTITION BY feature_id) AS b FROM pe) WHERE s >= b - 0.05 GROUP BY ALL),
 sk AS (SELECT feature_id, inchikey FROM (SELECT *, row_number() OVER (PARTITION BY feature_id, sample_id, scan_id ORDER BY score DESC, inchikey) AS rk FROM n WHERE feature_id IS NOT NULL AND inchikey IS NOT NULL) WHERE rk = 1), ag AS (SELECT feature_id, count(DISTINCT inchikey) = 1 AS agrees FROM sk GROUP BY ALL)
 SELECT n_near, count(*) AS n_features, count(*) FILTER (agrees) AS n_agreeing FROM ne JOIN ag USING (feature_id) GROUP BY ALL""",
    "feature_value_range": _BASE + " SELECT feature_id, count(*) AS n, round(min(value), 4) AS lowest, round(quantile_cont(value, 0.01), 4) AS p01, round(quantile_cont(value, 0.99), 4) AS p99, round(max(value), 4) AS highest FROM mx WHERE value > 0 GROUP BY ALL",
    "feature_overview": f"SELECT r.feature_id, mz, compound_name, source, best_score, c.id AS best_scan, outcome, names FROM ({ms2_queries.ORACLE['representative_annotation']}) r LEFT JOIN ({ms2_queries.ORACLE['consensus_scan']}) c ON c.feature_id = r.feature_id LEFT JOIN ({ms2_queries.ORACLE['annotation_outcome']}) o ON o.feature_id = r.feature_id LEFT JOIN ({ms2_queries.ORACLE['candidate_names']}) k ON k.feature_id = r.feature_id",
    "raster_colours": _BASE + f""", l AS (SELECT sample_id, min(v) AS vmin FROM im GROUP BY ALL), h AS (SELECT sample_id, quantile_cont(v, 0.995) AS hi FROM im JOIN l USING (sample_id) WHERE v > vmin GROUP BY ALL)
 SELECT sample_id, gy, gx, CAST(({_RAMP})[1 + CAST(floor(greatest(0, least(1, (v - vmin) / (coalesce(hi, vmin + 1) - vmin))) * 255 + 0.5) AS INT)] AS BIGINT) * 256 + 255 AS rgba FROM im JOIN l USING (sample_id) LEFT JOIN h USING (sample_id)""",
    "region_groups": _BASE + f""", rg AS (SELECT sample_id, v, {_inside(REGIONS['organ'])} AS organ, {_inside(REGIONS['spot'])} AS spot FROM im WHERE v > 0),
 rr AS (SELECT sample_id, v, 'organ' AS region FROM rg WHERE organ UNION ALL SELECT sample_id, v, 'spot' FROM rg WHERE spot UNION ALL SELECT sample_id, v, 'outside' FROM rg WHERE NOT organ AND NOT spot)
 SELECT sample_id, region, count(*) AS n_pixels, round(avg(v), 6) AS mean_v, round(min(v), 6) AS lowest, round(max(v), 6) AS highest FROM rr GROUP BY ALL""",
    "obs_categories": _BASE + " SELECT polarity, CAST(row_number() OVER (ORDER BY polarity) AS INT) AS place FROM (SELECT DISTINCT polarity FROM mp JOIN s USING (sample_id, scan_id) WHERE polarity IS NOT NULL)",
    "region_signal": _BASE + _CHOSEN + f""", a1 AS (SELECT mx.* FROM mx JOIN ch ON ch.feature_id = mx.feature_id AND k = 1), r1 AS (SELECT mx.* FROM mx JOIN ch ON ch.feature_id = mx.feature_id AND k = 2)
 SELECT g.sample_id, count(*) AS n_pixels, round(avg(CASE WHEN r1.value > 0 THEN coalesce(a1.value, 0) / r1.value END), 6) AS ratio FROM g LEFT JOIN a1 USING (sample_id, pixel_id) LEFT JOIN r1 ON r1.sample_id = g.sample_id AND r1.pixel_id = g.pixel_id WHERE {_inside(spatial_queries.ROI)} GROUP BY g.sample_id""",
    "feature_normalised": _BASE + _CHOSEN + """, r1 AS (SELECT mx.* FROM mx JOIN ch ON ch.feature_id = mx.feature_id AND k = 1), ev AS (SELECT coalesce(value, 0) AS ref FROM (SELECT DISTINCT sample_id, pixel_id FROM mp) p LEFT JOIN r1 USING (sample_id, pixel_id)),
 sc AS (SELECT CASE WHEN median(ref) > 0 THEN median(ref) ELSE avg(ref) END AS scale FROM ev) SELECT mx.sample_id, mx.pixel_id, mx.feature_id, round(ln(1 + mx.value * scale / r1.value), 6) AS normalised FROM mx JOIN r1 ON r1.sample_id = mx.sample_id AND r1.pixel_id = mx.pixel_id AND r1.value > 0, sc""",
    "correlation_table": _BASE + _CHOSEN + """, np AS (SELECT sample_id, count(DISTINCT pixel_id) AS n FROM mp GROUP BY ALL),
 st AS (SELECT sample_id, feature_id, sum(value) / any_value(n) AS mean, sum(value * value) / any_value(n) AS ms, any_value(n) AS n FROM mx JOIN np USING (sample_id) GROUP BY ALL), va AS (SELECT *, ms - mean * mean AS var FROM st WHERE ms - mean * mean > 1e-12 * ms),
 cr AS (SELECT b.sample_id, b.feature_id, sum(a.value * b.value) AS s FROM mx a JOIN ch ON ch.feature_id = a.feature_id AND k = 1 JOIN mx b ON b.sample_id = a.sample_id AND b.pixel_id = a.pixel_id GROUP BY ALL),
 rr AS (SELECT b.feature_id, least(1, greatest(-1, (coalesce(s, 0) / a.n - a.mean * b.mean) / sqrt(a.var * b.var))) AS r FROM va a JOIN ch ON ch.feature_id = a.feature_id AND k = 1 JOIN va b ON b.sample_id = a.sample_id AND b.feature_id != a.feature_id LEFT JOIN cr ON cr.sample_id = b.sample_id AND cr.feature_id = b.feature_id),
 av AS (SELECT feature_id, count(*) AS n_samples, round(avg(r), 6) AS mean_r FROM rr GROUP BY ALL) SELECT *, CAST(row_number() OVER (ORDER BY mean_r DESC, feature_id) AS INT) AS place FROM av""",
    "moran_table": spatial_queries.ORACLE["feature_global_moran"].replace(" SELECT sample_id, feature_id, CASE WHEN m2 > 0", ", gm AS (SELECT sample_id, feature_id, CASE WHEN m2 > 0") + """)
 SELECT feature_id, count(*) AS n_samples, round(avg(moran_i) + 1e-9, 5) AS mean_i, string_agg(sample_id || ':' || printf('%.4f', moran_i + 1e-9), ' ' ORDER BY sample_id) AS by_sample FROM gm WHERE moran_i IS NOT NULL GROUP BY ALL""",
    "dataset_features": _BASE + """, ax AS (SELECT DISTINCT mz FROM feature_isotopes WHERE mz IS NOT NULL), nr AS (SELECT ax.mz, feature_id, row_number() OVER (PARTITION BY ax.mz ORDER BY abs((ax.mz - f.mz) / f.mz), f.mz, feature_id) AS rn FROM ax JOIN f ON ax.mz BETWEEN f.mz - f.mz * 1e-5 AND f.mz + f.mz * 1e-5)
 SELECT ax.mz, nr.feature_id, compound_name FROM ax LEFT JOIN nr ON nr.mz = ax.mz AND rn = 1 LEFT JOIN rep ON rep.feature_id = nr.feature_id""",
}
