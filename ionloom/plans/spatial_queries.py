"""Pixel grids, spatial statistics, regions, report aggregates and small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionloom.functions import chemistry, search
from ionloom.operators import aggregates, isotopes, joins, ranks, spatial
from ionloom.operators.lifecycle import latest, move_rows
from ionloom.plans import ms1_queries, ms2_queries
from ionloom.plans.ms1_queries import features, mapped, scans
from ionloom.plans.ms2_queries import annotations, associations
from ionloom.session import cut, stored
from ionloom.sources.tables import table

#: A region in grid coordinates, as a user might draw it.
ROI = [(1.5, 0.5), (8.5, 1.0), (7.0, 7.5), (2.0, 6.0)]
#: A placement of the grid on another image.
PLACED = (2.0, 0.5, 10.0, -0.25, 1.5, 3.0)


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """One row per pixel: a pixel has one place, whichever dwell tells it."""
    p = table(spark, d, "spatial_pixels").where("x is not null and y is not null").groupBy("sample_id", "pixel_id").agg(F.min(F.struct("x", "y")).alias("p"))
    return p.select("sample_id", "pixel_id", "p.x", "p.y")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return spatial.grid_indices(pixels(spark, d), ["sample_id"])


def _image(spark: SparkSession, d: str) -> DataFrame:
    """Every pixel with the mean top intensity of its scans, 0 where there is none."""
    top = scans(spark, d).select("sample_id", "scan_id", F.log1p(F.array_max("intensity").cast("double")).alias("v"))
    v = mapped(spark, d).join(top, ["sample_id", "scan_id"]).groupBy("sample_id", "pixel_id").agg(F.avg("v").alias("v"))
    return _grid(spark, d).join(v, ["sample_id", "pixel_id"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def grid_indices(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select("sample_id", "pixel_id", "gx", "gy")


def neighbour_counts(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of each pixel: sharing a side, and within a radius of two."""
    g = _grid(spark, d)
    rook = spatial.neighbours(g, ["sample_id"], "pixel_id", rook=True).groupBy("sample_id", F.col("src").alias("pixel_id")).agg(F.count(F.lit(1)).alias("n_rook"))
    wide = spatial.neighbours(g, ["sample_id"], "pixel_id", radius=2).groupBy("sample_id", F.col("src").alias("pixel_id")).agg(F.count(F.lit(1)).alias("n_radius_2"))
    return wide.join(rook, ["sample_id", "pixel_id"], "left").withColumn("n_rook", F.coalesce("n_rook", F.lit(0).cast("bigint")))


def fill_blanks(spark: SparkSession, d: str) -> DataFrame:
    """Blank pixels filled from their neighbours."""
    g = _grid(spark, d)
    edges = spatial.neighbours(g, ["sample_id"], "pixel_id", radius=1)
    filled = spatial.fill_blanks(_image(spark, d).select("sample_id", "pixel_id", "v"), edges, ["sample_id"], "pixel_id", [], "v", 0.6)
    return filled.where("filled").select("sample_id", "pixel_id", F.round("v", 6).alias("v"))


def local_moran(spark: SparkSession, d: str) -> DataFrame:
    edges = spatial.neighbours(_grid(spark, d), ["sample_id"], "pixel_id", rook=True)
    return spatial.local_moran(_image(spark, d), edges, ["sample_id"], "pixel_id", "v").select("sample_id", "pixel_id", F.round("local_i", 6).alias("local_i"))


def global_moran(spark: SparkSession, d: str) -> DataFrame:
    edges = spatial.neighbours(_grid(spark, d), ["sample_id"], "pixel_id", rook=True)
    return spatial.global_moran(_image(spark, d), edges, ["sample_id"], "pixel_id", "v").select("sample_id", F.round("moran_i", 6).alias("moran_i"), "n_pixels")


def moran_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Pixels whose local I exceeds each of 121 thresholds."""
    edges = spatial.neighbours(_grid(spark, d), ["sample_id"], "pixel_id", rook=True)
    i = spatial.local_moran(_image(spark, d), edges, ["sample_id"], "pixel_id", "v")
    return spatial.above_thresholds(i, ["sample_id"], "local_i").select("sample_id", "threshold_index", "n_above", "n_finite", F.round(100.0 * F.col("n_above") / F.col("n_finite"), 6).alias("pct"))


def _images(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Touched pixels and images of every feature (see spatial.image_moran), with the pixels and the edges."""
    g = cut(_grid(spark, d).select("sample_id", "pixel_id", "gx", "gy"))
    edges = cut(spatial.neighbours(g, ["sample_id"], "pixel_id", rook=True))
    # Named many times in the plan, and small beside the scans: worked out once.
    m = cut(ms1_queries._matrix(spark, d))
    return *spatial.image_moran(m, g, edges, ["sample_id"], "pixel_id", "feature_id", "value"), g, edges


def feature_fill_blanks(spark: SparkSession, d: str) -> DataFrame:
    """Blank pixels of each feature's image filled from their neighbours."""
    g = _grid(spark, d)
    edges = spatial.neighbours(g, ["sample_id"], "pixel_id", radius=1)
    m = ms1_queries._matrix(spark, d).join(g.select("sample_id", "pixel_id"), ["sample_id", "pixel_id"], "left_semi")
    filled = spatial.fill_blanks(m, edges, ["sample_id"], "pixel_id", ["feature_id"], "value", 0.6)
    return filled.where("filled").select("sample_id", "feature_id", "pixel_id", F.round("value", 4).alias("value"))


def feature_local_moran(spark: SparkSession, d: str) -> DataFrame:
    """Local I of every pixel of each feature found in a sample."""
    touched, images, g, edges = _images(spark, d)
    return spatial.image_local(touched, images, g, edges, ["sample_id"], "pixel_id", "feature_id").select("sample_id", "feature_id", "pixel_id", F.round(F.col("local_i") + 1e-9, 6).alias("local_i"))


def feature_global_moran(spark: SparkSession, d: str) -> DataFrame:
    touched, images, _, _ = _images(spark, d)
    return spatial.image_global(touched, images, ["sample_id"], "feature_id").select("sample_id", "feature_id", F.round("moran_i", 6).alias("moran_i"), "n_pixels")


def feature_moran_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of each feature whose local I exceeds each of 121 thresholds."""
    touched, images, _, _ = _images(spark, d)
    rows = touched.select("sample_id", "feature_id", "local_i", F.lit(1).cast("bigint").alias("n")).unionByName(images.where("n_rest > 0").select("sample_id", "feature_id", F.col("rest_i").alias("local_i"), F.col("n_rest").alias("n")))
    return spatial.above_thresholds(rows, ["sample_id", "feature_id"], "local_i", weight="n").select("sample_id", "feature_id", "threshold_index", "n_above", "n_finite", F.round(100.0 * F.col("n_above") / F.col("n_finite"), 6).alias("pct"))


def roi_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Pixels and mean value inside and outside a region."""
    image = _image(spark, d)
    inside = spatial.in_polygon(F.col("gx") + 0.5, F.col("gy") + 0.5, ROI)
    return image.groupBy("sample_id", F.when(inside, "roi").otherwise("outside").alias("region")).agg(F.count(F.lit(1)).alias("n_pixels"), F.round(F.avg("v"), 6).alias("mean_v"))


def top_by_tic(spark: SparkSession, d: str) -> DataFrame:
    """Mean over a sample's scans of the strongest peak by the total ion current, where that is positive."""
    s = scans(spark, d).select("sample_id", "scan_id", F.col("tic").alias("reference"), F.array_max("intensity").cast("double").alias("analyte"))
    return s.where("reference > 0 and analyte is not null").groupBy("sample_id").agg(F.round(F.avg(F.col("analyte") / F.col("reference")), 6).alias("ratio"), F.count(F.lit(1)).alias("n"))


def placed_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels on another image, and back again."""
    g = _grid(spark, d)
    u, v = spatial.affine(PLACED, F.col("gx"), F.col("gy"))
    back = spatial.affine(spatial.invert_affine(PLACED), u, v)
    return g.select("sample_id", "pixel_id", u.alias("u"), v.alias("v"), F.round(F.hypot(back[0] - F.col("gx"), back[1] - F.col("gy")), 6).alias("error"))


def overlap_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Features per distinct set of samples that hold them."""
    f = features(spark, d).where("members is not null")
    present = F.array_sort(F.map_keys(F.map_filter("members", lambda k, v: v.isNotNull())))
    return f.groupBy(F.array_join(present, "|").alias("samples")).agg(F.count(F.lit(1)).alias("n_features"))


def feature_membership(spark: SparkSession, d: str) -> DataFrame:
    """Features per sample in which they are members, and the mean member index."""
    m = features(spark, d).select("feature_id", F.explode("members").alias("sample", "idx")).where("idx is not null")
    return m.groupBy("sample").agg(F.count(F.lit(1)).alias("n_features"), F.round(F.avg("idx"), 6).alias("mean_index"))


def sample_counts(spark: SparkSession, d: str) -> DataFrame:
    """Scans, MS2 scans, pixels and peaks per sample."""
    one = scans(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_ms1"), F.sum(F.size("mz")).cast("bigint").alias("n_peaks"))
    two = associations(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_ms2"))
    pix = pixels(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_pixels"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return one.join(two, "sample_id", "full").join(pix, "sample_id", "full").select("sample_id", *[zero(c) for c in ("n_ms1", "n_peaks", "n_ms2", "n_pixels")])


def ms2_totals(spark: SparkSession, d: str) -> DataFrame:
    """Associated and unassociated MS2 scans per sample, with a total row (NULL sample)."""
    a = associations(spark, d)
    return a.rollup("sample_id").agg(F.count_if(F.col("feature_id").isNotNull()).alias("n_associated"), F.count_if(F.col("feature_id").isNull()).alias("n_unassociated"), F.count_if(F.col("fragmentation_factor") < 0.2).alias("n_low_factor"))


def isotope_summary(spark: SparkSession, d: str) -> DataFrame:
    i = latest(table(spark, d, "feature_isotopes"), ["feature_id"], ["loaded_at"])
    key = ["isotope_index", "charge"]
    out = i.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    for value, name in (("intensity_ratio", "median_ratio"), ("spatial_corr", "median_corr")):
        middle = ranks.percentiles(i, key, value, [0.5]).select(*[F.col(c).alias(f"_{c}") for c in key], F.round(F.get("q", F.lit(0)), 6).alias(name))
        out = out.join(middle, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left").drop(*[f"_{c}" for c in key])
    return out


def headline_counts(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d).agg(F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("origin") == "injected").alias("n_injected"))
    a = annotations(spark, d).agg(F.count_distinct("feature_id").alias("n_annotated"), F.count_distinct("inchikey").alias("n_compounds"), F.count_distinct("library_id").alias("n_libraries"))
    return f.crossJoin(a)


def isotope_votes(spark: SparkSession, d: str) -> DataFrame:
    """Isotopes accepted by the votes of samples; links come from the ion images of the features that are members of a sample."""
    # A member's key holds its sample's number (slide_00012_pos).
    present = features(spark, d).select("feature_id", F.explode("members").alias("sample", "idx")).where("idx is not null").select("feature_id", F.regexp_extract("sample", "[0-9]+", 0).cast("bigint").alias("sample_id")).distinct()
    # Only members of a pair at isotope distance can be linked, so only these need images.
    pairs = ms1_queries.isotope_candidates(spark, d).select("mono_id", "isotope_id").distinct()
    both = pairs.join(present.withColumnRenamed("feature_id", "mono_id"), "mono_id").join(present.withColumnRenamed("feature_id", "isotope_id"), ["isotope_id", "sample_id"])
    # The links' and the vote's plans name their inputs many times: each is worked out once.
    held = cut(both.select("sample_id", F.explode(F.array("mono_id", "isotope_id")).alias("feature_id")).distinct())
    f = features(spark, d).where("mz is not null").join(held.select("feature_id").distinct(), "feature_id", "left_semi")
    values = aggregates.quantify(scans(spark, d), f, ["sample_id"], "scan_id", "feature_id", "mz", 5.0).join(held, ["sample_id", "feature_id"], "left_semi")
    matrix = cut(aggregates.pixel_matrix(values, mapped(spark, d), ["sample_id"], "scan_id", "pixel_id", "feature_id"))
    n = mapped(spark, d).groupBy("sample_id").agg(F.count_distinct("pixel_id").alias("n"))
    links = cut(isotopes.link_isotopes(f, matrix, n, "sample_id", "pixel_id", "feature_id", "mz", "value"))
    return aggregates.isotope_vote(links, present, ms2_queries.protected_features(spark, d), "sample_id")


def isotope_links(spark: SparkSession, d: str) -> DataFrame:
    """Isotopes linked within each sample from the images of all features, before any vote."""
    f = features(spark, d).where("mz is not null").select("feature_id", "mz")
    n = mapped(spark, d).groupBy("sample_id").agg(F.count_distinct("pixel_id").alias("n"))
    # Merged, as in the operator: the files of scans on pixels and of features are far smaller than their rows. Scans take
    # their pixels along, so that what is found of a feature moves once, to where its image is made and counted.
    on = scans(spark, d).hint("merge").join(mapped(spark, d), ["sample_id", "scan_id"])
    peaks = on.select("sample_id", "scan_id", "pixel_id", F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select("sample_id", "scan_id", "pixel_id", F.col("p.mz").cast("double").alias("_m"), F.col("p.intensity").cast("double").alias("_i")).where("_i > 0")
    found = joins.ppm_join(peaks.hint("merge"), f.select("feature_id", F.col("mz").alias("_t")), "_m", "_t", 5.0).select("sample_id", "scan_id", "pixel_id", "feature_id", "_i").repartition("sample_id", "feature_id")
    values = found.groupBy("sample_id", "pixel_id", "scan_id", "feature_id").agg(F.max("_i").alias("value"))
    matrix = values.groupBy("sample_id", "pixel_id", "feature_id").agg(F.avg("value").alias("value"))
    matrix = stored(matrix.withColumn("n_pixels", F.count(F.lit(1)).over(Window.partitionBy("sample_id", "feature_id"))))
    links = isotopes.link_isotopes(f, matrix, n, "sample_id", "pixel_id", "feature_id", "mz", "value", image_pixels="n_pixels")
    return links.select("sample_id", "mono_id", "isotope_id", "k", "z", F.round("ratio", 6).alias("ratio"), F.round("corr", 6).alias("corr"))


def features_after_isotopes(spark: SparkSession, d: str) -> DataFrame:
    """Features that stay once the isotopes accepted by the vote are moved out."""
    iso = isotope_votes(spark, d).select(F.col("isotope_id").alias("feature_id")).distinct()
    stay, _ = move_rows(features(spark, d).select("feature_id", "mz"), iso, ["feature_id"])
    return stay


def adduct_table(spark: SparkSession, d: str) -> DataFrame:
    """m/z of a compound's ions: glucose as the fixed example of each adduct."""
    mass = chemistry.neutral_mass(F.lit("C6H12O6"))
    return chemistry.adducts(spark).select("adduct", "polarity", F.round(chemistry.adduct_mz(mass, F.col("charge"), F.col("molecules"), F.col("delta")), 5).alias("mz"))


def adduct_spelling(spark: SparkSession, d: str) -> DataFrame:
    """Adduct labels as written and as meant."""
    return table(spark, d, "ms2_annotations").where("adduct is not null").groupBy(chemistry.tidy_adduct(F.col("adduct")).alias("adduct")).agg(F.count(F.lit(1)).alias("n"))


def compound_masses(spark: SparkSession, d: str) -> DataFrame:
    """Monoisotopic mass of every distinct formula."""
    f = table(spark, d, "ms2_annotations").select("compound_formula").where("compound_formula is not null").distinct()
    return f.select("compound_formula", F.round(chemistry.neutral_mass(F.col("compound_formula")), 6).alias("mass"))


def mz_decimals(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).where("mz is not null").groupBy(chemistry.n_decimals(F.col("mz")).alias("decimals")).agg(F.count(F.lit(1)).alias("n"))


def concentrations(spark: SparkSession, d: str) -> DataFrame:
    """Area, amount and concentration of regions of so many pixels."""
    n = pixels(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_pixels"))
    area = chemistry.pixel_area(F.col("n_pixels"), F.lit(0.05))
    c = chemistry.concentration(F.lit(12.5), area)
    return n.select("sample_id", F.round(area, 9).alias("area_mm2"), F.round(area * chemistry.area_factor(F.lit("mm"), F.lit("um")), 3).alias("area_um2"), F.round(c, 9).alias("concentration"), F.round(chemistry.amount(c, area), 9).alias("amount"), chemistry.concentration_unit(F.lit("pmol"), F.lit("mm")).alias("unit"))


def latest_features(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each feature."""
    return features(spark, d).select("feature_id", "mz", "origin", "mz_weighted")


def overlay_values(spark: SparkSession, d: str) -> DataFrame:
    """Pixel values scaled to the colour range of their sample."""
    i = _image(spark, d)
    r = aggregates.value_range(i, ["sample_id"], "v")
    return i.join(r, "sample_id").select("sample_id", "pixel_id", F.round(search.scaled(F.col("v"), F.col("vmin"), F.col("vmax"), F.lit(0.8)), 6).alias("scaled"))


def target_set(spark: SparkSession, d: str) -> DataFrame:
    """m/z to quantify: detected, injected and reference values, each once."""
    f = features(spark, d).where("mz is not null")
    reference = spark.createDataFrame([(255.2330,), (281.2486,)], "mz double")
    return f.select(F.bround("mz", 6).alias("mz")).union(reference).distinct()


def best_scan_of_feature(spark: SparkSession, d: str) -> DataFrame:
    """Up to three MS2 scans with most peaks of each feature."""
    a = associations(spark, d).where("feature_id is not null and n_peaks is not null")
    rank = F.row_number().over(Window.partitionBy("feature_id").orderBy(F.desc("n_peaks"), "id"))
    return a.withColumn("rank", rank).where("rank <= 3").select("feature_id", "rank", "id", "n_peaks")


def library_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Annotated inchikeys of library 1, and whether library 2 has them too."""
    a = annotations(spark, d).where("inchikey is not null")
    one, two = (a.where(F.col("library_id") == i).select("inchikey").distinct() for i in (1, 2))
    return one.intersect(two).withColumn("shared", F.lit(True)).unionByName(one.subtract(two).withColumn("shared", F.lit(False)))


QUERIES = {f.__name__: f for f in (grid_indices, neighbour_counts, fill_blanks, local_moran, global_moran, moran_thresholds, feature_fill_blanks, feature_local_moran, feature_global_moran, feature_moran_thresholds, roi_statistics, top_by_tic, placed_pixels, overlap_patterns, feature_membership, sample_counts, ms2_totals, isotope_summary, headline_counts, isotope_links, isotope_votes, features_after_isotopes, adduct_table, adduct_spelling, compound_masses, mz_decimals, concentrations, latest_features, overlay_values, target_set, best_scan_of_feature, library_overlap)}

_BASE = ms2_queries._BASE + """, px AS (
  SELECT sample_id, pixel_id, p.x AS x, p.y AS y FROM (SELECT sample_id, pixel_id, min(struct_pack(x := x, y := y)) AS p FROM spatial_pixels WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL)
), g AS (
  SELECT *, CAST(dense_rank() OVER (PARTITION BY sample_id ORDER BY x) - 1 AS INT) AS gx, CAST(dense_rank() OVER (PARTITION BY sample_id ORDER BY y) - 1 AS INT) AS gy FROM px
), im AS (
  SELECT g.*, coalesce(v, 0) AS v FROM g LEFT JOIN (SELECT sample_id, pixel_id, avg(ln(1 + CAST(list_max(intensity) AS DOUBLE))) AS v FROM mp JOIN s USING (sample_id, scan_id) GROUP BY ALL) t USING (sample_id, pixel_id)
), rk AS (
  SELECT i.sample_id, i.pixel_id AS src, j.pixel_id AS dst FROM g i JOIN g j ON i.sample_id = j.sample_id AND ((j.gx = i.gx AND j.gy IN (i.gy - 1, i.gy + 1)) OR (j.gy = i.gy AND j.gx IN (i.gx - 1, i.gx + 1)))
), zz AS (
  SELECT sample_id, pixel_id, v - avg(v) OVER (PARTITION BY sample_id) AS z, var_pop(v) OVER (PARTITION BY sample_id) AS m2 FROM im
), lm AS (
  SELECT zz.sample_id, zz.pixel_id, CASE WHEN m2 > 0 THEN z / m2 * lag END AS local_i FROM zz LEFT JOIN (SELECT rk.sample_id, src AS pixel_id, avg(z) AS lag FROM rk JOIN zz ON zz.sample_id = rk.sample_id AND zz.pixel_id = dst GROUP BY ALL) l USING (sample_id, pixel_id)
)"""


#: Dense images of the features found in a sample, and their local I.
_FEATURE_IMAGES = """, fi AS (
  SELECT DISTINCT sample_id, feature_id FROM mx JOIN g USING (sample_id, pixel_id)
), fv AS (
  SELECT g.sample_id, g.pixel_id, fi.feature_id, coalesce(value, 0) AS v FROM g JOIN fi USING (sample_id) LEFT JOIN mx ON mx.sample_id = g.sample_id AND mx.pixel_id = g.pixel_id AND mx.feature_id = fi.feature_id
), fz AS (
  SELECT sample_id, pixel_id, feature_id, v - avg(v) OVER w AS z, CASE WHEN min(v) OVER w = max(v) OVER w THEN 0 ELSE var_pop(v) OVER w END AS m2 FROM fv WINDOW w AS (PARTITION BY sample_id, feature_id)
), fl AS (
  SELECT fz.sample_id, fz.feature_id, fz.pixel_id, CASE WHEN m2 > 0 THEN z / m2 * lag END AS local_i FROM fz LEFT JOIN (SELECT rk.sample_id, feature_id, src AS pixel_id, avg(z) AS lag FROM rk JOIN fz ON fz.sample_id = rk.sample_id AND fz.pixel_id = dst GROUP BY ALL) l USING (sample_id, feature_id, pixel_id)
)"""


def _crossings() -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(ROI, [*ROI[1:], ROI[0]], strict=True):
        parts.append(f"CAST((({y1} > gy + 0.5) != ({y2} > gy + 0.5)) AND gx + 0.5 < ({x2} - {x1}) * (gy + 0.5 - {y1}) / ({y2} - {y1}) + {x1} AS INT)")
    return " + ".join(parts)


_a, _b, _c, _d, _e, _f = PLACED
ORACLE = {
    "grid_indices": _BASE + " SELECT sample_id, pixel_id, gx, gy FROM g",
    "neighbour_counts": _BASE + """, w AS (SELECT i.sample_id, i.pixel_id, count(*) AS n_radius_2 FROM g i JOIN g j ON i.sample_id = j.sample_id AND j.gx BETWEEN i.gx - 2 AND i.gx + 2 AND j.gy BETWEEN i.gy - 2 AND i.gy + 2 AND i.pixel_id != j.pixel_id GROUP BY ALL),
 r AS (SELECT sample_id, src AS pixel_id, count(*) AS n_rook FROM rk GROUP BY ALL) SELECT sample_id, pixel_id, n_radius_2, coalesce(n_rook, 0) AS n_rook FROM w LEFT JOIN r USING (sample_id, pixel_id)""",
    "fill_blanks": _BASE + """, e AS (SELECT i.sample_id, i.pixel_id AS src, j.pixel_id AS dst FROM g i JOIN g j ON i.sample_id = j.sample_id AND j.gx BETWEEN i.gx - 1 AND i.gx + 1 AND j.gy BETWEEN i.gy - 1 AND i.gy + 1 AND i.pixel_id != j.pixel_id),
 k AS (SELECT e.sample_id, src, count(*) AS n, count(*) FILTER (v != 0) AS k, avg(v) FILTER (v != 0) AS m FROM e JOIN im ON im.sample_id = e.sample_id AND im.pixel_id = dst GROUP BY ALL)
 SELECT k.sample_id, src AS pixel_id, round(m, 6) AS v FROM k JOIN im ON im.sample_id = k.sample_id AND im.pixel_id = src WHERE im.v = 0 AND k >= greatest(1, ceil(n * 0.6 - 1e-9))""",
    "local_moran": _BASE + " SELECT sample_id, pixel_id, round(local_i, 6) AS local_i FROM lm",
    "global_moran": _BASE + """, a2 AS (SELECT sample_id, sum(z * z) AS q, count(*) AS n_pixels FROM zz GROUP BY ALL), b2 AS (SELECT rk.sample_id, sum(i.z * j.z) AS p, count(*) AS s0 FROM rk JOIN zz i ON i.sample_id = rk.sample_id AND i.pixel_id = src JOIN zz j ON j.sample_id = rk.sample_id AND j.pixel_id = dst GROUP BY ALL)
 SELECT sample_id, CASE WHEN q > 0 AND s0 > 0 THEN round(n_pixels / s0 * p / q, 6) END AS moran_i, n_pixels FROM a2 LEFT JOIN b2 USING (sample_id)""",
    "moran_thresholds": _BASE + """, t AS (SELECT CAST(unnest(range(0, 121)) AS INT) AS k), c AS (SELECT sample_id, CAST(greatest(0, least(121, ceil((local_i + 1.0) / 0.05 - 1e-9))) AS INT) AS over FROM lm WHERE local_i IS NOT NULL)
 SELECT sample_id, k AS threshold_index, count(*) FILTER (over > k) AS n_above, count(*) AS n_finite, round(100.0 * count(*) FILTER (over > k) / count(*), 6) AS pct FROM c, t GROUP BY ALL""",
    "feature_fill_blanks": _BASE + """, e AS (SELECT i.sample_id, i.pixel_id AS src, j.pixel_id AS dst FROM g i JOIN g j ON i.sample_id = j.sample_id AND j.gx BETWEEN i.gx - 1 AND i.gx + 1 AND j.gy BETWEEN i.gy - 1 AND i.gy + 1 AND i.pixel_id != j.pixel_id),
 ne AS (SELECT sample_id, src, count(*) AS n FROM e GROUP BY ALL), k AS (SELECT e.sample_id, feature_id, src, count(*) AS k, avg(value) AS m FROM e JOIN mx ON mx.sample_id = e.sample_id AND mx.pixel_id = dst JOIN g ON g.sample_id = e.sample_id AND g.pixel_id = dst GROUP BY ALL)
 SELECT k.sample_id, k.feature_id, k.src AS pixel_id, round(m, 4) AS value FROM k JOIN ne ON ne.sample_id = k.sample_id AND ne.src = k.src LEFT JOIN mx ON mx.sample_id = k.sample_id AND mx.pixel_id = k.src AND mx.feature_id = k.feature_id WHERE mx.value IS NULL AND k >= greatest(1, ceil(n * 0.6 - 1e-9))""",
    "feature_local_moran": _BASE + _FEATURE_IMAGES + " SELECT sample_id, feature_id, pixel_id, round(local_i + 1e-9, 6) AS local_i FROM fl",
    "feature_global_moran": _BASE + _FEATURE_IMAGES + """, q AS (SELECT sample_id, feature_id, sum(z * z) AS q, count(*) AS n_pixels, any_value(m2) AS m2 FROM fz GROUP BY ALL),
 p AS (SELECT rk.sample_id, i.feature_id, sum(i.z * j.z) AS p, count(*) AS s0 FROM rk JOIN fz i ON i.sample_id = rk.sample_id AND i.pixel_id = src JOIN fz j ON j.sample_id = rk.sample_id AND j.pixel_id = dst AND j.feature_id = i.feature_id GROUP BY ALL)
 SELECT sample_id, feature_id, CASE WHEN m2 > 0 AND s0 > 0 THEN round(n_pixels / s0 * p / q, 6) END AS moran_i, n_pixels FROM q LEFT JOIN p USING (sample_id, feature_id)""",
    "feature_moran_thresholds": _BASE + _FEATURE_IMAGES + """, t AS (SELECT CAST(unnest(range(0, 121)) AS INT) AS k), c AS (SELECT sample_id, feature_id, CAST(greatest(0, least(121, ceil((local_i + 1.0) / 0.05 - 1e-9))) AS INT) AS over FROM fl WHERE local_i IS NOT NULL)
 SELECT sample_id, feature_id, k AS threshold_index, count(*) FILTER (over > k) AS n_above, count(*) AS n_finite, round(100.0 * count(*) FILTER (over > k) / count(*), 6) AS pct FROM c, t GROUP BY ALL""",
    "roi_statistics": _BASE + f" SELECT sample_id, CASE WHEN ({_crossings()}) % 2 = 1 THEN 'roi' ELSE 'outside' END AS region, count(*) AS n_pixels, round(avg(v), 6) AS mean_v FROM im GROUP BY ALL",
    "top_by_tic": _BASE + " SELECT sample_id, round(avg(CAST(list_max(intensity) AS DOUBLE) / tic), 6) AS ratio, count(*) AS n FROM s WHERE tic > 0 AND len(intensity) > 0 GROUP BY ALL",
    "placed_pixels": _BASE + f" SELECT sample_id, pixel_id, CAST({_a} AS DOUBLE) * gx + CAST({_b} AS DOUBLE) * gy + {_c} AS u, CAST({_d} AS DOUBLE) * gx + CAST({_e} AS DOUBLE) * gy + {_f} AS v, CAST(0 AS DOUBLE) AS error FROM g",
    "overlap_patterns": _BASE + " SELECT array_to_string(list_sort([x.key for x in map_entries(members) if x.value IS NOT NULL]), '|') AS samples, count(*) AS n_features FROM f WHERE members IS NOT NULL GROUP BY ALL",
    "feature_membership": _BASE + ", m AS (SELECT unnest(map_entries(members)) AS e FROM f) SELECT e.key AS sample, count(*) AS n_features, round(avg(e.value), 6) AS mean_index FROM m WHERE e.value IS NOT NULL GROUP BY ALL",
    "sample_counts": _BASE + """, o AS (SELECT sample_id, count(*) AS n_ms1, CAST(sum(len(mz)) AS BIGINT) AS n_peaks FROM s GROUP BY ALL), t AS (SELECT sample_id, count(*) AS n_ms2 FROM a GROUP BY ALL), p AS (SELECT sample_id, count(*) AS n_pixels FROM px GROUP BY ALL)
 SELECT sample_id, coalesce(n_ms1, 0) AS n_ms1, coalesce(n_peaks, 0) AS n_peaks, coalesce(n_ms2, 0) AS n_ms2, coalesce(n_pixels, 0) AS n_pixels FROM o FULL JOIN t USING (sample_id) FULL JOIN p USING (sample_id)""",
    "ms2_totals": _BASE + " SELECT sample_id, count(*) FILTER (feature_id IS NOT NULL) AS n_associated, count(*) FILTER (feature_id IS NULL) AS n_unassociated, count(*) FILTER (fragmentation_factor < 0.2) AS n_low_factor FROM a GROUP BY ROLLUP (sample_id)",
    "isotope_summary": "SELECT isotope_index, charge, count(*) AS n, round(median(intensity_ratio), 6) AS median_ratio, round(median(spatial_corr), 6) AS median_corr FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY loaded_at DESC) AS rn FROM feature_isotopes) WHERE rn = 1 GROUP BY ALL",
    "headline_counts": _BASE + " SELECT (SELECT count(*) FROM f) AS n_features, (SELECT count(*) FROM f WHERE origin = 'injected') AS n_injected, count(DISTINCT feature_id) AS n_annotated, count(DISTINCT inchikey) AS n_compounds, count(DISTINCT library_id) AS n_libraries FROM n",
    "adduct_table": f"WITH adds(adduct, charge, molecules, delta) AS (VALUES {ms2_queries._ADDUCTS}) SELECT adduct, CASE WHEN charge > 0 THEN 'positive' ELSE 'negative' END AS polarity, round((molecules * {6 * chemistry.MASS['C'] + 12 * chemistry.MASS['H'] + 6 * chemistry.MASS['O']!r} + delta) / abs(charge), 5) AS mz FROM adds",
    "adduct_spelling": "SELECT CASE " + " ".join(f"WHEN k = '{a.lower()[1 : a.index(']')]}' THEN '{a}'" for a, *_ in chemistry.ADDUCTS) + r""" ELSE label END AS adduct, count(*) AS n FROM (
  SELECT trim(adduct) AS label, lower(regexp_replace(regexp_replace(regexp_replace(trim(adduct), '^\[|\](1?[+-])?$|\]$', '', 'g'), '\](\d?[+-])$', '', 'g'), '\]\d?[+-]?$', '', 'g')) AS k FROM ms2_annotations WHERE adduct IS NOT NULL) GROUP BY ALL""",
    "mz_decimals": _BASE + " SELECT CAST(length(regexp_extract(CAST(mz AS VARCHAR), '\\.([0-9]*[1-9])', 1)) AS INT) AS decimals, count(*) AS n FROM f WHERE mz IS NOT NULL GROUP BY ALL",
    "compound_masses": _BASE + ", d AS (SELECT DISTINCT compound_formula FROM ms2_annotations WHERE compound_formula IS NOT NULL), p AS (SELECT compound_formula, unnest(regexp_extract_all(compound_formula, '[A-Z][a-z]?[0-9]*')) AS p FROM d) SELECT compound_formula, round(sum(mass * coalesce(TRY_CAST(regexp_extract(p, '[0-9]+$') AS INT), 1)), 6) AS mass FROM p JOIN masses ON el = regexp_extract(p, '^[A-Za-z]+') GROUP BY ALL",
    "concentrations": _BASE + """, k AS (SELECT sample_id, count(*) * 0.05::DOUBLE * 0.05::DOUBLE AS area FROM px GROUP BY ALL) SELECT sample_id, round(area, 9) AS area_mm2, round(area * 1e6, 3) AS area_um2, round(12.5::DOUBLE / area, 9) AS concentration, round(12.5::DOUBLE / area * area, 9) AS amount, 'pmol/mm2' AS unit FROM k""",
    "latest_features": _BASE + " SELECT feature_id, mz, origin, mz_weighted FROM f",
    "overlay_values": _BASE + """, l AS (SELECT sample_id, min(v) AS vmin FROM im GROUP BY ALL), h AS (SELECT sample_id, quantile_cont(v, 0.995) AS hi FROM im JOIN l USING (sample_id) WHERE v > vmin GROUP BY ALL)
 SELECT sample_id, pixel_id, round(pow(greatest(0, least(1, (v - vmin) / (coalesce(hi, vmin + 1) - vmin))), 0.8), 6) AS scaled FROM im JOIN l USING (sample_id) LEFT JOIN h USING (sample_id)""",
    "target_set": _BASE + " SELECT round_even(mz, 6) AS mz FROM f WHERE mz IS NOT NULL UNION SELECT * FROM (VALUES (255.2330::DOUBLE), (281.2486::DOUBLE))",
    "best_scan_of_feature": _BASE + " SELECT feature_id, CAST(rank AS INT) AS rank, id, n_peaks FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY n_peaks DESC, id) AS rank FROM a WHERE feature_id IS NOT NULL AND n_peaks IS NOT NULL) WHERE rank <= 3",
    "library_overlap": _BASE + ", o AS (SELECT inchikey FROM n WHERE library_id = 1 AND inchikey IS NOT NULL), t AS (SELECT inchikey FROM n WHERE library_id = 2 AND inchikey IS NOT NULL) SELECT inchikey, true AS shared FROM (SELECT * FROM o INTERSECT SELECT * FROM t) UNION ALL SELECT inchikey, false FROM (SELECT * FROM o EXCEPT SELECT * FROM t)",
}
