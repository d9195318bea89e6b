"""MS1 side: scans, pixels, matrices, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions import spectral
from ionloom.operators import aggregates, joins, ranks, windows
from ionloom.operators.lifecycle import latest
from ionloom.session import stored
from ionloom.sources.tables import table


def scans(spark: SparkSession, d: str) -> DataFrame:
    """MS1 scans, of repeated deliveries the last; NaN as NULL, polarity spelt one way."""
    df = latest(table(spark, d, "ms1_scans"), ["sample_id", "scan_id"], ["loaded_at"])
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    return df.withColumns({"rt": real("rt"), "tic": real("tic"), "polarity": spectral.normalize_polarity(F.col("polarity"))})


def features(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "features"), ["feature_id"], ["loaded_at"])


def mapped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pixel_ms1_scans").select("sample_id", "pixel_id", "scan_id").distinct()


def dwells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spatial_pixels").select("sample_id", "pixel_id", "t_start", "t_end").distinct()


def latest_scans(spark: SparkSession, d: str) -> DataFrame:
    return scans(spark, d).select("sample_id", "scan_id", "rt", "n_peaks", "tic", "polarity")


def pixel_scan_join(spark: SparkSession, d: str) -> DataFrame:
    """Scans that fall into a pixel's dwells, counted per pixel."""
    points = scans(spark, d).select("sample_id", "scan_id", "rt")
    pairs = joins.interval_join(points, dwells(spark, d), "rt", "t_start", "t_end", ["sample_id"], width=5.0).select("sample_id", "pixel_id", "scan_id").distinct()
    return pairs.groupBy("sample_id", "pixel_id").agg(F.count(F.lit(1)).alias("n_scans"), F.min("scan_id").alias("first_scan"), F.max("scan_id").alias("last_scan"))


def pixel_first_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first scan of each pixel, with its rt and tic."""
    first = mapped(spark, d).groupBy("sample_id", "pixel_id").agg(F.min("scan_id").alias("scan_id"))
    return first.join(scans(spark, d).select("sample_id", "scan_id", "rt", "tic"), ["sample_id", "scan_id"]).select("sample_id", "pixel_id", "scan_id", "rt", "tic")


def _quantified(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.quantify(scans(spark, d), features(spark, d).where("mz is not null"), ["sample_id"], "scan_id", "feature_id", "mz", 5.0)


def quantified_features(spark: SparkSession, d: str) -> DataFrame:
    """Scans in which each feature is detected and its strongest peak."""
    return _quantified(spark, d).groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_scans"), F.max("value").alias("max_intensity"))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.pixel_matrix(_quantified(spark, d), mapped(spark, d), ["sample_id"], "scan_id", "pixel_id", "feature_id")


def pixel_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Mean over the scans of a pixel in which a feature was detected."""
    return _matrix(spark, d).select("sample_id", "pixel_id", "feature_id", F.round("value", 4).alias("value"))


def pixel_obs(spark: SparkSession, d: str) -> DataFrame:
    """Per pixel: mean rt and tic, joined scan ids, number of detected features."""
    s = mapped(spark, d).join(scans(spark, d).select("sample_id", "scan_id", "rt", "tic"), ["sample_id", "scan_id"])
    obs = s.groupBy("sample_id", "pixel_id").agg(F.round(F.avg("rt"), 6).alias("mean_rt"), F.round(F.avg("tic"), 4).alias("mean_tic"), F.array_join(F.transform(F.array_sort(F.collect_set("scan_id")), lambda x: x.cast("string")), "|").alias("scan_ids"))
    n = _matrix(spark, d).groupBy("sample_id", "pixel_id").agg(F.count_if(F.col("value") > 0).alias("n_features"))
    return obs.join(n, ["sample_id", "pixel_id"], "left").withColumn("n_features", F.coalesce("n_features", F.lit(0).cast("bigint")))


def average_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """Summed intensity per m/z bin of the scans on pixels, over the number of pixels."""
    out = aggregates.average_spectrum(scans(spark, d), mapped(spark, d), ["sample_id"], "scan_id", "pixel_id", 70.0, 900.0, 0.5)
    return out.select("sample_id", "bin", F.round(F.col("intensity") + 1e-8, 6).alias("intensity"))


def mad_filter(spark: SparkSession, d: str) -> DataFrame:
    """Per sample the MAD threshold of log intensity and how many peaks lie strictly above it."""
    peaks = scans(spark, d).select("sample_id", F.explode("intensity").alias("i")).where("i > 0")
    limit = aggregates.mad_threshold(peaks, ["sample_id"], "i")
    return peaks.join(limit, "sample_id").groupBy("sample_id", F.round("threshold", 4).alias("threshold")).agg(F.count_if(F.col("i") > F.col("threshold")).alias("n_kept"), F.count_if(F.col("i") <= F.col("threshold")).alias("n_removed"))


def spectrum_quality(spark: SparkSession, d: str) -> DataFrame:
    """Base peak, factor, flatness and peaks above noise of each spectrum."""
    p = scans(spark, d).where("size(mz) > 0").withColumn("p", spectral.peaks(F.col("mz"), F.col("intensity"))).withColumn("base", spectral.base_peak(F.col("p")))
    return p.select("sample_id", "scan_id", F.round("base", 4).alias("base_peak_mz"), F.round(spectral.fragmentation_factor(F.col("p"), F.col("base")), 6).alias("factor"), spectral.is_flat(F.col("p")).alias("is_flat"), F.size(spectral.noise_filtered(F.col("p"), 0.1)).alias("n_above_noise"))


def scan_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Score of each spectrum against the one before it in its sample."""
    s = scans(spark, d).where("rt is not null and size(mz) > 0")
    # The scan before is found by number; its peaks are then fetched once.
    at = s.select("sample_id", "scan_id", "rt").withColumn("_before", F.col("rt") - 1e-6)
    pairs = joins.asof(at, at.select("sample_id", "rt", F.col("scan_id").alias("previous_scan_id")), "_before", "rt", "previous_scan_id", ["sample_id"], width=300.0).where("previous_scan_id is not null").select("sample_id", "scan_id", "previous_scan_id")
    own = s.select("sample_id", "scan_id", spectral.peaks(F.col("mz"), F.col("intensity")).alias("p"))
    both = pairs.join(own, ["sample_id", "scan_id"]).join(own.select("sample_id", F.col("scan_id").alias("previous_scan_id"), F.col("p").alias("q")), ["sample_id", "previous_scan_id"])
    m = spectral.reverse_dot_product(F.col("p"), F.col("q"))
    return both.withColumn("m", m).select("sample_id", "scan_id", "previous_scan_id", F.round("m.score", 6).alias("score"), F.col("m.n_matched_peaks").alias("n_matched_peaks"))


def tic_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Scans scaled by the median tic of all scans."""
    s = scans(spark, d).select("sample_id", "scan_id", "tic", F.array_max("intensity").cast("double").alias("top"))
    return aggregates.normalise(s, "tic", "top").select("sample_id", "scan_id", F.round("normalised", 6).alias("normalised"))


def background_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Peaks that recur over samples, by polarity."""
    peaks = scans(spark, d).where("polarity is not null").select("polarity", "sample_id", F.explode("mz").alias("mz"))
    out = windows.background(peaks, "mz", "polarity", "sample_id", 10.0)
    return out.where("n_keys >= 2").select("polarity", F.round("mz", 4).alias("mz"), "n_keys", "n_total", F.round("fraction", 6).alias("fraction"))


def feature_precision(spark: SparkSession, d: str) -> DataFrame:
    """Intensity-weighted m/z and spread of each feature's peaks over samples."""
    peaks = scans(spark, d).select("sample_id", F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select("sample_id", F.col("p.mz").cast("double").alias("m"), F.col("p.intensity").cast("double").alias("i"))
    pairs = joins.ppm_join(peaks, features(spark, d).where("mz is not null").select("feature_id", F.col("mz").alias("ref")), "m", "ref", 5.0)
    per = pairs.groupBy("feature_id", "sample_id").agg(F.avg("m").alias("m"), F.max("i").alias("i"))
    return aggregates.weighted_mz(per, ["feature_id"], "m", "i").select("feature_id", F.round("mz_weighted", 5).alias("mz_weighted"), F.round("mz_spread_ppm", 3).alias("mz_spread_ppm"))


def isotope_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of features at the distance of an isotope."""
    from ionloom.functions.chemistry import C13_DELTA

    f = features(spark, d).where("mz is not null").select("feature_id", "mz")
    mono = f.select(F.col("feature_id").alias("mono_id"), F.col("mz").alias("mono_mz"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(z).alias("z")) for k in (1, 2, 3) for z in (1, 2)])).alias("x")).select("mono_id", "mono_mz", "x.*")
    mono = mono.withColumn("expected", F.col("mono_mz") + F.col("k") * F.lit(C13_DELTA) / F.col("z"))
    return joins.ppm_join(f.withColumnRenamed("feature_id", "isotope_id"), mono, "mz", "expected", 25.0).where("isotope_id != mono_id").select("mono_id", "isotope_id", "k", "z")


def nearest_feature(spark: SparkSession, d: str) -> DataFrame:
    """The feature nearest to each scan's base peak, whatever the distance."""
    p = scans(spark, d).where("size(mz) > 0").select("sample_id", "scan_id", F.round(spectral.base_peak(spectral.peaks(F.col("mz"), F.col("intensity"))), 4).alias("mz"))
    return joins.nearest(p, features(spark, d).select("feature_id", F.col("mz").alias("fmz")), "mz", "fmz", "feature_id", width=5.0).select("sample_id", "scan_id", "feature_id")


def polarity_counts(spark: SparkSession, d: str) -> DataFrame:
    return scans(spark, d).groupBy("polarity").agg(F.count(F.lit(1)).alias("n_scans"))


def tic_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Colour range of tic per sample."""
    return aggregates.value_range(scans(spark, d), ["sample_id"], "tic").select("sample_id", "vmin", F.round("vmax", 4).alias("vmax"))


def tic_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles of tic per sample."""
    s = scans(spark, d).select("sample_id", "tic").where("tic is not null")
    ends = s.groupBy("sample_id").agg(F.min("tic").alias("lowest"), F.max("tic").alias("highest"))
    q = ranks.percentiles(s, ["sample_id"], "tic", [0.25, 0.5, 0.75])
    return ends.join(q, "sample_id").select("sample_id", "lowest", "highest", *[F.round(F.get("q", F.lit(i)), 4).alias(n) for i, n in enumerate(("q25", "median", "q75"))])


def tic_by_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Line of tic on the number of peaks, per sample."""
    out = aggregates.calibration(scans(spark, d).where("tic > 0"), ["sample_id"], "n_peaks", "tic")
    return out.where("slope is not null").select("sample_id", "n", F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"))


def tic_by_peaks_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The same weighted by 1/x."""
    out = aggregates.calibration(scans(spark, d).where("tic > 0"), ["sample_id"], "n_peaks", "tic", "1/x")
    return out.where("slope is not null").select("sample_id", F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"))


def correlation(spark: SparkSession, d: str) -> DataFrame:
    """Pearson r of all pairs of features over the pixels of each sample."""
    # Small beside the scans, and used several times.
    m = stored(_matrix(spark, d))
    n = mapped(spark, d).groupBy("sample_id").agg(F.count_distinct("pixel_id").alias("n"))
    return aggregates.correlation_pairs(m, n, ["sample_id"], "pixel_id", "feature_id", "value", min_abs=0.5).select("sample_id", "feature_a", "feature_b", F.round("r", 5).alias("r"))


QUERIES = {f.__name__: f for f in (latest_scans, pixel_scan_join, pixel_first_scan, quantified_features, pixel_matrix, pixel_obs, average_spectrum, mad_filter, spectrum_quality, scan_similarity, tic_normalised, background_fragments, feature_precision, isotope_candidates, nearest_feature, polarity_counts, tic_ranges, tic_distribution, tic_by_peaks, tic_by_peaks_weighted)}
QUERIES["feature_correlation"] = correlation

_BASE = """
WITH s AS (
  SELECT sample_id, scan_id, CASE WHEN isnan(rt) THEN NULL ELSE rt END AS rt, n_peaks, CASE WHEN isnan(tic) THEN NULL ELSE tic END AS tic,
    CASE WHEN lower(trim(polarity)) IN ('+', 'p', '1', '1+', '+1') OR lower(trim(polarity)) LIKE 'pos%' THEN 'POSITIVE' WHEN lower(trim(polarity)) IN ('-', 'n', '-1', '1-') OR lower(trim(polarity)) LIKE 'neg%' THEN 'NEGATIVE' END AS polarity, mz, intensity
  FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, scan_id ORDER BY loaded_at DESC) AS rn FROM ms1_scans) WHERE rn = 1
), f AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY loaded_at DESC) AS rn FROM features) WHERE rn = 1
), mp AS (SELECT DISTINCT sample_id, pixel_id, scan_id FROM pixel_ms1_scans
), pk AS (
  SELECT sample_id, scan_id, CAST(m AS DOUBLE) AS m, m AS mf, CAST(i AS DOUBLE) AS i FROM (SELECT sample_id, scan_id, unnest(mz) AS m, unnest(intensity) AS i FROM s)
), qn AS (
  SELECT sample_id, scan_id, feature_id, max(i) AS value FROM pk JOIN f ON pk.m BETWEEN f.mz - f.mz * 5e-6 AND f.mz + f.mz * 5e-6 WHERE i > 0 GROUP BY ALL
), mx AS (
  SELECT sample_id, pixel_id, feature_id, avg(value) AS value FROM qn JOIN mp USING (sample_id, scan_id) GROUP BY ALL
), bp AS (
  SELECT sample_id, scan_id, m FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, scan_id ORDER BY i DESC, m) AS rn FROM pk) WHERE rn = 1
)"""

ORACLE = {
    "latest_scans": _BASE + " SELECT sample_id, scan_id, rt, n_peaks, tic, polarity FROM s",
    "pixel_scan_join": _BASE + """ SELECT sample_id, pixel_id, count(*) AS n_scans, min(scan_id) AS first_scan, max(scan_id) AS last_scan FROM (
  SELECT DISTINCT s.sample_id, p.pixel_id, s.scan_id FROM s JOIN spatial_pixels p ON s.sample_id = p.sample_id AND s.rt BETWEEN p.t_start AND p.t_end WHERE NOT isnan(p.t_start) AND NOT isnan(p.t_end)) GROUP BY ALL""",
    "pixel_first_scan": _BASE + " SELECT g.sample_id, pixel_id, g.scan_id, rt, tic FROM (SELECT sample_id, pixel_id, min(scan_id) AS scan_id FROM mp GROUP BY ALL) g JOIN s ON s.sample_id = g.sample_id AND s.scan_id = g.scan_id",
    "quantified_features": _BASE + " SELECT feature_id, count(*) AS n_scans, max(value) AS max_intensity FROM qn GROUP BY ALL",
    "pixel_matrix": _BASE + " SELECT sample_id, pixel_id, feature_id, round(value, 4) AS value FROM mx",
    "pixel_obs": _BASE + """, o AS (SELECT sample_id, pixel_id, round(avg(rt), 6) AS mean_rt, round(avg(tic), 4) AS mean_tic, string_agg(CAST(scan_id AS VARCHAR), '|' ORDER BY scan_id) AS scan_ids FROM mp JOIN s USING (sample_id, scan_id) GROUP BY ALL),
 n AS (SELECT sample_id, pixel_id, count(*) AS n FROM mx WHERE value > 0 GROUP BY ALL)
 SELECT o.*, coalesce(n, 0) AS n_features FROM o LEFT JOIN n USING (sample_id, pixel_id)""",
    "average_spectrum": _BASE + """, u AS (SELECT DISTINCT s.sample_id, mz, intensity FROM s WHERE EXISTS (SELECT 1 FROM mp WHERE mp.sample_id = s.sample_id AND mp.scan_id = s.scan_id)),
 b AS (SELECT sample_id, CAST(trunc((m - CAST(70 AS FLOAT)) / CAST(0.5 AS FLOAT)) AS BIGINT) AS bin, CAST(i AS DOUBLE) AS i FROM (SELECT sample_id, unnest(mz) AS m, unnest(intensity) AS i FROM u)),
 n AS (SELECT sample_id, count(DISTINCT pixel_id) AS n FROM mp WHERE EXISTS (SELECT 1 FROM s WHERE mp.sample_id = s.sample_id AND mp.scan_id = s.scan_id) GROUP BY ALL)
 SELECT sample_id, bin, round(sum(i) / any_value(n) + 1e-8, 6) AS intensity FROM b JOIN n USING (sample_id) WHERE bin BETWEEN 0 AND 1659 GROUP BY ALL""",
    "mad_filter": _BASE + """, l AS (SELECT sample_id, log10(i) AS v, i FROM pk WHERE i > 0), a AS (SELECT sample_id, median(v) AS med FROM l GROUP BY ALL),
 t AS (SELECT sample_id, pow(10, any_value(med) + 2.5 * median(abs(v - med))) AS thr FROM l JOIN a USING (sample_id) GROUP BY ALL)
 SELECT sample_id, round(thr, 4) AS threshold, count(*) FILTER (i > thr) AS n_kept, count(*) FILTER (i <= thr) AS n_removed FROM l JOIN t USING (sample_id) GROUP BY ALL""",
    "spectrum_quality": _BASE + """, q AS (SELECT sample_id, scan_id, bp.m AS base, max(i) AS top, sum(i) AS tot, sum(i) FILTER (abs(pk.m - bp.m) <= 2) AS near, count(*) FILTER (i >= 0) AS n FROM pk JOIN bp USING (sample_id, scan_id) GROUP BY ALL),
 k AS (SELECT sample_id, scan_id, count(*) AS n, stddev_pop(i) / avg(i) AS cv FROM pk JOIN q USING (sample_id, scan_id) WHERE i >= top * 0.01 GROUP BY ALL),
 z AS (SELECT sample_id, scan_id, count(*) AS n_above FROM pk JOIN q USING (sample_id, scan_id) WHERE i / top >= 0.1 GROUP BY ALL)
 SELECT q.sample_id, q.scan_id, round(base, 4) AS base_peak_mz, CASE WHEN tot > 0 THEN round(1 - near / tot, 6) END AS factor, top > 0 AND k.n >= 3 AND cv <= 0.2 AS is_flat, CAST(n_above AS INT) AS n_above_noise
 FROM q JOIN k USING (sample_id, scan_id) JOIN z USING (sample_id, scan_id)""",
    "scan_similarity": _BASE + """, sr AS (SELECT sample_id, scan_id, rt, mz, intensity FROM s WHERE rt IS NOT NULL AND len(mz) > 0),
 pr AS (SELECT l.sample_id, l.scan_id, r.scan_id AS prev FROM sr l ASOF JOIN (SELECT sample_id, rt, max(scan_id) AS scan_id FROM sr GROUP BY ALL) r ON l.sample_id = r.sample_id AND l.rt - 1e-6 >= r.rt),
 up AS (SELECT *, max(i) OVER (PARTITION BY sample_id, scan_id) AS top FROM (SELECT sample_id, scan_id, CAST(unnest(mz) AS DOUBLE) AS m, CAST(unnest(intensity) AS DOUBLE) AS i, generate_subscripts(mz, 1) AS p FROM sr)),
 np AS (SELECT sample_id, scan_id, m, p, CASE WHEN top > 0 THEN i / top ELSE i END AS i FROM up WHERE top <= 0 OR i / top >= 0.01),
 mt AS (SELECT pr.*, l.m, l.i, (SELECT max(q.i) FROM np q WHERE q.sample_id = pr.sample_id AND q.scan_id = pr.scan_id AND abs(q.m - l.m) <= l.m * 1e-5) AS q FROM pr JOIN np l ON l.sample_id = pr.sample_id AND l.scan_id = pr.prev),
 ec AS (SELECT pr.*, count(*) AS nq, count(*) FILTER (EXISTS (SELECT 1 FROM np l WHERE l.sample_id = pr.sample_id AND l.scan_id = pr.prev AND abs(l.m - q.m) <= q.m * 1e-5)) AS ne FROM pr JOIN np q ON q.sample_id = pr.sample_id AND q.scan_id = pr.scan_id GROUP BY ALL),
 sm AS (SELECT sample_id, scan_id, prev, sum(sqrt(i) * m * m * sqrt(coalesce(q, 0)) * m * m) AS lq, sum(i * m * m * m * m) AS ll, sum(coalesce(q, 0) * m * m * m * m) AS qq, count(q) AS nm, count(*) AS nl FROM mt GROUP BY ALL)
 SELECT sample_id, scan_id, prev AS previous_scan_id, round(least(1, CASE WHEN ll > 0 AND qq > 0 THEN least(1, lq / (sqrt(ll) * sqrt(qq))) ELSE 0 END * sqrt(nm / nl) * sqrt(ne / nq)), 6) AS score, CAST(nm AS INT) AS n_matched_peaks FROM sm JOIN ec USING (sample_id, scan_id, prev)""",
    "tic_normalised": _BASE + """, m AS (SELECT median(tic) AS med FROM s) SELECT sample_id, scan_id, CASE WHEN tic > 0 AND med > 0 THEN round(ln(1 + CAST(list_max(intensity) AS DOUBLE) * (med / tic)), 6) ELSE 0 END AS normalised FROM s, m""",
    "background_fragments": _BASE + """, x AS (SELECT polarity, sample_id, CAST(m AS DOUBLE) AS m, ln(CAST(m AS DOUBLE)) AS l FROM (SELECT polarity, sample_id, unnest(mz) AS m FROM s WHERE polarity IS NOT NULL)),
 g AS (SELECT *, CASE WHEN l - lag(l) OVER (PARTITION BY polarity ORDER BY l) > ln(1.00001) THEN 1 ELSE 0 END AS brk FROM x),
 i AS (SELECT *, sum(brk) OVER (PARTITION BY polarity ORDER BY l) AS island FROM g),
 p AS (SELECT *, floor((l - min(l) OVER (PARTITION BY polarity, island)) / ln(1.00001) / 2) AS piece FROM i),
 t AS (SELECT polarity, count(DISTINCT sample_id) AS n_total FROM x GROUP BY ALL)
 SELECT polarity, round(avg(m), 4) AS mz, count(DISTINCT sample_id) AS n_keys, any_value(n_total) AS n_total, round(count(DISTINCT sample_id) / any_value(n_total), 6) AS fraction
 FROM p JOIN t USING (polarity) GROUP BY polarity, island, piece HAVING count(DISTINCT sample_id) >= 2""",
    "feature_precision": _BASE + """, p AS (SELECT feature_id, sample_id, avg(m) AS m, max(i) AS i FROM pk JOIN f ON pk.m BETWEEN f.mz - f.mz * 5e-6 AND f.mz + f.mz * 5e-6 GROUP BY ALL),
 w AS (SELECT feature_id, CASE WHEN sum(greatest(i, 0)) > 0 THEN sum(m * greatest(i, 0)) / sum(greatest(i, 0)) ELSE avg(m) END AS mean, stddev_pop(m) AS sd, count(*) AS n FROM p GROUP BY ALL)
 SELECT feature_id, round(mean, 5) AS mz_weighted, CASE WHEN n > 1 THEN round(sd / mean * 1e6, 3) END AS mz_spread_ppm FROM w""",
    "isotope_candidates": _BASE + """, k AS (SELECT unnest([1, 2, 3]) AS k), z AS (SELECT unnest([1, 2]) AS z), m AS (SELECT feature_id AS mono_id, k, z, mz + k * 1.0033548 / z AS e FROM f, k, z)
 SELECT mono_id, feature_id AS isotope_id, k, z FROM m JOIN f ON f.mz BETWEEN e - e * 25e-6 AND e + e * 25e-6 WHERE feature_id != mono_id""",
    "nearest_feature": _BASE + """, b AS (SELECT sample_id, scan_id, round(m, 4) AS m FROM bp), v AS (SELECT DISTINCT m FROM b),
 n AS (SELECT v.m, feature_id, row_number() OVER (PARTITION BY v.m ORDER BY abs(v.m - f.mz), f.mz, feature_id) AS rn FROM v, f WHERE f.mz IS NOT NULL)
 SELECT sample_id, scan_id, feature_id FROM b JOIN n ON b.m = n.m AND rn = 1""",
    "polarity_counts": _BASE + " SELECT polarity, count(*) AS n_scans FROM s GROUP BY ALL",
    "tic_ranges": _BASE + """, l AS (SELECT sample_id, min(tic) AS vmin FROM s GROUP BY ALL), h AS (SELECT sample_id, quantile_cont(tic, 0.995) AS hi FROM s JOIN l USING (sample_id) WHERE tic > vmin GROUP BY ALL)
 SELECT sample_id, vmin, round(coalesce(hi, vmin + 1), 4) AS vmax FROM l LEFT JOIN h USING (sample_id) WHERE vmin IS NOT NULL""",
    "tic_distribution": _BASE + " SELECT sample_id, min(tic) AS lowest, max(tic) AS highest, round(quantile_cont(tic, 0.25), 4) AS q25, round(quantile_cont(tic, 0.5), 4) AS median, round(quantile_cont(tic, 0.75), 4) AS q75 FROM s WHERE tic IS NOT NULL GROUP BY ALL",
    "tic_by_peaks": _BASE + " SELECT sample_id, count(*) AS n, round(regr_slope(tic, n_peaks), 3) AS slope, round(regr_intercept(tic, n_peaks), 3) AS intercept, round(regr_r2(tic, n_peaks), 6) AS r2 FROM s WHERE tic > 0 AND n_peaks IS NOT NULL GROUP BY ALL HAVING var_pop(n_peaks) > 0",
    "tic_by_peaks_weighted": _BASE + """, w AS (SELECT sample_id, CAST(n_peaks AS DOUBLE) AS x, tic AS y, CASE WHEN n_peaks = 0 THEN 1 ELSE 1.0 / n_peaks END AS w FROM s WHERE tic > 0 AND n_peaks IS NOT NULL),
 m AS (SELECT sample_id, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY ALL),
 k AS (SELECT sample_id, any_value(mx) AS mx, any_value(my) AS my, sum(w * (x - mx) * (x - mx)) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy FROM w JOIN m USING (sample_id) GROUP BY ALL)
 SELECT sample_id, round(sxy / sxx, 3) AS slope, round(my - sxy / sxx * mx, 3) AS intercept FROM k WHERE sxx > 0""",
    "feature_correlation": _BASE + """, n AS (SELECT sample_id, count(DISTINCT pixel_id) AS n FROM mp GROUP BY ALL),
 st AS (SELECT sample_id, feature_id, sum(value) / any_value(n) AS mean, sum(value * value) / any_value(n) AS ms, any_value(n) AS n FROM mx JOIN n USING (sample_id) GROUP BY ALL),
 v AS (SELECT *, ms - mean * mean AS var FROM st WHERE ms - mean * mean > 1e-12 * ms),
 g AS (SELECT a.sample_id, a.feature_id AS feature_a, b.feature_id AS feature_b, sum(a.value * b.value) AS s FROM mx a JOIN mx b ON a.sample_id = b.sample_id AND a.pixel_id = b.pixel_id AND a.feature_id < b.feature_id GROUP BY ALL),
 r AS (SELECT a.sample_id, a.feature_id AS feature_a, b.feature_id AS feature_b, (coalesce(s, 0) / a.n - a.mean * b.mean) / sqrt(a.var * b.var) AS r
  FROM v a JOIN v b ON a.sample_id = b.sample_id AND a.feature_id < b.feature_id LEFT JOIN g ON g.sample_id = a.sample_id AND g.feature_a = a.feature_id AND g.feature_b = b.feature_id)
 SELECT sample_id, feature_a, feature_b, round(least(1, greatest(-1, r)), 5) AS r FROM r WHERE abs(least(1, greatest(-1, r))) >= 0.5""",
}
