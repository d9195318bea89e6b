"""Queries of the llm problems, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm import leakage, mixing, nearest_time, objectionable, quantiles, topn
from ionloom.session import cut
from ionloom.sources.tables import small_enough, table


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ms2_annotations").select("feature_id", F.upper(F.regexp_replace("inchikey", r"^\s+|\s+$", "")).alias("inchikey"), "score")
    return rows.where("inchikey != '' and score between 0 and 1")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The five inchikeys with the highest best score of each feature."""
    return topn.top_n(_annotations(spark, d), "feature_id", "inchikey", "score", 5).select("feature_id", "inchikey")


def p4_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The same with score and rank."""
    return topn.top_n(_annotations(spark, d), "feature_id", "inchikey", "score", 5)


def _measures(spark: SparkSession, d: str) -> list[DataFrame]:
    """sample_id, measure, load_month, value of the two measures; each in its own table. Rows of no known time are a load of their own."""
    month = F.coalesce(F.date_format("loaded_at", "yyyy-MM"), F.lit("unknown"))
    of = lambda name, col: table(spark, d, name).select("sample_id", F.lit(col).alias("measure"), month.alias("load_month"), F.col(col).alias("value"))
    return [of("ms2_associations", "ppm_offset"), of("ms1_scans", "tic")]


GROUP = ["sample_id", "measure"]


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per sample, from the merged sketches of all partitions."""
    out = []
    for df in _measures(spark, d):
        df = df.select(*GROUP, "value")
        out.append(quantiles.percentiles(quantiles.merged(quantiles.sketches(df, GROUP, "value"), GROUP, df.rdd.getNumPartitions()), GROUP))
    return out[0].unionByName(out[1])


def p5_combined(spark: SparkSession, d: str) -> DataFrame:
    """The same from sketches made for each month of loading on its own and then combined."""
    out = []
    for df in _measures(spark, d):
        # What a store of loads would hold: written once, numbered and combined from there.
        monthly = cut(quantiles.merged(quantiles.sketches(df, [*GROUP, "load_month"], "value"), [*GROUP, "load_month"], df.rdd.getNumPartitions()).drop("part"))
        whole, n = quantiles.numbered(monthly, "load_month")
        out.append(quantiles.percentiles(quantiles.merged(whole, GROUP, n), GROUP))
    return out[0].unionByName(out[1])


def p5_rank_error(spark: SparkSession, d: str) -> DataFrame:
    """Per sample and measure whether the exact rank of each percentile's answer lies within the stated error, counted on all values."""
    answers = cut(p5_percentiles(spark, d))
    # A row per sample and measure: sent to all tasks only where it is small.
    if small_enough(answers, 100_000):
        answers = F.broadcast(answers)
    measures = _measures(spark, d)
    rows = measures[0].unionByName(measures[1]).select(*GROUP, "value").where("value is not null and not isnan(value)").join(answers, GROUP)
    names = {f"p{round(100 * q):02d}": q for q in quantiles.PERCENTILES}
    counts = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.max("max_rank_error").alias("e"), *[F.count_if(F.col("value") < F.col(c)).alias(f"{c}_lt") for c in names], *[F.count_if(F.col("value") <= F.col(c)).alias(f"{c}_le") for c in names])
    # Equal values share ranks; the answer may claim any of them.
    off = lambda c, q: F.greatest(F.lit(0.0), F.col(f"{c}_lt") + 1 - q * F.col("n"), q * F.col("n") - F.col(f"{c}_le"))
    return counts.select(*GROUP, "n", *[(off(c, q) <= F.col("e") * F.col("n") * min(q, 1 - q) + 1).alias(f"{c}_within") for c, q in names.items()])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The MS1 scan nearest in time to each MS2 scan, within two seconds."""
    ms2 = table(spark, d, "ms2_associations").select("sample_id", F.col("scan_id").alias("ms2_scan_id"), "rt")
    ms1 = table(spark, d, "ms1_scans").select("sample_id", F.col("scan_id").alias("ms1_scan_id"), "rt")
    return nearest_time.pair_nearest(ms2, ms1, ["sample_id"], "rt", "rt", "ms2_scan_id", "ms1_scan_id", tolerance=2000)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item the documents that hold it and the longest passage."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("words").alias("longest_passage"))


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), "doc_id", "text", "source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every document of the mix and how often it occurs."""
    return _mix(spark, d).documents()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mix(spark, d).shares()


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """Per source whether the mix keeps to its budget, misses it by less than one document unless there is too little, and repeats no document too often."""
    mix = _mix(spark, d)
    largest = mix.docs.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    got = mix.documents().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("got"), F.max("copies").alias("copies"))
    rows = mix.shares().join(largest, "source", "left").join(got, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    missing = F.col("budget_tokens") - zero("got")
    return rows.select("source", (zero("got") == F.col("reached_tokens")).alias("as_planned"), (missing >= 0).alias("within_budget"), (F.col("short") | (missing <= zero("largest"))).alias("budget_used"), (zero("copies") <= zero("max_repeats")).alias("repeats_kept"))


#: Calibrated probability from which a document is flagged.
FLAG_FROM = 0.4


def _scored(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    scorer = objectionable.fit(documents, table(spark, d, "content_labels"), "doc_id", "text", "objectionable")
    return objectionable.scored(documents.withColumn("source", mixing.source_name(F.col("source"))), scorer, "doc_id", "text", keep=("source",))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents flagged for objectionable language."""
    return _scored(spark, d).where(F.col("score") >= FLAG_FROM).select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    return _scored(spark, d).select("doc_id", F.round("score", 6).alias("score"), (F.col("score") >= FLAG_FROM).alias("flagged"))


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """Flagged documents and their rate per source."""
    flagged = F.count_if(F.col("score") >= FLAG_FROM)
    return _scored(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), flagged.alias("n_flagged"), F.round(flagged / F.count(F.lit(1)), 6).alias("flagged_rate"))


QUERIES = {"p4_found": p4_found, "p4_ranked": p4_ranked, "p5_percentiles": p5_percentiles, "p5_combined": p5_combined, "p5_rank_error": p5_rank_error, "p6_found": p6_found, "p8_found": p8_found, "p8_items": p8_items, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_check": p9_check, "p10_found": p10_found, "p10_scores": p10_scores, "p10_sources": p10_sources}

_TOP5 = """
WITH b AS (
  SELECT feature_id, upper(trim(inchikey)) AS inchikey, max(score) AS score FROM ms2_annotations
  WHERE feature_id IS NOT NULL AND trim(inchikey) != '' AND score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1
  GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY score DESC, inchikey) AS rank FROM b)
"""

_WITHIN = ", ".join(f"true AS p{round(100 * q):02d}_within" for q in quantiles.PERCENTILES)

ORACLE = {
    "p5_rank_error": f"""SELECT sample_id, 'ppm_offset' AS measure, count(*) AS n, {_WITHIN} FROM ms2_associations WHERE sample_id IS NOT NULL AND ppm_offset IS NOT NULL AND NOT isnan(ppm_offset) GROUP BY sample_id
 UNION ALL SELECT sample_id, 'tic', count(*), {_WITHIN} FROM ms1_scans WHERE sample_id IS NOT NULL AND tic IS NOT NULL AND NOT isnan(tic) GROUP BY sample_id""",
    "p9_check": "SELECT source, true AS as_planned, true AS within_budget, true AS budget_used, true AS repeats_kept FROM mix_targets WHERE source IS NOT NULL",
    "p4_found": _TOP5 + "SELECT feature_id, inchikey FROM r WHERE rank <= 5",
    "p4_ranked": _TOP5 + "SELECT feature_id, inchikey, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5",
    "p6_found": """
WITH l AS (SELECT DISTINCT sample_id, scan_id AS ms2_scan_id, CAST(round(rt * 1000) AS BIGINT) AS lt FROM ms2_associations WHERE rt IS NOT NULL AND NOT isnan(rt)),
r AS (SELECT DISTINCT sample_id, scan_id AS ms1_scan_id, CAST(round(rt * 1000) AS BIGINT) AS t FROM ms1_scans WHERE rt IS NOT NULL AND NOT isnan(rt)),
p AS (SELECT l.*, r.ms1_scan_id, row_number() OVER (PARTITION BY l.sample_id, ms2_scan_id, lt ORDER BY abs(lt - t), t, ms1_scan_id) AS n
  FROM l JOIN r ON l.sample_id = r.sample_id AND r.t BETWEEN l.lt - 2000 AND l.lt + 2000)
SELECT DISTINCT sample_id, ms2_scan_id, ms1_scan_id FROM p WHERE n = 1""",
}
