"""Queries of the training-data problems whose operators belong to the core (p1, p2, p3, p7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.operators import drift, intervals, references, wide
from ionloom.operators.lifecycle import latest
from ionloom.session import stored
from ionloom.sources.tables import table

PIXEL = ["sample_id", "pixel_id"]


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    """metadata as one row per sample with typed attributes."""
    attrs = wide.attributes(table(spark, d, "metadata_attrs"))
    return wide.stitch(table(spark, d, "metadata"), attrs, "sample_id", "key", "value")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the wide table that cannot be filled without doubt."""
    attrs = wide.attributes(table(spark, d, "metadata_attrs"))
    return wide.issues(p1_wide(spark, d), attrs, "sample_id")


def _dwells(spark: SparkSession, d: str) -> DataFrame:
    return intervals.valid_dwells(table(spark, d, "spatial_pixels"), PIXEL, "t_start", "t_end", 1000)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Times between neighbouring periods of a pixel."""
    return intervals.gaps(_dwells(spark, d), PIXEL).select(*PIXEL, F.col("gap_start").alias("gap_start_ms"), F.col("gap_end").alias("gap_end_ms"))


def p3_periods(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods of each pixel."""
    return intervals.periods(_dwells(spark, d), PIXEL).select(*PIXEL, F.col("period_start").alias("period_start_ms"), F.col("period_end").alias("period_end_ms"))


def _references(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, list[str], DataFrame, list[str]]]:
    """(table, child rows as ref_table's columns, key, parents, parents' key)."""
    features = table(spark, d, "features").select("feature_id")
    scans = table(spark, d, "ms1_scans").select("sample_id", "scan_id")
    ms2 = table(spark, d, "ms2_associations").select("sample_id", F.col("id").alias("row_key"), F.col("feature_id").alias("missing_key"), "loaded_at")
    iso = table(spark, d, "feature_isotopes").select(F.lit(0).cast("bigint").alias("sample_id"), F.col("feature_id").alias("row_key"), F.col("mono_feature_id").alias("missing_key"), "loaded_at")
    pix = table(spark, d, "pixel_ms1_scans").select("sample_id", F.col("pixel_id").alias("row_key"), F.col("scan_id").alias("missing_key"), "loaded_at")
    return [
        ("ms2_associations", ms2, ["missing_key"], features, ["feature_id"]),
        ("feature_isotopes", iso, ["missing_key"], features, ["feature_id"]),
        ("pixel_ms1_scans", pix, ["sample_id", "missing_key"], scans, ["sample_id", "scan_id"]),
    ]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    parts = [references.orphan_rows(child, key, parent, parent_key).select(F.lit(name).alias("ref_table"), "sample_id", "row_key", "missing_key", "loaded_at") for name, child, key, parent, parent_key in _references(spark, d)]
    return reduce(DataFrame.unionByName, parts)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose reference leads nowhere; rows delivered twice come out once."""
    return _orphans(spark, d).select("ref_table", "sample_id", "row_key", "missing_key").distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan rows and distinct missing keys per table and month of loaded_at."""
    rows = _orphans(spark, d).withColumn("missing", F.concat_ws(":", F.when(F.col("ref_table") == "pixel_ms1_scans", F.col("sample_id")), "missing_key"))
    return references.by_period(rows, ["ref_table"], F.date_format("loaded_at", "yyyy-MM"), "missing").withColumnRenamed("period", "month")


#: Target schemas of the exported tables; loaded_at is the line's own.
TARGETS = {
    "ms2_associations": {"id": "bigint", "sample_id": "bigint", "scan_id": "bigint", "feature_id": "bigint", "match_key": "string", "precursor_mz": "double", "isolation_window_target": "double", "ppm_offset": "double", "rt": "double", "collision_energy": "double", "n_peaks": "int", "polarity": "string", "fragmentation_factor": "double", "flat_fragmentation": "int"},
    "ms2_annotations": {"id": "bigint", "sample_id": "bigint", "scan_id": "bigint", "feature_id": "bigint", "library_id": "int", "library_spectrum_id": "bigint", "compound_id": "bigint", "compound_name": "string", "compound_formula": "string", "inchikey": "string", "adduct": "string", "score": "double", "dot_product_score": "double", "lib_coverage": "double", "n_matched_peaks": "int", "rank_ms2": "int", "fragmentation_factor": "double"},
}
#: Fields that were not foreseen and have since been approved as columns.
PROMOTED = {"ms2_associations": {}, "ms2_annotations": {"purity_score": "double", "cas": "string"}}
SERIES = ["exporter", "table_name"]


def _export_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line held against the schema of its own table."""
    return drift.ingest(table(spark, d, "raw_exports"), "payload", TARGETS, of="table_name")


def _export_changes(ingested: DataFrame) -> DataFrame:
    return drift.changes(ingested, SERIES, "file_name", "exported_at", "id", ["loaded_at", "line_id"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a field between neighbouring files of an exporter, from what ingestion has seen of each line."""
    return _export_changes(_export_lines(spark, d)).select(*SERIES, "file_name", "prev_name", "new_name", "change_kind").distinct()


def p2_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Lines that could not be read, and why, and those read of which a repeated field's last value counts."""
    rows = _export_lines(spark, d).where("_reason is not null")
    return rows.select("line_id", *SERIES, "file_name", F.col("_reason").alias("reason"), F.col("_seen").isNotNull().alias("is_read"))


def p2_rescued(spark: SparkSession, d: str) -> DataFrame:
    """Fields kept as JSON per file, as they are unknown or of another kind than their column, and in how many lines."""
    seen = _export_lines(spark, d).select(*SERIES, "file_name", F.explode("_seen").alias("x")).where("x.place = 'rescued'")
    return seen.groupBy(*SERIES, "file_name", F.col("x.name").alias("field")).agg(F.count(F.lit(1)).alias("n_lines"))


def _exported(spark: SparkSession, d: str, name: str) -> DataFrame:
    lines = table(spark, d, "raw_exports").where(F.col("table_name") == name)
    wider = TARGETS[name] | PROMOTED[name]
    first = drift.ingest(lines, "payload", TARGETS[name]).where("_seen is not null")
    # Fields to promote are those that reported renames lead to from a column, or that are spelt like one; names that are neither stay with the executors.
    spelt = {c.replace("_", "").lower() for c in wider}
    seen = first.select(*SERIES, "file_name", "exported_at", "loaded_at", "line_id", "_seen")
    alike = seen.select(F.explode("_seen").alias("x")).where("x.place = 'rescued'").select("x.name").where(drift.plain_name(F.col("name")).isin(list(spelt))).distinct()
    names = [r["name"] for r in alike.collect()]
    renames = stored(_export_changes(seen).where("change_kind = 'renamed'").select("prev_name", "new_name").distinct())
    approved = drift.approvals(drift.linked(renames, [*wider, *names]), wider, names)
    return drift.replay(first.drop("_seen", "_reason", "table_name"), wider, approved)


def p2_associations(spark: SparkSession, d: str) -> DataFrame:
    """The exported rows of ms2_associations in one schema, with what could not be placed."""
    return _exported(spark, d, "ms2_associations")


def p2_annotations(spark: SparkSession, d: str) -> DataFrame:
    """The exported rows of ms2_annotations in one schema, with what could not be placed."""
    return _exported(spark, d, "ms2_annotations")


def p2_associations_latest(spark: SparkSession, d: str) -> DataFrame:
    """Of each exported record of ms2_associations what the last file of its exporter says."""
    return latest(p2_associations(spark, d).where("id is not null"), ["exporter", "id"], ["exported_at", "loaded_at", "line_id"])


def p2_annotations_latest(spark: SparkSession, d: str) -> DataFrame:
    """Of each exported record of ms2_annotations what the last file of its exporter says."""
    return latest(p2_annotations(spark, d).where("id is not null"), ["exporter", "id"], ["exported_at", "loaded_at", "line_id"])


QUERIES = {"p2_found": p2_found, "p2_rejected": p2_rejected, "p2_rescued": p2_rescued, "p2_associations": p2_associations, "p2_annotations": p2_annotations, "p2_associations_latest": p2_associations_latest, "p2_annotations_latest": p2_annotations_latest, "p1_found": p1_found, "p1_wide": p1_wide, "p3_found": p3_found, "p3_periods": p3_periods, "p7_found": p7_found, "p7_report": p7_report}

_CELLS = """
WITH names AS (
  SELECT attr, value_type, unit_name, unit_factors, regexp_replace(lower(n), '[^\\p{L}\\p{N}]', '', 'g') AS k
  FROM (SELECT *, unnest(list_append(also_known_as, attr)) AS n FROM metadata_attrs)
), v AS (
  SELECT sample_id, attr, value_type, unit_name, unit_factors, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS x
  FROM metadata JOIN names ON regexp_replace(lower(key), '[^\\p{L}\\p{N}]', '', 'g') = k WHERE sample_id IS NOT NULL
), st AS (
  SELECT * FROM v WHERE x IS NOT NULL AND x != '' AND lower(x) NOT IN (@NOTHING@)
), r AS (
  SELECT *,
    CASE WHEN value_type = 'double' THEN TRY_CAST(replace(regexp_extract(x, '^([+-]?(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:[eE][+-]?[0-9]+)?)\\s*([^0-9].*)?$', 1), ',', '.') AS DOUBLE)
      * CASE WHEN regexp_extract(x, '^([+-]?(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:[eE][+-]?[0-9]+)?)\\s*([^0-9].*)?$', 2) = '' THEN 1.0
        ELSE map_extract(unit_factors, regexp_extract(x, '^([+-]?(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:[eE][+-]?[0-9]+)?)\\s*([^0-9].*)?$', 2))[1] END END AS dv,
    CASE WHEN value_type = 'int' THEN
      CASE WHEN regexp_matches(x, '^[+-]?[0-9]{1,3}([, ][0-9]{3})+(\\.0*)?$') THEN TRY_CAST(regexp_replace(regexp_extract(x, '^[^.]*'), '[, ]', '', 'g') AS BIGINT)
        WHEN regexp_matches(x, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') AND TRY_CAST(x AS DOUBLE) = floor(TRY_CAST(x AS DOUBLE)) THEN CAST(TRY_CAST(x AS DOUBLE) AS BIGINT) END END AS lv,
    CASE WHEN value_type = 'boolean' THEN CASE WHEN lower(x) IN ('true','t','yes','y','on','1') THEN 1 WHEN lower(x) IN ('false','f','no','n','off','0') THEN 0 END END AS bv,
    CASE WHEN value_type = 'timestamp' THEN
      CASE WHEN regexp_matches(x, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}') THEN TRY_CAST(CASE WHEN regexp_matches(x, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN x ELSE x || 'Z' END AS TIMESTAMPTZ)
        WHEN regexp_matches(x, '^[0-9]{2}\\.[0-9]{2}\\.[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}$') THEN TRY_CAST(substr(x, 7, 4) || '-' || substr(x, 4, 2) || '-' || substr(x, 1, 2) || substr(x, 11) || 'Z' AS TIMESTAMPTZ) END END AS tv,
    CASE WHEN value_type = 'string' THEN lower(x) END AS sv
  FROM st
), c AS (
  SELECT sample_id, attr,
    CASE WHEN count(dv) + count(lv) + count(bv) + count(tv) + count(sv) = 0 THEN 'unreadable'
      WHEN max(dv) - min(dv) > 1e-4 * greatest(abs(max(dv)), abs(min(dv))) OR min(lv) != max(lv) OR min(bv) != max(bv) OR min(tv) != max(tv) OR min(sv) != max(sv) THEN 'conflict' END AS issue
  FROM r GROUP BY sample_id, attr
)"""

_CELLS = _CELLS.replace("@NOTHING@", ", ".join(f"'{x}'" for x in wide.STATES_NOTHING))

#: Valid lines with their fields: kind as a bit, value as text that is the same for equal values of one kind.
_LINES = """
WITH RECURSIVE ln AS (
  SELECT exporter AS ex, table_name AS tb, file_name AS fn, exported_at, loaded_at, line_id, payload FROM raw_exports WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END
), fl AS (
  SELECT ex, tb, fn, exported_at, loaded_at, line_id, key AS name, kind, CASE kind WHEN 0 THEN NULL WHEN 1 THEN 's' || (v ->> '$') WHEN 2 THEN 'n' || CAST(v AS DOUBLE) ELSE 'j' || CAST(v AS VARCHAR) END AS val, v, jt FROM (
    SELECT *, CASE jt WHEN 'NULL' THEN 0 WHEN 'VARCHAR' THEN 1 WHEN 'BOOLEAN' THEN 4 WHEN 'ARRAY' THEN 8 WHEN 'OBJECT' THEN 16 ELSE 2 END AS kind FROM (
      SELECT *, json_extract(payload, '$."' || key || '"') AS v, json_type(payload, '$."' || key || '"') AS jt FROM (SELECT *, unnest(list_distinct(json_keys(payload))) AS key FROM ln)))
)"""
_CHANGES = _LINES + """, fi AS (
  SELECT ex, tb, fn, row_number() OVER (PARTITION BY ex, tb ORDER BY min(exported_at), fn) AS n FROM fl GROUP BY ex, tb, fn
), fd AS (SELECT ex, tb, n, fn, name, bit_or(kind) AS kinds FROM fl JOIN fi USING (ex, tb, fn) GROUP BY ALL
), df AS (
  SELECT i.ex, i.tb, i.n, i.fn, coalesce(c.name, p.name) AS name, c.name IS NOT NULL AS here, p.name IS NOT NULL AS before, c.kinds FROM fi i, LATERAL (SELECT DISTINCT name FROM fd f WHERE f.ex = i.ex AND f.tb = i.tb AND f.n IN (i.n, i.n - 1)) a
  LEFT JOIN fd c ON c.ex = i.ex AND c.tb = i.tb AND c.n = i.n AND c.name = a.name LEFT JOIN fd p ON p.ex = i.ex AND p.tb = i.tb AND p.n = i.n - 1 AND p.name = a.name WHERE i.n > 1
), li AS (SELECT ex, tb, n, line_id, val AS id, row_number() OVER (PARTITION BY ex, tb, n, val ORDER BY loaded_at DESC, line_id DESC) AS rn FROM fl JOIN fi USING (ex, tb, fn) WHERE name = 'id' AND val IS NOT NULL
), rc AS (SELECT li.ex, li.tb, li.n, id, name, val FROM li JOIN fl USING (line_id) WHERE rn = 1 AND val IS NOT NULL
), co AS (SELECT c.ex, c.tb, c.n, c.id FROM li c JOIN li p ON p.ex = c.ex AND p.tb = c.tb AND p.n = c.n - 1 AND p.id = c.id WHERE c.rn = 1 AND p.rn = 1
), sg AS (
  SELECT df.ex, df.tb, df.n, df.here, df.name, string_agg(co.id || '=' || rc.val, chr(1) ORDER BY co.id) AS sig FROM df JOIN co ON co.ex = df.ex AND co.tb = df.tb AND co.n = df.n
  JOIN rc ON rc.ex = df.ex AND rc.tb = df.tb AND rc.n = CASE WHEN df.here THEN df.n ELSE df.n - 1 END AND rc.id = co.id AND rc.name = df.name WHERE df.here != df.before GROUP BY ALL
), sr AS (SELECT *, row_number() OVER (PARTITION BY ex, tb, n, here, sig ORDER BY name) AS k FROM sg
), rn AS (SELECT o.ex, o.tb, o.n, o.name AS prev_name, w.name AS new_name FROM sr o JOIN sr w ON w.ex = o.ex AND w.tb = o.tb AND w.n = o.n AND w.sig = o.sig AND w.k = o.k AND w.here AND NOT o.here
), mk AS (SELECT ex, tb, n, new_name AS name, prev_name AS parent FROM rn UNION ALL SELECT ex, tb, n, prev_name, NULL FROM rn
), tr AS (
  SELECT ex, tb, n, name, kinds, name AS cur, n - 1 AS upto FROM df WHERE here AND before AND kinds != 0
  UNION ALL
  SELECT t.ex, t.tb, t.n, t.name, t.kinds, m.parent, m.n - 1 FROM tr t JOIN mk m ON m.ex = t.ex AND m.tb = t.tb AND m.name = t.cur AND m.n <= t.upto AND m.parent IS NOT NULL
  WHERE NOT EXISTS (SELECT 1 FROM mk l WHERE l.ex = t.ex AND l.tb = t.tb AND l.name = t.cur AND l.n > m.n AND l.n <= t.upto) AND NOT EXISTS (SELECT 1 FROM fd f WHERE f.ex = t.ex AND f.tb = t.tb AND f.name = t.cur AND f.n BETWEEN m.n AND t.upto AND f.kinds != 0)
), ts AS (SELECT tr.*, coalesce((SELECT max(mk.n) FROM mk WHERE mk.ex = tr.ex AND mk.tb = tr.tb AND mk.name = tr.cur AND mk.n <= tr.upto), 0) AS since FROM tr
), wa AS (SELECT ts.ex, ts.tb, ts.n, ts.name, ts.kinds, arg_max(f.kinds, f.n) AS was FROM ts JOIN fd f ON f.ex = ts.ex AND f.tb = ts.tb AND f.name = ts.cur AND f.n BETWEEN ts.since AND ts.upto AND f.kinds != 0 GROUP BY ALL
), ch AS (
  SELECT ex, tb, n, CASE WHEN here THEN '' ELSE name END AS prev_name, CASE WHEN here THEN name ELSE '' END AS new_name, CASE WHEN here THEN 'added' ELSE 'removed' END AS change_kind FROM df WHERE here != before
    AND NOT EXISTS (SELECT 1 FROM rn WHERE rn.ex = df.ex AND rn.tb = df.tb AND rn.n = df.n AND CASE WHEN df.here THEN rn.new_name ELSE rn.prev_name END = df.name)
  UNION ALL SELECT ex, tb, n, prev_name, new_name, 'renamed' FROM rn
  UNION ALL SELECT ex, tb, n, name, name, 'type_changed' FROM wa WHERE kinds & ~was != 0
)"""
_OWN_KIND = " ".join(f"WHEN tb = '{t}' AND name = '{c}' THEN " + {"bigint": "kind = 2 AND (jt != 'DOUBLE' OR TRY_CAST(v AS DOUBLE) = floor(TRY_CAST(v AS DOUBLE)))", "int": "kind = 2 AND (jt != 'DOUBLE' OR TRY_CAST(v AS DOUBLE) = floor(TRY_CAST(v AS DOUBLE))) AND abs(TRY_CAST(v AS DOUBLE)) < 2147483648", "double": "kind = 2", "string": "kind = 1"}[k] for t, of in TARGETS.items() for c, k in of.items())

_DWELLS = """
WITH dw AS (
  SELECT sample_id, pixel_id, CAST(round(t_start * 1000) AS BIGINT) AS s, CAST(round(t_end * 1000) AS BIGINT) AS e
  FROM spatial_pixels
  WHERE sample_id IS NOT NULL AND pixel_id IS NOT NULL AND t_start IS NOT NULL AND t_end IS NOT NULL
    AND NOT isnan(t_start) AND NOT isnan(t_end) AND t_end >= t_start
), m AS (
  SELECT *, max(e) OVER (PARTITION BY sample_id, pixel_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM dw
)"""

_ORPHANS = """
WITH o AS (
  SELECT 'ms2_associations' AS ref_table, sample_id, id AS row_key, feature_id AS missing_key, loaded_at, CAST(feature_id AS VARCHAR) AS missing
  FROM ms2_associations a WHERE feature_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM features f WHERE f.feature_id = a.feature_id)
  UNION ALL
  SELECT 'feature_isotopes', 0, feature_id, mono_feature_id, loaded_at, CAST(mono_feature_id AS VARCHAR)
  FROM feature_isotopes a WHERE mono_feature_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM features f WHERE f.feature_id = a.mono_feature_id)
  UNION ALL
  SELECT 'pixel_ms1_scans', sample_id, pixel_id, scan_id, loaded_at, sample_id || ':' || scan_id
  FROM pixel_ms1_scans a WHERE scan_id IS NOT NULL AND sample_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM ms1_scans f WHERE f.scan_id = a.scan_id AND f.sample_id = a.sample_id)
)"""

ORACLE = {
    "p2_found": _CHANGES + " SELECT DISTINCT ex AS exporter, tb AS table_name, fn AS file_name, prev_name, new_name, change_kind FROM ch JOIN fi USING (ex, tb, n)",
    "p2_rejected": """SELECT line_id, exporter, table_name, file_name, reason, reason = 'repeated field' AS is_read FROM (
  SELECT *, CASE WHEN payload IS NULL OR trim(payload) = '' THEN 'empty' WHEN NOT json_valid(payload) THEN 'no JSON' WHEN json_type(payload) != 'OBJECT' THEN 'no object' WHEN len(json_keys(payload)) > len(list_distinct(json_keys(payload))) THEN 'repeated field' END AS reason FROM raw_exports) WHERE reason IS NOT NULL""",
    "p2_rescued": _LINES + f" SELECT ex AS exporter, tb AS table_name, fn AS file_name, name AS field, count(*) AS n_lines FROM fl WHERE kind != 0 AND NOT (CASE {_OWN_KIND} ELSE false END) GROUP BY ALL",
    "p1_found": _CELLS + " SELECT sample_id, attr, issue FROM c WHERE issue IS NOT NULL",
    "p3_found": _DWELLS + " SELECT DISTINCT sample_id, pixel_id, before AS gap_start_ms, s AS gap_end_ms FROM m WHERE s > before",
    "p3_periods": _DWELLS + """, g AS (
  SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id, pixel_id ORDER BY s, e) AS n FROM m
) SELECT sample_id, pixel_id, min(s) AS period_start_ms, max(e) AS period_end_ms FROM g GROUP BY sample_id, pixel_id, n""",
    "p7_found": _ORPHANS + " SELECT DISTINCT ref_table, sample_id, row_key, missing_key FROM o",
    "p7_report": _ORPHANS + " SELECT ref_table, strftime(loaded_at, '%Y-%m') AS month, count(*) AS n_rows, count(DISTINCT missing) AS n_keys FROM o GROUP BY ref_table, strftime(loaded_at, '%Y-%m')",
}
