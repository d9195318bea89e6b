"""MS2 spectra: background removal, parents, precursor snapping, matched peaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.functions.spectral import ppm_between
from ionloom.operators.joins import asof, ppm_join


def below_precursor(p: Column, precursor: Column, charge: Column, ppm: float = 10.0) -> Column:
    """Peaks not above the precursor; a precursor of more than one charge, or none, keeps all."""
    limit = precursor * (1 + ppm * 1e-6)
    return F.when(precursor.isNull() | (F.abs(F.coalesce(charge, F.lit(1))) > 1), p).otherwise(F.filter(p, lambda x: x["m"] <= limit))


def removed_background(fragments: DataFrame, min_percent: float = 50.0, listed_from: float = 0.05) -> DataFrame:
    """fragments (mz, fraction ...) worth listing, with removed where their share reaches min_percent."""
    removed = 100.0 * F.col("fraction") >= min_percent
    return fragments.withColumn("removed", removed).where(removed | (F.col("fraction") >= listed_from))


def without_background(peaks: DataFrame, fragments: DataFrame, by: Sequence[str], mz: str, ppm: float = 10.0) -> DataFrame:
    """Peaks that lie within ppm of no removed fragment of their group (by)."""
    named = peaks.withColumn("_n", F.monotonically_increasing_id())
    bad = fragments.where("removed").select(*by, F.col("mz").alias("_bg"))
    hit = ppm_join(named.select(*by, mz, "_n"), bad, mz, "_bg", ppm, by).select(*by, mz).distinct()
    # By value, not by the row number, which another computation might give anew.
    return peaks.join(hit, [*by, mz], "left_anti")


def resolve_parent(ms2: DataFrame, ms1: DataFrame, sample: str, parent: str, time: str, scan: str, polarity: str = "polarity") -> DataFrame:
    """ms2 with parent_scan: the scan it names if there is one, else the last MS1 scan at or before it of the same polarity."""
    known = ms1.select(sample, F.col(scan).alias("_named")).distinct()
    base = ms2.join(known, (ms2[sample] == known[sample]) & (ms2[parent] == known["_named"]), "left").select(*[ms2[c] for c in ms2.columns], "_named")
    found = asof(base, ms1.where(F.col(polarity).isNotNull()).select(sample, polarity, F.col(time).alias("_t"), F.col(scan).alias("_before")), time, "_t", "_before", [sample, polarity], width=300.0)
    return found.withColumn("parent_scan", F.coalesce("_named", "_before")).drop("_named", "_before")


def vertex(x: Sequence[Column], y: Sequence[Column]) -> tuple[Column, Column]:
    """Top of the parabola through three points; the middle one where they lie on a line."""
    d = y[0] - 2.0 * y[1] + y[2]
    delta = F.when(F.abs(d) > 1e-12, 0.5 * (y[0] - y[2]) / d).otherwise(F.lit(0.0))
    return x[1] + delta * (x[2] - x[0]) / 2.0, y[1] - 0.25 * (y[0] - y[2]) * delta


def snap_precursor(p: Column, ref: Column, ppm: float = 15.0) -> Column:
    """STRUCT<mz, shift_ppm>: the top of the local maximum nearest to ref within ppm, or ref itself where there is none."""
    near = F.array_sort(F.filter(p, lambda x: F.abs(x["m"] - ref) <= ref * (ppm * 1e-6)))
    inner = F.when(F.size(near) >= 3, F.sequence(F.lit(1), F.size(near) - 2)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get(near, i)
    tops = F.filter(inner, lambda i: (at(i)["i"] > at(i - 1)["i"]) & (at(i)["i"] > at(i + 1)["i"]))
    best = F.get(F.array_sort(F.transform(tops, lambda i: F.struct(F.abs(at(i)["m"] - ref).alias("d"), i.alias("i")))), F.lit(0))["i"]
    m, _ = vertex([at(best - 1)["m"], at(best)["m"], at(best + 1)["m"]], [at(best - 1)["i"], at(best)["i"], at(best + 1)["i"]])
    snapped = F.coalesce(m, ref)
    return F.when(ref.isNotNull(), F.struct(snapped.alias("mz"), ppm_between(snapped, ref).alias("shift_ppm")))


def matched_pairs(query: Column, library: Column, ppm: float) -> Column:
    """ARRAY<STRUCT<library_mz, query_mz>>: each library peak with the strongest query peak within ppm (lowest m/z if several)."""
    strongest = lambda m: F.get(F.array_sort(F.transform(F.filter(query, lambda q: F.abs(q["m"] - m) <= m * (ppm * 1e-6)), lambda q: F.struct((-q["i"]).alias("n"), q["m"].alias("m")))), F.lit(0))["m"]
    return F.filter(F.transform(library, lambda x: F.struct(x["m"].alias("library_mz"), strongest(x["m"]).alias("query_mz"))), lambda x: x["query_mz"].isNotNull())
