"""Sum formulas for a mass: every composition within bounds, found by joins.

A composition without its hydrogens (C, N, O, P, S and, if asked for, halogens)
has a fixed mass; what is left of the target must be a whole number of hydrogen
atoms. Both are therefore joined by where they lie between two multiples of the
hydrogen mass, in small buckets, so no target meets all compositions but those
near it. The table of compositions depends on the bounds alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionloom.functions.chemistry import MASS, adducts

#: Most atoms of each element but hydrogen.
BOUNDS = {"C": 60, "N": 8, "O": 16, "P": 2, "S": 2}
HALOGENS = {"F": 3, "Cl": 3, "Br": 2, "I": 1}
# Most atoms per carbon atom in common organic molecules; hydrogens from and to.
RATIOS = {"N": 1.3, "O": 1.2, "P": 0.3, "S": 0.8, "F": 1.5, "Cl": 0.8, "Br": 0.8, "I": 0.8}
HYDROGENS = (0.1, 3.1)


def compositions(spark: SparkSession, bounds: Mapping[str, int], heaviest: float) -> DataFrame:
    """A column per element and _rest, the mass without hydrogens; at least one carbon, common ratios, no heavier than heaviest."""
    df = spark.range(1, bounds["C"] + 1).select(F.col("id").cast("int").alias("C"))
    mass = F.col("C") * MASS["C"]
    for e, most in bounds.items():
        if e == "C":
            continue
        upto = F.least(F.lit(most), F.floor(F.col("C") * RATIOS[e]).cast("int"))
        df = df.withColumn(e, F.explode(F.sequence(F.lit(0), upto)))
        mass = mass + F.col(e) * MASS[e]
        df = df.where(mass <= heaviest)
    return df.withColumn("_rest", mass)


def written(elements: Sequence[str]) -> Column:
    """The formula as text: carbon, hydrogen, then the others by name."""
    order = ["C", "H", *sorted(e for e in elements if e != "C")]
    part = lambda e: F.when(F.col(e) > 1, F.concat(F.lit(e), F.col(e).cast("string"))).when(F.col(e) == 1, F.lit(e)).otherwise(F.lit(""))
    return F.concat(*map(part, order))


def predict(features: DataFrame, labels: Sequence[str], error_ppm: float = 10.0, top_n: int = 5, halogen: bool = False, bounds: Mapping[str, int] = BOUNDS, heaviest: float = 1500.0) -> DataFrame:
    """feature_id, adduct, formula, mass_error, mass_error_ppm, rank: up to top_n neutral formulas per feature and adduct within error_ppm of its m/z, by distance (then formula).

    A formula has a whole number, not below 0, of rings and double bonds, and
    common ratios of its elements to carbon. Features without a positive m/z,
    and ions that would be heavier than heaviest, get none. labels: adducts by
    name; an unknown one, an empty list, a top_n below 1 or a tolerance that is
    not positive is refused.
    """
    spark = features.sparkSession
    known = {r["adduct"]: r for r in adducts(spark).collect()}
    if not labels or not set(labels) <= set(known) or top_n < 1 or error_ppm <= 0:
        raise ValueError("adducts (known ones), a top_n of 1 or more and a tolerance above 0 are needed")
    bounds = dict(bounds) | (HALOGENS if halogen else {})
    h = MASS["H"]
    ions = F.explode(F.array(*[F.struct(F.lit(a).alias("adduct"), F.lit(known[a]["charge"]).alias("charge"), F.lit(known[a]["molecules"]).alias("molecules"), F.lit(known[a]["delta"]).alias("delta")) for a in dict.fromkeys(labels)])).alias("a")
    asked = features.where("mz > 0 and not isnan(mz)").select("feature_id", "mz", ions).select("feature_id", "mz", "a.*")
    asked = asked.withColumn("_mass", (F.col("mz") * F.abs("charge") - F.col("delta")) / F.col("molecules")).withColumn("_tol", F.col("mz") * F.abs("charge") / F.col("molecules") * (error_ppm * 1e-6)).where(F.col("_mass").between(MASS["C"], heaviest))
    # Where a mass lies between two multiples of the hydrogen mass, in buckets of some two thousandths of a dalton.
    buckets = 500
    at = lambda m: F.floor(m / F.lit(h / buckets)).cast("int")
    part = F.pmod(F.col("_mass"), F.lit(h))
    near = F.explode(F.array_distinct(F.transform(F.sequence(at(part - F.col("_tol")), at(part + F.col("_tol"))), lambda b: F.pmod(b, F.lit(buckets)))))
    table = compositions(spark, bounds, heaviest).withColumn("_b", F.pmod(at(F.pmod("_rest", F.lit(h))), F.lit(buckets)))
    met = asked.withColumn("_b", near).join(table, "_b").where("_rest <= _mass + _tol")
    met = met.withColumn("H", F.round((F.col("_mass") - F.col("_rest")) / h).cast("int"))
    off = F.col("_rest") + F.col("H") * h - F.col("_mass")
    met = met.withColumn("_off", -off).where(F.abs("_off") <= F.col("_tol"))
    odd = F.col("H") + sum((F.col(e) for e in bounds if e in HALOGENS), F.lit(0))
    double = 2 * F.col("C") + 2 + sum((F.col(e) for e in ("N", "P") if e in bounds), F.lit(0)) - odd
    met = met.where((double >= 0) & (double % 2 == 0) & F.col("H").between(HYDROGENS[0] * F.col("C"), HYDROGENS[1] * F.col("C")))
    error = F.col("_off") * F.col("molecules") / F.abs("charge")
    rows = met.select("feature_id", "adduct", written(list(bounds)).alias("formula"), error.alias("mass_error"), (error / (F.col("mz") - error) * 1e6).alias("mass_error_ppm"))
    rank = F.row_number().over(Window.partitionBy("feature_id", "adduct").orderBy(F.round(F.abs("mass_error_ppm"), 6), "formula"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top_n)
