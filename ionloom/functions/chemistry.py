"""Formulas, adducts and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Monoisotopic masses (u) of elements, of the electron and of the proton.
MASS = {
    "H": 1.00782503207, "C": 12.0, "N": 14.0030740048, "O": 15.99491461956, "P": 30.97376163, "S": 31.972071, "F": 18.99840322, "Cl": 34.96885268, "Br": 78.9183371, "I": 126.904473,
    "Na": 22.9897692809, "K": 38.96370668, "Li": 7.01600455, "Mg": 23.9850417, "Ca": 39.96259098, "Fe": 55.9349375, "Zn": 63.9291422, "Cu": 62.9295975, "Si": 27.9769265325, "B": 11.0093054, "Se": 79.9165213, "Mn": 54.9380451, "Co": 58.933195, "Ag": 106.905097,
}
ELECTRON, PROTON = 0.000548579909065, 1.007276466812
C13_DELTA = 1.0033548

# Label, polarity, charge, molecules, elements added or removed; the electrons follow from the charge.
ADDUCTS = [
    ("[M+H]+", "positive", 1, 1, {"H": 1}),
    ("[M+Na]+", "positive", 1, 1, {"Na": 1}),
    ("[M+K]+", "positive", 1, 1, {"K": 1}),
    ("[M+NH4]+", "positive", 1, 1, {"N": 1, "H": 4}),
    ("[M+H-H2O]+", "positive", 1, 1, {"H": -1, "O": -1}),
    ("[M+CH3OH+H]+", "positive", 1, 1, {"C": 1, "H": 5, "O": 1}),
    ("[M+2H]2+", "positive", 2, 1, {"H": 2}),
    ("[2M+H]+", "positive", 1, 2, {"H": 1}),
    ("[2M+Na]+", "positive", 1, 2, {"Na": 1}),
    ("[M-H]-", "negative", -1, 1, {"H": -1}),
    ("[M+Cl]-", "negative", -1, 1, {"Cl": 1}),
    ("[M+FA-H]-", "negative", -1, 1, {"C": 1, "H": 1, "O": 2}),
    ("[M+Hac-H]-", "negative", -1, 1, {"C": 2, "H": 3, "O": 2}),
    ("[M-H2O-H]-", "negative", -1, 1, {"H": -3, "O": -1}),
    ("[M-2H]2-", "negative", -2, 1, {"H": -2}),
    ("[2M-H]-", "negative", -1, 2, {"H": -1}),
]


def adduct_delta(elements: dict[str, int], charge: int) -> float:
    return sum(MASS[e] * n for e, n in elements.items()) - charge * ELECTRON


def adducts(spark: SparkSession, polarity: str | None = None) -> DataFrame:
    """adduct, polarity, charge, molecules, delta: a fixed table of 16 rows."""
    rows = [(a, p, z, n, adduct_delta(e, z)) for a, p, z, n, e in ADDUCTS if polarity in (None, p)]
    return spark.createDataFrame(rows, "adduct string, polarity string, charge int, molecules int, delta double")


def adduct_mz(neutral_mass: Column, charge: Column, molecules: Column, delta: Column) -> Column:
    return (molecules * neutral_mass + delta) / F.abs(charge)


def neutral_mass(formula: Column) -> Column:
    """Monoisotopic mass of a plain formula such as C6H12O6; NULL if it is none or names an unknown element."""
    mass = F.create_map(*[F.lit(x) for pair in MASS.items() for x in pair])
    parts = F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?\d*)"), F.lit(1))
    each = F.transform(parts, lambda p: F.try_element_at(mass, F.regexp_extract(p, "^[A-Za-z]+", 0)) * F.coalesce(F.nullif(F.regexp_extract(p, r"\d+$", 0), F.lit("")).cast("int"), F.lit(1)))
    return F.when(formula.rlike(r"^(?:[A-Z][a-z]?\d*)+$"), F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x))


def n_decimals(value: Column) -> Column:
    """Decimals of a number as it is written out."""
    return F.length(F.regexp_extract(value.cast("string"), r"\.(\d*[1-9])", 1))


def reference_mz(library_mz: Column, from_formula: Column) -> Column:
    """The stored m/z where it has four decimals or more, else the calculated one if there is one."""
    return F.when(n_decimals(library_mz) >= 4, library_mz).otherwise(F.coalesce(from_formula, library_mz))


def tidy_adduct(label: Column) -> Column:
    """Adduct labels as [M+H]+ whatever their case, brackets or written charge of one."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(label), r"^\[|\](?:1?[+-])?$|\]$", ""), r"\](\d?[+-])$", "")
    known = F.create_map(*[F.lit(x) for a, *_ in ADDUCTS for x in (a.lower()[1 : a.index("]")], a)])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_replace(bare, r"\]\d?[+-]?$", ""))), F.trim(label))


def pixel_area(n_pixels: Column, pixel_size: Column) -> Column:
    """Area in squared units of the pixel size; NULL where a size is not positive."""
    return F.when((n_pixels >= 0) & (pixel_size > 0), n_pixels * pixel_size * pixel_size)


def concentration(amount: Column, area: Column) -> Column:
    return F.when(area > 0, amount / area)


def amount(conc: Column, area: Column) -> Column:
    return conc * area


def area_factor(from_unit: Column, to_unit: Column) -> Column:
    """Factor from one squared length unit (um, mm) to another; NULL for others."""
    return F.when(from_unit == to_unit, 1.0).when((from_unit == "mm") & (to_unit == "um"), 1e6).when((from_unit == "um") & (to_unit == "mm"), 1e-6)


def concentration_unit(amount_unit: Column, size_unit: Column) -> Column:
    return F.concat(amount_unit, F.lit("/"), size_unit, F.lit("2"))
