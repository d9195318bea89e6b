"""Spectral libraries as four tables: spectrum, compound, adduct_type, spectrum_metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.functions.chemistry import adduct_mz, neutral_mass, reference_mz

# Keys under which libraries give these properties, in lower case.
EXTRAS = {"adduct": ["adduct", "precursor_type", "precursor type", "ion type"], "cas": ["cas", "cas number", "cas_number", "casno", "cas#"], "hmdb": ["hmdb", "hmdb_id", "hmdb id"]}


def with_reference_mz(spectrum: DataFrame, compound: DataFrame, adduct_type: DataFrame) -> DataFrame:
    """Spectra with compound, adduct and ref_mz: the stored m/z if precise, else from formula and adduct."""
    s = spectrum.join(compound.select("compound_id", "name", "formula", "inchikey"), "compound_id").join(adduct_type.select("adduct_id", "adduct", "charge", "molecules", "delta"), "adduct_id", "left")
    calculated = adduct_mz(neutral_mass(F.col("formula")), F.col("charge"), F.col("molecules"), F.col("delta"))
    return s.withColumn("ref_mz", reference_mz(F.col("precursor_mz"), calculated))


def extras(metadata: DataFrame) -> DataFrame:
    """spectrum_id, adduct, cas, hmdb: for each the first non-blank value under any of its keys, in any case."""
    key, value = F.lower(F.trim("key")), F.nullif(F.trim("value"), F.lit(""))
    first = lambda names: F.min_by(F.when(key.isin(names), value), F.when(key.isin(names) & value.isNotNull(), F.struct(F.array_position(F.lit(names), key), "value")))
    return metadata.groupBy("spectrum_id").agg(*[first(names).alias(n) for n, names in EXTRAS.items()])
