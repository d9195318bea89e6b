"""Expressions on spectra held as parallel arrays; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ppm_between(mz: Column, ref: Column) -> Column:
    """Signed distance of mz from ref in ppm."""
    return (mz - ref) / ref * 1e6


def normalize_polarity(value: Column) -> Column:
    """POSITIVE, NEGATIVE or NULL from free text."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("+", "p", "1", "1+", "+1") | v.startswith("pos"), F.lit("POSITIVE")).when(v.isin("-", "n", "-1", "1-") | v.startswith("neg"), F.lit("NEGATIVE"))


def peaks(mz: Column, intensity: Column) -> Column:
    """ARRAY<STRUCT<m, i>> of doubles."""
    return F.zip_with(mz, intensity, lambda m, i: F.struct(m.cast("double").alias("m"), i.cast("double").alias("i")))


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x["i"])


def noise_filtered(p: Column, threshold: float) -> Column:
    """Peaks scaled to the largest, those under threshold left out (a peak at the threshold stays); an all-zero spectrum unchanged."""
    top = F.array_max(F.transform(p, lambda x: x["i"]))
    scaled = F.when(top > 0, F.transform(p, lambda x: F.struct(x["m"].alias("m"), (x["i"] / top).alias("i")))).otherwise(p)
    return F.when(top > 0, F.filter(scaled, lambda x: x["i"] >= threshold)).otherwise(p)


def fragmentation_factor(p: Column, precursor: Column, tolerance: float = 2.0) -> Column:
    """1 - share of the intensity within tolerance (Da) of the precursor; NULL for an empty or dark spectrum or no precursor."""
    all_of = total(p)
    near = total(F.filter(p, lambda x: F.abs(x["m"] - precursor) <= tolerance))
    return F.when(precursor.isNotNull() & (all_of > 0), 1.0 - near / all_of)


def is_flat(p: Column, min_peaks: int = 3, cv: float = 0.2, min_relative: float = 0.01) -> Column:
    """Whether the peaks of at least min_relative of the base peak are min_peaks or more and vary by no more than cv (population)."""
    top = F.array_max(F.transform(p, lambda x: x["i"]))
    kept = F.filter(p, lambda x: x["i"] >= top * min_relative)
    n = F.size(kept)
    mean = total(kept) / n
    spread = F.sqrt(F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + (x["i"] - mean) * (x["i"] - mean)) / n)
    return F.coalesce((top > 0) & (n >= min_peaks) & (spread / mean <= cv), F.lit(False))


def base_peak(p: Column) -> Column:
    """m/z of the most intense peak (lowest m/z if several)."""
    return F.aggregate(p, F.struct(F.lit(None).cast("double").alias("m"), F.lit(-1.0).alias("i")), lambda acc, x: F.when((x["i"] > acc["i"]) | ((x["i"] == acc["i"]) & (x["m"] < acc["m"])), F.struct(x["m"].alias("m"), x["i"].alias("i"))).otherwise(acc))["m"]


def window_bounds(target: Column, lower: Column, upper: Column, half: float) -> Column:
    """STRUCT<lo, hi>; offsets that are missing, NaN or not positive count as half."""
    real = lambda c: F.when((c > 0) & ~F.isnan(c), c).otherwise(F.lit(half))
    return F.struct((target - real(lower)).alias("lo"), (target + real(upper)).alias("hi"))


def _strongest_within(peaks_: Column, m: Column, ppm: float) -> Column:
    """Intensity of the most intense peak within ppm of m, NULL if none."""
    return F.array_max(F.transform(F.filter(peaks_, lambda q: F.abs(q["m"] - m) <= m * (ppm * 1e-6)), lambda q: q["i"]))


def reverse_dot_product(query: Column, library: Column, ppm: float = 10.0, mz_power: float = 2.0, intensity_power: float = 0.5, noise: float = 0.01, weights: tuple[float, float, float] = (1.0, 0.5, 0.5)) -> Column:
    """STRUCT<score, dot_product_score, lib_coverage, emp_coverage, n_matched_peaks, n_lib_peaks>.

    Cosine on the library's peaks times powers of the shares of library and
    query peaks that have a partner. No peaks on either side: all zero.
    """
    sides = F.struct(noise_filtered(query, noise).alias("q"), noise_filtered(library, noise).alias("l"))
    return bound(sides, lambda x: filtered_dot_product(x["q"], x["l"], ppm, mz_power, intensity_power, weights))


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def filtered_dot_product(q: Column, l: Column, ppm: float = 10.0, mz_power: float = 2.0, intensity_power: float = 0.5, weights: tuple[float, float, float] = (1.0, 0.5, 0.5)) -> Column:  # noqa: E741
    """reverse_dot_product of peaks whose noise is off already; q and l should be columns, not expressions, as they are named per peak."""
    weigh = lambda m, i: F.pow(i, F.lit(intensity_power)) * F.pow(m, F.lit(mz_power))
    zero = F.lit(0.0)

    def add(acc: Column, x: Column) -> Column:
        # The partner's intensity is looked up once per library peak.
        return bound(F.struct(weigh(x["m"], x["i"]).alias("w"), _strongest_within(q, x["m"], ppm).alias("i")), lambda p: bound(F.coalesce(weigh(x["m"], p["i"]), zero), lambda v: F.struct((acc["lq"] + p["w"] * v).alias("lq"), (acc["ll"] + p["w"] * p["w"]).alias("ll"), (acc["qq"] + v * v).alias("qq"), (acc["n"] + F.when(p["i"].isNotNull(), 1).otherwise(0)).alias("n"))))

    sums = F.aggregate(l, F.struct(zero.alias("lq"), zero.alias("ll"), zero.alias("qq"), F.lit(0).alias("n")), add)
    emp = F.size(F.filter(q, lambda x: F.exists(l, lambda y: F.abs(y["m"] - x["m"]) <= x["m"] * (ppm * 1e-6))))
    w_dot, w_lib, w_emp = weights

    def parts(s: Column) -> Column:
        norm = F.sqrt(s["sums"]["ll"]) * F.sqrt(s["sums"]["qq"])
        dot = F.when(norm > 0, F.least(F.lit(1.0), F.greatest(zero, s["sums"]["lq"] / norm))).otherwise(zero)
        lib_cov = F.when(s["n_lib"] > 0, s["sums"]["n"] / s["n_lib"]).otherwise(zero)
        emp_cov = F.when(s["n_emp"] > 0, s["emp"] / s["n_emp"]).otherwise(zero)
        return F.struct(dot.alias("dot"), lib_cov.alias("lib"), emp_cov.alias("emp"), s["sums"]["n"].alias("n"), s["n_lib"].alias("n_lib"))

    def whole(p: Column) -> Column:
        score = F.least(F.lit(1.0), F.pow(p["dot"], F.lit(w_dot)) * F.pow(p["lib"], F.lit(w_lib)) * F.pow(p["emp"], F.lit(w_emp)))
        return F.struct(score.alias("score"), p["dot"].alias("dot_product_score"), p["lib"].alias("lib_coverage"), p["emp"].alias("emp_coverage"), p["n"].alias("n_matched_peaks"), p["n_lib"].alias("n_lib_peaks"))

    # Where no library peak has a partner none of the query's has.
    return bound(bound(bound(sums, lambda s: F.struct(s.alias("sums"), F.when(s["n"] > 0, emp).otherwise(F.lit(0)).alias("emp"), F.size(q).alias("n_emp"), F.size(l).alias("n_lib"))), parts), whole)


def peak_term(n_peaks: Column, target: float) -> Column:
    return F.lit(1.0) if target <= 0 else F.least(F.lit(1.0), n_peaks / F.lit(float(target)))


def purity_term(purity: Column, neutral: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(purity, F.lit(neutral))))


def log_bin(mz: Column, ppm: float) -> Column:
    return F.floor(F.log(mz) / F.log1p(F.lit(ppm * 1e-6))).cast("bigint")


def max_m1_ratio(mz: Column, charge: Column) -> Column:
    """Largest plausible M+1 intensity relative to M."""
    return 1.1 * 0.0107 * (mz * charge / 14.0) + 0.02


def purity_fraction(p: Column, lo: Column, hi: Column, ref: Column, band_ppm: float = 25.0, baseline: float = 0.1) -> Column:
    """Share of the window's intensity above its baseline (a linear percentile) that lies within band_ppm of ref; 0 without signal."""
    inside = F.array_sort(F.transform(F.filter(p, lambda x: x["m"].between(lo, hi)), lambda x: F.struct(x["i"].alias("i"), x["m"].alias("m"))))
    n = F.size(inside)
    at = (n - 1) * F.lit(baseline)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    i_at = lambda k: F.get(inside, k)["i"]
    base = i_at(low) + (i_at(high) - i_at(low)) * (at - low)
    above = lambda rows: F.aggregate(rows, F.lit(0.0), lambda acc, x: acc + F.greatest(F.lit(0.0), x["i"] - base))
    b_lo, b_hi = F.greatest(lo, ref * (1 - band_ppm * 1e-6)), F.least(hi, ref * (1 + band_ppm * 1e-6))
    whole = above(inside)
    return F.when((n > 0) & (whole > 0) & ref.isNotNull() & (hi > lo), above(F.filter(inside, lambda x: x["m"].between(b_lo, b_hi))) / whole).otherwise(F.lit(0.0))
