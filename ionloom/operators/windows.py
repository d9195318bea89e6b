"""Ranking with tolerance, consensus picks, islands and greedy clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions import spectral
from ionloom.operators.ranks import percentiles, ranked
from ionloom.session import stored

#: Islands given to one call of a Python kernel.
ISLANDS = 512


def rank_in_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1..n per group without shared ranks; order must end in a unique tiebreak for equal results on every run."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_with_tolerance(df: DataFrame, by: Sequence[str], score: str, richness: str, tiebreak: Sequence[str], keep: Sequence[str], tolerance: float) -> DataFrame:
    """by and the keep columns of each group's representative row: among the rows within tolerance of the group's best score the one with the greatest richness, then score, then the least tiebreak (numbers).

    Of the rows of one richness only the best can be it, so the rows are read and moved once, as one per group and richness.
    Rows of a NULL group take no part.
    """
    per = df.groupBy(*by, F.col(richness).alias("_rich")).agg(F.max(score).alias("_score"), F.max_by(F.struct(*keep), F.struct(F.col(score), *[-F.col(c) for c in tiebreak])).alias("_r"))
    best = per.groupBy(*by).agg(F.max("_score").alias("_best"))
    near = per.join(best, list(by)).where(F.col("_score") >= F.col("_best") - tolerance)
    return near.groupBy(*by).agg(F.max_by("_r", F.struct("_rich", "_score")).alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in keep])


def rank_with_tolerance(df: DataFrame, by: Sequence[str], score: str, richness: str, tiebreak: Sequence[str], tolerance: float, name: str) -> DataFrame:
    """Rank by score, but the first is, among the rows within tolerance of the
    group's best score, the one with the greatest richness, then score. Groups may be of any size."""
    plain = ranked(df, by, [F.desc(score), *[F.asc(c) for c in tiebreak]], "_plain")
    first = first_with_tolerance(plain, by, score, richness, tiebreak, ["_plain"], tolerance).withColumnRenamed("_plain", "_first")
    # Those before the first go down by one, the others keep their place.
    rank = F.when(F.col("_plain") == F.col("_first"), 1).when(F.col("_plain") < F.col("_first"), F.col("_plain") + 1).otherwise(F.col("_plain"))
    return plain.join(first, list(by)).withColumn(name, rank.cast("int")).select(*df.columns, name)


def rank_by_best(df: DataFrame, by: Sequence[str], unit: Sequence[str], score: str, name: str) -> DataFrame:
    """Ranks units (such as scans) of a group by their best score; each row carries its unit's rank."""
    best = df.groupBy(*by, *unit).agg(F.max(score).alias("_best"))
    placed = ranked(best, by, [F.desc("_best"), *[F.asc(c) for c in unit]], name)
    placed = placed.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate((*by, *unit))], name)
    cond = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate((*by, *unit))]
    return df.join(placed, cond).select(*df.columns, name)


def tie_ranks(df: DataFrame, by: Sequence[str], value: str, spread: str, tiebreak: Sequence[str], name: str = "tie_rank") -> DataFrame:
    """Rows in order of value share a rank until one lies more than the group's greatest spread above the first of its tie.

    A group's rows pass through a task in order, one at a time; none is held. NULL values share the first rank of their group.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    widest = df.groupBy(*by).agg(F.max(spread).cast("double").alias("_spread"))
    rows = df.join(widest, list(by)).withColumn("_value", F.col(value).cast("double"))
    columns = df.columns
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", `{name}` int"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, begin, rank = None, None, 0
        for batch in batches:
            out = []
            for *key, v, width in zip(*(batch.column(c).to_pylist() for c in (*by, "_value", "_spread")), strict=True):
                if key != at:
                    at, begin, rank = key, None, 0
                if rank == 0 or (v is not None and (begin is None or v - begin > (width or 0.0))):
                    begin, rank = v, rank + 1
                out.append(rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.int32())], [*columns, name])

    return rows.repartition(*by).sortWithinPartitions(*by, "_value", *tiebreak).mapInArrow(number, schema)


def consensus(scans: DataFrame, by: Sequence[str], n_peaks: str, purity: str, best_score: str, scan: Sequence[str], target_peaks: float = 10.0, neutral: float = 0.5, min_purity: float | None = None, keep_unknown: bool = False) -> DataFrame:
    """Per group the scan that represents it: the greatest product of peak,
    purity and annotation terms, then annotation score, peaks and lowest scan;
    with n_scans and n_considered (those with enough purity; with keep_unknown also those of unknown purity).
    One aggregate that combines before the shuffle, so groups may be of any size."""
    eligible = F.lit(True) if min_purity is None else F.coalesce(F.col(purity) >= min_purity, F.lit(keep_unknown))
    term = spectral.peak_term(F.col(n_peaks), target_peaks) * spectral.purity_term(F.col(purity), neutral) * F.coalesce(F.col(best_score), F.lit(1.0))
    rows = scans.withColumn("consensus_score", term)
    kept = [c for c in rows.columns if c not in by]
    order = F.struct(-F.col("consensus_score"), -F.coalesce(F.col(best_score), F.lit(-1.0)), -F.col(n_peaks), *scan)
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_scans"), F.count_if(eligible).alias("n_considered"), F.min_by(F.when(eligible, F.struct(*kept)), F.when(eligible, order)).alias("_r"))
    return found.where("n_considered > 0").select(*by, *[F.col(f"_r.{c}").alias(c) for c in kept], "n_scans", "n_considered")


def islands(df: DataFrame, value: str, breaks: Callable[[Column, Column], Column], by: Sequence[str] = (), width: float = 1.0, name: str = "island") -> DataFrame:
    """df with an island number: a row starts one where breaks(value, previous value) holds.

    The previous value is the greatest smaller one in the group. Two levels:
    within buckets of ``width`` by a window; across buckets by the last value
    and number of islands of each bucket. NULL and NaN values are left out.
    Only distinct values are numbered, so a bucket holds no more rows than it
    has different positions, however many rows share them.
    """
    every = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = every.select(*by, value).distinct().withColumn("_b", F.floor(F.col(value) / F.lit(width)).cast("bigint"))
    edge = rows.groupBy(*by, "_b").agg(F.max(value).alias("_last"))
    before = edge.withColumn("_prev", F.lag("_last").over(Window.partitionBy(*by).orderBy("_b"))).select(*by, "_b", "_prev")
    local = Window.partitionBy(*by, "_b").orderBy(value)
    rows = rows.join(before, [*by, "_b"]).withColumn("_p", F.coalesce(F.lag(value).over(local), F.col("_prev")))
    rows = rows.withColumn("_new", F.when(F.col("_p").isNull() | breaks(F.col(value), F.col("_p")), 1).otherwise(0))
    counts = rows.groupBy(*by, "_b").agg(F.sum("_new").alias("_n"))
    offset = counts.withColumn("_first", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*by, "_b", "_first")
    inside = F.sum("_new").over(local.rangeBetween(Window.unboundedPreceding, 0))
    numbers = rows.withColumn("_in", inside).join(offset, [*by, "_b"]).select(*by, value, (F.col("_first") + F.col("_in")).cast("bigint").alias(name))
    return every.join(numbers, [*by, value]).select(*df.columns, name)


def align_across(df: DataFrame, mz: str, sample: str, index: str, ppm: float, decimals: int = 4) -> DataFrame:
    """Features aligned across samples: feature_mz, members (sample to index), n_members.

    Peaks in order of m/z join the running cluster while they lie within ppm of
    its mean and their sample is not in it yet. A gap of more than ppm always
    ends a cluster, so islands between such gaps are independent and only their
    (few) peaks meet in one task.
    """
    at = islands(df.select(mz, sample, index), mz, lambda v, p: (v - p) / p * 1e6 > ppm * (1 + 1e-9))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def greedy(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([mz, sample, index], kind="stable")
        out, held, names, sum_, = [], [], set(), 0.0
        for m, s, i in zip(frame[mz].astype(float), frame[sample], frame[index], strict=True):
            mean = sum_ / len(held) if held else m
            if held and (abs(m - mean) / mean * 1e6 > ppm or s in names):
                out.append(held)
                held, names, sum_ = [], set(), 0.0
            held.append((m, s, i))
            names.add(s)
            sum_ += m
        if held:
            out.append(held)
        return pd.DataFrame({"feature_mz": [round(float(np.mean([m for m, _, _ in c])), decimals) for c in out], "members": [{s: i for _, s, i in c} for c in out], "n_members": [len(c) for c in out]})

    # Many islands share a task's call; the gap between them ends a cluster anyway.
    lots = at.withColumn("_lot", F.floor(F.col("island") / ISLANDS))
    return lots.groupBy("_lot").applyInPandas(greedy, f"feature_mz double, members map<{kinds[sample]},{kinds[index]}>, n_members int")


def suppress_near(df: DataFrame, mz: str, intensity: str, ppm: float, by: Sequence[str] = ()) -> DataFrame:
    """Peaks left after the strongest of each neighbourhood (within ppm of it) has suppressed the others; ties go to the lower m/z."""
    at = islands(df.select(*by, mz, intensity), mz, lambda v, p: (v - p) / p * 1e6 > ppm * (1 + 1e-9), by)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*by, mz, intensity))

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["island", intensity, mz], ascending=[True, False, True], kind="stable")
        every, number = frame[mz].to_numpy(dtype=float), frame["island"].to_numpy()
        taken = []
        for begin, end in zip(*(lambda e: (np.r_[0, e], np.r_[e, len(number)]))(np.flatnonzero(np.diff(number)) + 1), strict=True):
            left = every[begin:end]
            alive = np.ones(len(left), dtype=bool)
            for i, m in enumerate(left):
                if alive[i]:
                    taken.append(begin + i)
                    alive &= np.abs(left - m) > m * ppm * 1e-6
        return frame.iloc[taken][[*by, mz, intensity]]

    return at.withColumn("_lot", F.floor(F.col("island") / ISLANDS)).groupBy(*by, "_lot").applyInPandas(keep, schema)


def background(df: DataFrame, mz: str, polarity: str, key: str, ppm: float = 10.0) -> DataFrame:
    """Fragments that recur whatever the precursor: polarity, mz, n_keys, n_total, fraction.

    Clusters are runs without a gap above ppm, cut into pieces of twice that
    width; n_keys counts distinct keys in the cluster, n_total all of the polarity.
    """
    step = float(np.log1p(ppm * 1e-6))
    rows = df.select(polarity, key, F.col(mz).cast("double").alias("_mz")).where("_mz > 0")
    # A row per position and key with its count, however often it occurs.
    peaks = rows.groupBy(polarity, key, "_mz").agg(F.count(F.lit(1)).alias("_c")).withColumn("_ln", F.log("_mz"))
    runs = islands(peaks, "_ln", lambda v, p: v - p > step, [polarity], width=0.001)
    first = runs.groupBy(polarity, "island").agg(F.min("_ln").alias("_first"))
    pieces = runs.join(first, [polarity, "island"]).withColumn("_piece", F.floor((F.col("_ln") - F.col("_first")) / step / 2).cast("bigint"))
    found = pieces.groupBy(polarity, "island", "_piece").agg((F.sum(F.col("_mz") * F.col("_c")) / F.sum("_c")).alias("mz"), F.count_distinct(key).alias("n_keys"))
    # A row per group (polarity): left to the planner, which sends it to all tasks if it is small.
    whole = rows.groupBy(polarity).agg(F.count_distinct(key).alias("n_total"))
    return found.join(whole, polarity).select(polarity, "mz", "n_keys", "n_total", (F.col("n_keys") / F.col("n_total")).alias("fraction"))


def bin_decimals(width: float) -> int:
    """Decimals by which bins of this width can be told apart."""
    return max(0, -int(np.floor(np.log10(width)))) if width > 0 else 0


def centroids(spectra: DataFrame, by: Sequence[str], bin_: str, position: str, intensity: str, width: float, baseline_factor: float = 100.0, prominence_factor: float = 0.1, percentile: float = 0.1, window: int = 501, sigma: float = 10.0, merge_ppm: float = 5.0, block: int = 20_000) -> DataFrame:
    """by, mz, intensity: the peaks of averaged spectra, one per group, given as filled bins on an even axis of this width.

    The axis is cut into blocks of bins with a halo on both sides as wide as the
    baseline's window and smoothing reach, so that a block is worked on by
    itself: a centred rolling percentile over the filled bins (the whole
    spectrum's percentile where they are few), Gaussian smoothing of it, local
    maxima above the baseline with enough prominence, a parabola's vertex. Bins
    without a row are empty. A block holds at most block + 2 halo bins.
    """
    halo = window // 2 + int(4 * sigma) + 2
    decimals = bin_decimals(width)
    kinds = {f.name: f.dataType.simpleString() for f in spectra.schema.fields}
    filled = spectra.where(F.col(intensity) > 0)
    whole = stored(percentiles(filled, by, intensity, [percentile]).select(*by, "n", F.get("q", F.lit(0)).alias("_whole")))
    whole_rows = whole.agg(F.sum("n")).first()[0]
    whole = whole.drop("n")
    rows = filled.select(*by, F.col(bin_).cast("bigint").alias("_k"), F.col(position).cast("double").alias("_x"), F.col(intensity).cast("double").alias("_y")).join(whole, list(by))
    near = F.sequence(F.floor((F.col("_k") - halo) / block), F.floor((F.col("_k") + halo) / block))
    spread = rows.withColumn("_b", F.explode(near))
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()

    fewest = max(5, window // 10)

    def peaks_of(b: int, k: np.ndarray, x: np.ndarray, filled_y: np.ndarray, whole_p: float) -> list[tuple[float, float]]:
        lo, hi, begin = b * block, (b + 1) * block, k[0] - 1
        y = np.zeros(k[-1] - begin + 2)
        y[k - begin] = filled_y
        # Position of bin 0 from any filled bin.
        origin = x[0] - width * k[0]
        base = np.full(len(y), whole_p)
        if len(k) >= fewest:
            some = pd.Series(np.where(y > 0, y, np.nan))
            base = some.rolling(window, center=True, min_periods=fewest).quantile(percentile).fillna(whole_p).to_numpy()
            base = np.convolve(np.pad(base, reach, mode="symmetric"), kernel, mode="valid")
        out = []
        rising = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:]) & (y[1:-1] >= base[1:-1] * (1 + baseline_factor))) + 1
        for i in rising:
            if not lo <= i + begin < hi:
                continue
            j = i
            while y[j + 1] == y[i]:
                j += 1
            if y[j + 1] > y[i]:
                continue
            sides = []
            for step in (-1, 1):
                # An empty bin is as low as it gets.
                at, lowest = i, y[i]
                while 0 < at < len(y) - 1 and y[at] <= y[i] and lowest > 0:
                    at += step
                    lowest = min(lowest, y[at])
                sides.append(lowest)
            if y[i] - max(sides) < base[i] * prominence_factor:
                continue
            bend = y[i - 1] - 2 * y[i] + y[i + 1]
            delta = 0.5 * (y[i - 1] - y[i + 1]) / bend if abs(bend) > 1e-12 else 0.0
            out.append((round(origin + width * (i + begin + delta), decimals), y[i] - 0.25 * (y[i - 1] - y[i + 1]) * delta))
        return out

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([*by, "_b", "_k"], kind="stable")
        number = frame.groupby([*by, "_b"], sort=False, dropna=False).ngroup().to_numpy()
        edges = np.r_[0, np.flatnonzero(np.diff(number)) + 1, len(number)]
        k, x, y, b, p = (frame[c].to_numpy() for c in ("_k", "_x", "_y", "_b", "_whole"))
        heads = {c: frame[c].to_numpy() for c in by}
        out = [(*(heads[c][begin] for c in by), *peak) for begin, end in zip(edges[:-1], edges[1:], strict=True) for peak in peaks_of(int(b[begin]), k[begin:end], x[begin:end], y[begin:end], float(p[begin]))]
        return pd.DataFrame(out, columns=[*by, "mz", "intensity"])

    # Blocks with few filled bins share a call: lots of some 200,000 bins.
    lots = (whole_rows or 0) // 200_000 + 16
    schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + "mz double, intensity double"
    found = spread.withColumn("_lot", F.pmod(F.xxhash64(*by, "_b"), F.lit(lots))).groupBy("_lot").applyInPandas(pick, schema)
    return suppress_near(found, "mz", "intensity", merge_ppm, by)


def precursor_keys(nearest: DataFrame, feature: str, mz: str, ppm: float) -> DataFrame:
    """key: the feature, or a negative number of the m/z bin for precursors without one."""
    return nearest.withColumn("key", F.coalesce(F.col(feature).cast("bigint"), -1 - spectral.log_bin(F.col(mz), ppm)))
