"""Pixel grids: indices, neighbours, filling, spatial autocorrelation, regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.session import cut


def grid_indices(pixels: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """pixels with gx, gy: ranks of the distinct x and y in use, from 0. The axes, not the pixels, are numbered."""
    out = pixels
    for c, name in ((x, "gx"), (y, "gy")):
        axis = pixels.select(*by, c).where(F.col(c).isNotNull()).distinct()
        out = out.join(axis.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(c)) - 1).cast("int")), [*by, c])
    return out


def neighbours(pixels: DataFrame, by: Sequence[str], pixel: str, radius: int = 1, rook: bool = False) -> DataFrame:
    """by, src, dst: ordered pairs of existing pixels no more than radius apart on the grid (rook: sharing a side only)."""
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if (i, j) != (0, 0) and (not rook or abs(i) + abs(j) == 1)]
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])
    moved = pixels.select(*by, F.col(pixel).alias("src"), "gx", "gy", F.explode(offsets).alias("o")).select(*by, "src", (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"))
    return moved.join(pixels.select(*by, F.col(pixel).alias("dst"), "gx", "gy"), [*by, "gx", "gy"]).select(*by, "src", "dst")


def fill_blanks(values: DataFrame, edges: DataFrame, by: Sequence[str], pixel: str, feature: Sequence[str], value: str, min_fraction: float = 0.6) -> DataFrame:
    """Sparse values (non-zero only) with filled ones added (filled = true).

    A pixel without a value gets the mean of its neighbours' where at least
    max(1, ceil(min_fraction * neighbours)) of them have one.
    """
    degree = edges.groupBy(*by, F.col("src").alias(pixel)).agg(F.count(F.lit(1)).alias("_n"))
    stored = values.where(F.col(value).isNotNull() & (F.col(value) != 0))
    around = edges.join(stored.withColumnRenamed(pixel, "dst"), [*by, "dst"]).groupBy(*by, F.col("src").alias(pixel), *feature).agg(F.count(F.lit(1)).alias("_k"), F.avg(value).alias(value))
    need = F.greatest(F.lit(1), F.ceil(F.col("_n") * min_fraction - 1e-9))
    blank = around.join(degree, [*by, pixel]).where(F.col("_k") >= need).join(stored, [*by, pixel, *feature], "left_anti")
    keep = [*by, pixel, *feature, value]
    return stored.select(*keep, F.lit(False).alias("filled")).unionByName(blank.select(*keep, F.lit(True).alias("filled")))


def _centred(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """values with z (from the mean) and m2 (population variance) of their group; groups are combined before they move."""
    stats = values.groupBy(*by).agg(F.avg(value).alias("_mean"), F.var_pop(value).alias("_m2"))
    return values.join(stats, list(by)).withColumn("z", F.col(value) - F.col("_mean")).withColumn("m2", F.col("_m2")).drop("_mean", "_m2")


def local_moran(values: DataFrame, edges: DataFrame, by: Sequence[str], pixel: str, value: str, feature: Sequence[str] = (), high_only: bool = False) -> DataFrame:
    """by, feature, pixel, local_i: z_i / m2 times the mean z of the neighbours.

    values hold every pixel (zeros too). NULL without neighbours or where the
    image is constant; high_only sets to 0 where z or its lag is not positive.
    """
    z = _centred(values, [*by, *feature], value)
    lag = edges.join(z.select(*by, *feature, F.col(pixel).alias("dst"), F.col("z").alias("_z")), [*by, "dst"]).groupBy(*by, *feature, F.col("src").alias(pixel)).agg(F.avg("_z").alias("lag"))
    i = F.when(F.col("m2") > 0, F.col("z") / F.col("m2") * F.col("lag"))
    if high_only:
        i = F.when(i.isNotNull() & ((F.col("z") <= 0) | (F.col("lag") <= 0)), F.lit(0.0)).otherwise(i)
    return z.join(lag, [*by, *feature, pixel], "left").select(*by, *feature, pixel, i.alias("local_i"))


def global_moran(values: DataFrame, edges: DataFrame, by: Sequence[str], pixel: str, value: str, feature: Sequence[str] = ()) -> DataFrame:
    """by, feature, moran_i, n_pixels: n / S0 * sum over edges of z_i z_j / sum of z squared; NULL where constant or without edges."""
    z = _centred(values, [*by, *feature], value)
    whole = z.groupBy(*by, *feature).agg(F.sum(F.col("z") * F.col("z")).alias("_zz"), F.count(F.lit(1)).alias("n_pixels"))
    one = z.select(*by, *feature, F.col(pixel).alias("src"), F.col("z").alias("_zi"))
    two = z.select(*by, *feature, F.col(pixel).alias("dst"), F.col("z").alias("_zj"))
    pairs = edges.join(one, [*by, "src"]).join(two, [*by, *feature, "dst"]).groupBy(*by, *feature).agg(F.sum(F.col("_zi") * F.col("_zj")).alias("_zij"), F.count(F.lit(1)).alias("_s0"))
    i = F.when((F.col("_zz") > 0) & (F.col("_s0") > 0), F.col("n_pixels") / F.col("_s0") * F.col("_zij") / F.col("_zz"))
    return whole.join(pairs, [*by, *feature], "left").select(*by, *feature, i.alias("moran_i"), "n_pixels")


def image_moran(matrix: DataFrame, pixels: DataFrame, edges: DataFrame, by: Sequence[str], pixel: str, feature: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Local I of every pixel of every feature's image, zeros included, without a row per zero: (touched, images).

    matrix holds the non-zero values, pixels every pixel. touched: by, feature,
    pixel, z, deg, lag_sum, local_i for pixels with a value or a neighbour that has
    one. images: by, feature, n, m2, rest_z, rest_i and the number n_rest of other
    pixels with neighbours and the sum rest_deg of their neighbours; all these
    have the same z and local_i. NULL as in local_moran.
    """
    key = [*by, feature]
    deg = pixels.select(*by, pixel).join(edges.groupBy(*by, F.col("src").alias(pixel)).agg(F.count(F.lit(1)).alias("deg")), [*by, pixel], "left").withColumn("deg", F.coalesce("deg", F.lit(0).cast("bigint")))
    whole = deg.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("deg") > 0).alias("_linked"), F.sum("deg").alias("_s0"))
    stored = matrix.where(F.col(value).isNotNull() & (F.col(value) != 0)).select(*key, pixel, F.col(value).cast("double").alias("_v")).join(pixels.select(*by, pixel), [*by, pixel], "left_semi")
    mean = stored.groupBy(*key).agg(F.count(F.lit(1)).alias("_k"), F.sum("_v").alias("_sum"), (F.min("_v") == F.max("_v")).alias("_same")).join(whole, list(by)).withColumn("_mean", F.col("_sum") / F.col("n"))
    spread = stored.join(mean.select(*key, "_mean"), key).groupBy(*key).agg(F.sum((F.col("_v") - F.col("_mean")) * (F.col("_v") - F.col("_mean"))).alias("_sq"))
    m2 = F.when(F.col("_same") & (F.col("_k") == F.col("n")), F.lit(0.0)).otherwise((F.col("_sq") + (F.col("n") - F.col("_k")) * F.col("_mean") * F.col("_mean")) / F.col("n"))
    stats = cut(mean.join(spread, key).select(*key, "n", "_linked", "_s0", "_mean", m2.alias("m2")))
    zero = F.lit(0.0)
    around = edges.join(stored.withColumnRenamed(pixel, "dst"), [*by, "dst"]).select(*key, F.col("src").alias(pixel), zero.alias("_v"), F.col("_v").alias("_l"))
    met = stored.select(*key, pixel, "_v", zero.alias("_l")).unionByName(around).groupBy(*key, pixel).agg(F.sum("_v").alias("_v"), F.sum("_l").alias("_l"))
    z = F.col("_v") - F.col("_mean")
    touched = met.join(deg, [*by, pixel]).join(stats, key).select(*key, pixel, z.alias("z"), "deg", (F.col("_l") - F.col("deg") * F.col("_mean")).alias("lag_sum"), F.when((F.col("m2") > 0) & (F.col("deg") > 0), z / F.col("m2") * (F.col("_l") / F.col("deg") - F.col("_mean"))).alias("local_i"))
    touched = cut(touched)
    own = touched.groupBy(*key).agg(F.count_if(F.col("deg") > 0).alias("_t"), F.sum("deg").alias("_d"))
    images = stats.join(own, key).select(*key, "n", "m2", (-F.col("_mean")).alias("rest_z"), F.when(F.col("m2") > 0, F.col("_mean") * F.col("_mean") / F.col("m2")).alias("rest_i"), (F.col("_linked") - F.col("_t")).alias("n_rest"), (F.col("_s0") - F.col("_d")).alias("rest_deg"))
    return touched, images


def image_local(touched: DataFrame, images: DataFrame, pixels: DataFrame, edges: DataFrame, by: Sequence[str], pixel: str, feature: str) -> DataFrame:
    """by, feature, pixel, local_i with a row for every pixel of every image; the pixels of a group travel as one list, not once per image."""
    key = [*by, feature]
    linked = edges.select(*by, F.col("src").alias(pixel)).distinct().withColumn("_has", F.lit(True))
    every = pixels.select(*by, pixel).join(linked, [*by, pixel], "left").groupBy(*by).agg(F.collect_list(F.when(F.col("_has"), F.col(pixel))).alias("_with"), F.collect_list(F.when(F.col("_has").isNull(), F.col(pixel))).alias("_alone"))
    met = touched.groupBy(*key).agg(F.collect_list(pixel).alias("_met"))
    rest = images.select(*key, "rest_i").join(met, key).join(every, list(by))
    left = lambda c, i: F.transform(F.array_except(c, "_met"), lambda p: F.struct(p.alias("p"), i.cast("double").alias("i")))
    others = rest.select(*key, F.explode(F.concat(left("_with", F.col("rest_i")), left("_alone", F.lit(None)))).alias("_o"))
    return touched.select(*key, pixel, "local_i").unionByName(others.select(*key, F.col("_o.p").alias(pixel), F.col("_o.i").alias("local_i")))


def image_global(touched: DataFrame, images: DataFrame, by: Sequence[str], feature: str) -> DataFrame:
    """by, feature, moran_i, n_pixels as global_moran has them."""
    key = [*by, feature]
    s = touched.groupBy(*key).agg(F.sum(F.col("z") * F.col("lag_sum")).alias("_zij"), F.sum("deg").alias("_d"))
    s0 = F.col("_d") + F.col("rest_deg")
    i = F.when((F.col("m2") > 0) & (s0 > 0), (F.col("_zij") + F.col("rest_z") * F.col("rest_z") * F.col("rest_deg")) / s0 / F.col("m2"))
    return images.join(s, key).select(*key, i.alias("moran_i"), F.col("n").alias("n_pixels"))


def above_thresholds(values: DataFrame, by: Sequence[str], value: str, lowest: float = -1.0, step: float = 0.05, count: int = 121, weight: str | None = None) -> DataFrame:
    """by, threshold_index, n_above, n_finite: how many values exceed each of the
    evenly spaced thresholds; one histogram and a sum from above, not a row per value and threshold.
    weight: column with how many values a row stands for."""
    rows = values.where(F.col(value).isNotNull() & ~F.isnan(value))
    # The number of thresholds below the value: those it exceeds.
    over = F.greatest(F.lit(0), F.least(F.lit(count), F.ceil((F.col(value) - lowest) / step - 1e-9))).cast("int")
    hist = rows.groupBy(*by, over.alias("_k")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    totals = hist.groupBy(*by).agg(F.sum("_n").alias("n_finite"), F.array_sort(F.collect_list(F.struct("_k", "_n"))).alias("_h"))
    grid = totals.select(*by, "n_finite", "_h", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("threshold_index"))
    above = F.aggregate(F.filter("_h", lambda x: x["_k"] > F.col("threshold_index")), F.lit(0).cast("bigint"), lambda acc, x: acc + x["_n"])
    return grid.select(*by, "threshold_index", above.alias("n_above"), "n_finite")


def in_polygon(px: Column, py: Column, vertices: Sequence[tuple[float, float]]) -> Column:
    """Whether a point lies in the polygon (even-odd rule); false for fewer than three vertices."""
    inside = F.lit(False)
    if len(vertices) < 3:
        return inside
    for (x1, y1), (x2, y2) in zip(vertices, [*vertices[1:], vertices[0]], strict=True):
        if y1 == y2:
            continue
        crosses = ((F.lit(float(y1)) > py) != (F.lit(float(y2)) > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
        inside = inside != crosses
    return inside


def affine(matrix: Sequence[float], x: Column, y: Column) -> tuple[Column, Column]:
    """The point under a 2x3 matrix a, b, c, d, e, f: (a x + b y + c, d x + e y + f)."""
    a, b, c, d, e, f = map(float, matrix)
    return a * x + b * y + c, d * x + e * y + f


def invert_affine(matrix: Sequence[float]) -> tuple[float, ...]:
    a, b, c, d, e, f = map(float, matrix)
    det = a * e - b * d
    if abs(det) < 1e-15:
        raise ValueError("the transform has no inverse")
    return (e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det)


def fit_affine(points: DataFrame, x: str, y: str, u: str, v: str) -> tuple[float, ...]:
    """Least-squares 2x3 matrix from (x, y) to (u, v); the normal equations' sums are one aggregate row."""
    import numpy as np

    c = F.col
    s = points.agg(*[F.sum(e).alias(n) for n, e in {"n": F.lit(1.0), "x": c(x), "y": c(y), "xx": c(x) * c(x), "xy": c(x) * c(y), "yy": c(y) * c(y), "u": c(u), "v": c(v), "xu": c(x) * c(u), "yu": c(y) * c(u), "xv": c(x) * c(v), "yv": c(y) * c(v)}.items()]).first()
    if not s["n"] or s["n"] < 3:
        raise ValueError("three points or more are needed")
    m = np.array([[s["xx"], s["xy"], s["x"]], [s["xy"], s["yy"], s["y"]], [s["x"], s["y"], s["n"]]])
    if np.linalg.matrix_rank(m) < 3:
        raise ValueError("the points lie on one line")
    return tuple(map(float, (*np.linalg.solve(m, [s["xu"], s["yu"], s["u"]]), *np.linalg.solve(m, [s["xv"], s["yv"], s["v"]]))))


def fit_similarity(points: DataFrame, x: str, y: str, u: str, v: str) -> tuple[float, ...]:
    """Least-squares rotation, uniform scale and shift (no reflection) as a 2x3 matrix."""
    c = F.col
    s = points.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(u).alias("u"), F.avg(v).alias("v"), F.avg(c(x) * c(x) + c(y) * c(y)).alias("rr"), F.avg(c(x) * c(u) + c(y) * c(v)).alias("dot"), F.avg(c(x) * c(v) - c(y) * c(u)).alias("cross")).first()
    spread = (s["rr"] or 0.0) - (s["x"] or 0.0) ** 2 - (s["y"] or 0.0) ** 2
    if s["n"] < 2 or spread <= 0:
        raise ValueError("two different points or more are needed")
    a = (s["dot"] - s["x"] * s["u"] - s["y"] * s["v"]) / spread
    b = (s["cross"] - s["x"] * s["v"] + s["y"] * s["u"]) / spread
    return (a, -b, s["u"] - a * s["x"] + b * s["y"], b, a, s["v"] - b * s["x"] - a * s["y"])
