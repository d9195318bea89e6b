"""Search predicates and parsers of short text forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches_name(query: str, name: Column) -> Column:
    """An empty query finds all; else a substring in any case; NULL names are never found."""
    q = query.strip()
    return F.lit(True) if not q else F.coalesce(F.contains(F.lower(name), F.lit(q.lower())), F.lit(False))


def matches_mz(query: str, mz: Column) -> Column:
    """"a-b" finds a range (both ends, in either order), a number the values that begin so with four decimals."""
    q = query.strip()
    if not q:
        return F.lit(True)
    span = re.fullmatch(r"(\d+(?:\.\d*)?)\s*-\s*(\d+(?:\.\d*)?)", q)
    if span:
        lo, hi = sorted(map(float, span.groups()))
        return F.coalesce(mz.between(lo, hi), F.lit(False))
    if not re.fullmatch(r"\d+(\.\d*)?", q):
        return F.lit(False)
    return F.coalesce(F.format_string("%.4f", mz).startswith(q), F.lit(False))


def filled_layer(name: Column) -> Column:
    """STRUCT<source, radius> of a layer name <source>_filled_r<radius>; NULL for others."""
    p = r"^(.+)_filled_r(\d+)$"
    return F.when(name.rlike(p), F.struct(F.regexp_extract(name, p, 1).alias("source"), F.regexp_extract(name, p, 2).cast("int").alias("radius")))


def category_colours(field: Column) -> Column:
    """MAP from "cat=rrggbb,..."; parts without a colour of six hexadecimal digits are left out."""
    parts = F.filter(F.split(field, ","), lambda p: p.rlike(r"^.+=[0-9a-fA-F]{6}$"))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^(.+)=", 1), F.lower(F.regexp_extract(p, "=([^=]+)$", 1)))))


def channels(field: Column) -> Column:
    """ARRAY<STRUCT<mz, colour, vmin, vmax, gamma>> from "mz:rgb:vmin:vmax:gamma,..."; parts that are not so are left out."""
    ok = F.filter(F.split(field, ","), lambda p: F.size(F.split(p, ":")) == 5)
    at = lambda p, k: F.get(F.split(p, ":"), F.lit(k))
    return F.transform(ok, lambda p: F.struct(at(p, 0).try_cast("double").alias("mz"), at(p, 1).alias("colour"), at(p, 2).try_cast("double").alias("vmin"), at(p, 3).try_cast("double").alias("vmax"), at(p, 4).try_cast("double").alias("gamma")))


def snap_threshold(value: Column, lowest: float = -1.0, highest: float = 5.0, step: float = 0.05) -> Column:
    """The nearest step of an even grid, held within its ends."""
    return F.greatest(F.lit(lowest), F.least(F.lit(highest), F.bround(F.bround(value / step) * step, 2)))


def scaled(value: Column, vmin: Column, vmax: Column, gamma: Column) -> Column:
    """((v - vmin) / (vmax - vmin)) cut to 0..1 to the power gamma; 0 where that is not finite."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value - vmin, vmax - vmin)))
    return F.when(~F.isnan(share), F.pow(share, gamma)).otherwise(F.lit(0.0))
