"""References that lead nowhere.

The distinct non-null foreign keys, not the rows, are anti-joined against the
distinct parent keys; the rows come back only for keys found missing. Key
counts are combined before the shuffle. Because one missing key may be named
by a large part of the rows, the way back is salted: rows spread over
``salts`` parts by their own hash and each missing key is repeated for each part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_keys(child: DataFrame, child_keys: Sequence[str], parent: DataFrame, parent_keys: Sequence[str]) -> DataFrame:
    """Distinct child keys without a parent row, with n_refs, the number of child
    rows that name them. A key with any NULL part refers to nothing and is left out."""
    keys = child.select(*child_keys).where(" and ".join(f"`{c}` is not null" for c in child_keys)).groupBy(*child_keys).agg(F.count(F.lit(1)).alias("n_refs"))
    have = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_keys, child_keys, strict=True)]).distinct()
    return keys.join(have, list(child_keys), "left_anti")


def orphan_rows(child: DataFrame, child_keys: Sequence[str], parent: DataFrame, parent_keys: Sequence[str], salts: int = 16) -> DataFrame:
    """All columns of the child rows whose key has no parent row."""
    missing = missing_keys(child, child_keys, parent, parent_keys).select(*child_keys, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = child.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, kind in child.dtypes if "map<" not in kind and kind != "variant"]), F.lit(salts)).cast("int"))
    return salted.join(missing, [*child_keys, "_salt"], "left_semi").drop("_salt")


def by_period(orphans: DataFrame, names: Sequence[str], period: Column, key: str) -> DataFrame:
    """n_rows and n_keys (distinct keys) per name columns and period."""
    return orphans.groupBy(*names, period.alias("period")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"))
