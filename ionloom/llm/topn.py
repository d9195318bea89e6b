"""Top N items of every group, with bounds found per partition.

A partition's own N-th best item is a lower bound for its group: nothing below
it can be among the group's N best. One pass over the input keeps each
partition's N best distinct items per group and its bound; the largest bound of
each group is joined to these items, what lies below is dropped, and only the
survivors are ranked. No group is ever gathered: a task holds at most N items
for each group it has seen, and what reaches a group's task is at most N items
per input partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionloom.session import cut

#: Rows gathered before the local candidates are pruned; then again whenever what is held has doubled.
PRUNE_ROWS = 100_000


def _prune(parts: list[pd.DataFrame], n: int) -> pd.DataFrame:
    rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    rows = rows.sort_values(["g", "s", "i"], ascending=[True, False, True], kind="stable").drop_duplicates(["g", "i"])
    return rows[rows.groupby("g", sort=False).cumcount() < n]


def top_n(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """group, item, score, rank (1..n) of the n items with the highest best score.

    An item that occurs more than once in a group counts with its best score;
    equal scores go by item ascending, so the result is the same on every run.
    Rows with NULL group, item or score, or a NaN score, do not count. A group
    with fewer than n items gives all it has; an empty input gives no rows.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField("g", kinds[group]), T.StructField("i", kinds[item]), T.StructField("s", T.DoubleType()), T.StructField("bound", T.DoubleType())])
    clean = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s")).where("g is not null and i is not null and s is not null and not isnan(s)")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        rows, limit = 0, PRUNE_ROWS
        for batch in batches:
            part = batch.to_pandas()
            held.append(part)
            rows += len(part)
            if rows >= limit:
                held = [_prune(held, n)]
                rows = len(held[0])
                limit = max(PRUNE_ROWS, 2 * rows)
        if held:
            best = _prune(held, n)
            size = best.groupby("g")["i"].transform("size")
            # The last of n distinct items is the bound; fewer than n give none.
            best = best.assign(bound=best.groupby("g")["s"].transform("min").where(size == n))
            yield from pa.Table.from_pandas(best[["g", "i", "s", "bound"]], preserve_index=False).to_batches(max_chunksize=10_000)

    # Used twice; written once. At most n rows a group and partition: small where groups are large, up to all rows where they are not.
    candidates = cut(clean.mapInArrow(local, schema))
    bounds = candidates.groupBy("g").agg(F.max("bound").alias("least"))
    survivors = candidates.join(bounds, "g").where("least is null or s >= least")
    best = survivors.groupBy("g", "i").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), F.asc("i")))
    return best.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
