"""Mixing sources to target weights without sorting.

Every document has a fixed 60-bit hash of its id. How much of a source lies
below a hash is known from token sums per (source, hash bucket): one histogram
over 4096 buckets gives the bucket in which the budget is used up, a second
one over that bucket only gives the bucket within it, and so on. The final
threshold per source then selects documents by a plain filter. A source that
has to be repeated occurs in full as often as the budget allows and once more
below its threshold. Thresholds are nested: a larger budget keeps all documents
that a smaller one had.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.session import cut

HASH_BITS, STEP_BITS = 60, 12
DEFAULT_TOKENIZER = "byte_bpe_50k.tiktoken"


def source_name(col: Column) -> Column:
    """Source spelt cleanly: lower case, outer blanks off, inner blanks and hyphens as underscores; NULL where blank."""
    clean = F.regexp_replace(F.lower(F.regexp_replace(col, r"^[\s_-]+|[\s_-]+$", "")), r"[\s_-]+", "_")
    return F.when(clean != "", clean)


def token_counter(path: str | None = None):
    """A function from texts to token counts; path is a rank file of the public tokenizers."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(DEFAULT_TOKENIZER), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(encoding.encode_ordinary(x)) if x else 0 for x in texts]


def sized(df: DataFrame, doc_id: str, text: str, source: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source (clean), n_tokens, _h (hash of the id). NULL and empty texts have 0 tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer)
        for batch in batches:
            sizes = pa.array(counter(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), sizes], ["id", "source", "n_tokens"])

    kind = df.schema[doc_id].dataType.simpleString()
    rows = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), source_name(F.col(source)).alias("source"), F.col(text).alias("text"))
    counted = rows.mapInArrow(count, f"id {kind}, source string, n_tokens bigint")
    return counted.select("id", "source", "n_tokens", F.shiftrightunsigned(F.xxhash64("id"), 64 - HASH_BITS).alias("_h"))


def _below(docs: DataFrame, limits: dict[str, int]) -> tuple[dict[str, int], dict[str, int]]:
    """Hash threshold per source under which at most its limit of tokens lies, and the tokens below it."""
    spark = docs.sparkSession
    at = {s: (0, 0) for s in limits}  # source: bucket prefix, tokens below it
    closed: dict[str, tuple[int, int]] = {}
    for level in range(1, HASH_BITS // STEP_BITS + 1):
        open_ = {s: v for s, v in at.items() if s not in closed}
        if not open_:
            break
        shift = HASH_BITS - STEP_BITS * level
        inside = spark.createDataFrame([(s, p) for s, (p, _) in open_.items()], "source string, _p bigint")
        bucket = docs.withColumn("_p", F.shiftrightunsigned("_h", shift + STEP_BITS)) if shift + STEP_BITS < HASH_BITS else docs.withColumn("_p", F.lit(0).cast("bigint"))
        # One sum per (source, bucket): at most sources x 4096 rows whatever the data's size.
        sums = (
            bucket.join(F.broadcast(inside), ["source", "_p"])
            .groupBy("source", F.shiftrightunsigned("_h", shift).alias("b"))
            .agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
            .collect()
        )
        by_source: dict[str, list] = {}
        for r in sorted(sums, key=lambda r: (r["source"], r["b"])):
            by_source.setdefault(r["source"], []).append(r)
        for s, (prefix, used) in open_.items():
            for r in by_source.get(s, []):
                if used + r["n"] > limits[s]:
                    # The boundary bucket: to be refined, unless it is one document.
                    at[s] = (r["b"], used)
                    if r["docs"] == 1 or shift == 0:
                        closed[s] = (r["b"] << shift, used)
                    break
                used += r["n"]
            else:
                closed[s] = ((prefix + 1) << (shift + STEP_BITS), used)
    closed |= {s: (p, used) for s, (p, used) in at.items() if s not in closed}
    return {s: t for s, (t, _) in closed.items()}, {s: u for s, (_, u) in closed.items()}


class Mix:
    """A mix of df's documents. targets: source, target_share, max_repeats, one row a source (few rows).

    total is the mix's size in tokens; by default all tokens of the targeted
    sources. A source whose target lies above max_repeats times what it has is
    taken max_repeats times and falls short; its missing tokens are not given
    to others, so that the reached shares show it. Sources without a target,
    and documents without a source, are left out.
    """

    def __init__(self, df: DataFrame, targets: DataFrame, doc_id: str, text: str, source: str, total: int | None = None, tokenizer: str | None = None):
        self.doc_id = doc_id
        # The tokenizer runs once; every histogram reads these narrow rows.
        self.docs = cut(sized(df, doc_id, text, source, tokenizer))
        wanted = {r["source"]: r for r in targets.where("source is not null").collect()}
        have = {r["source"]: (r["n"], r["docs"]) for r in self.docs.where(F.col("source").isin(list(wanted))).groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect()}
        self.total = total if total is not None else sum(n for n, _ in have.values())
        self.plan: dict[str, dict] = {}
        limits = {}
        for s, r in wanted.items():
            n, docs = have.get(s, (0, 0))
            budget = int(self.total * (r["target_share"] or 0.0))
            full = min(budget // n, r["max_repeats"] or 0) if n else 0
            rest = budget - full * n if n and full < (r["max_repeats"] or 0) else 0
            self.plan[s] = {"target_share": r["target_share"], "max_repeats": r["max_repeats"], "available_tokens": n, "n_documents": docs, "budget_tokens": budget, "full": full, "threshold": 0, "reached_tokens": full * n}
            if rest > 0:
                limits[s] = rest
        thresholds, used = _below(self.docs, limits)
        for s in limits:
            self.plan[s]["threshold"] = thresholds[s]
            self.plan[s]["reached_tokens"] += used[s]

    def documents(self) -> DataFrame:
        """doc_id, source, n_tokens, copies (1 to max_repeats) of every document in the mix."""
        rows = [(s, p["full"], p["threshold"]) for s, p in self.plan.items()]
        plan = self.docs.sparkSession.createDataFrame(rows, "source string, _full bigint, _threshold bigint")
        copies = (F.col("_full") + F.when(F.col("_h") < F.col("_threshold"), 1).otherwise(0)).cast("int")
        picked = self.docs.join(F.broadcast(plan), "source").withColumn("copies", copies).where("copies > 0")
        return picked.select(F.col("id").alias(self.doc_id), "source", "n_tokens", "copies")

    def shares(self) -> DataFrame:
        """Per targeted source what was wanted, what there is and what the mix reaches."""
        whole = sum(p["reached_tokens"] for p in self.plan.values())
        rows = [
            (s, p["target_share"], p["max_repeats"], p["n_documents"], p["available_tokens"], p["budget_tokens"], p["reached_tokens"], p["reached_tokens"] / whole if whole else 0.0, p["reached_tokens"] / self.total if self.total else 0.0, p["reached_tokens"] / p["available_tokens"] if p["available_tokens"] else 0.0, p["available_tokens"] * (p["max_repeats"] or 0) < p["budget_tokens"])
            for s, p in sorted(self.plan.items())
        ]
        return self.docs.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int, n_documents bigint, available_tokens bigint, budget_tokens bigint, reached_tokens bigint, reached_share double, share_of_planned_total double, mean_copies double, short boolean")
