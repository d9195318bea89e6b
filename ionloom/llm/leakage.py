"""Evaluation texts that leak into a corpus.

A set join of items and documents on shingles of three words, in five steps:

1. The items' shingles go into a filter of bounded size, the only thing sent to
   all tasks. One pass over the corpus keeps the places of shingles that may be
   an item's, where enough of them lie within an item's reach.
2. Shingles are ordered by rarity, counted over what the pass kept.
3. A passage of n words of which c are changed keeps at least n - 2 - 3 c of its
   n - 2 shingles, so every window of an item need only be looked up by its
   3 c + 1 rarest (its prefix). The smallest window for each c will do, since a
   longer passage with c changes holds such a window with no more of them.
4. Prefix shingles and kept places are joined by shuffle, frequent shingles
   split over salts: candidates, each an item and a document.
5. The candidates' documents are read again and every candidate is verified
   exactly: from each run of equal words the furthest reach in both directions
   for every number of changes (positional bounds first).

No step holds all items or all documents anywhere, and a document that holds
very many items is verified in parts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.llm import shingles
from ionloom.llm.text import tokens, words_of_tokens
from ionloom.session import cut

SHINGLE = shingles.WORDS
#: Bits of the filter at most (32 MB).
MOST_BITS = 28
#: Places of a shingle from which its rows are split over salts.
FREQUENT, SALTS = 20_000, 64
#: Items of a document verified by one call.
ITEMS_A_CALL = 200
#: Candidate documents up to which their numbers are sent to all tasks.
BROADCAST_ROWS = 100_000


def window_sizes(longest: int, min_words: int, share: float) -> list[tuple[int, int]]:
    """(words, changes) of the smallest passage for every number of changes that one of up to ``longest`` words may have."""
    out: list[tuple[int, int]] = []
    for n in range(min_words, longest + 1):
        c = round(n * share)
        if not out or c > out[-1][1]:
            out.append((n, c))
    return out


def least_kept(min_words: int, share: float) -> int:
    """Shingles that any sufficient passage keeps."""
    kept = min(n - SHINGLE + 1 - SHINGLE * c for n, c in window_sizes(10 * min_words, min_words, share))
    if kept < 1 or share >= 1 / SHINGLE:
        raise ValueError("with so many words changed a passage may hold no whole shingle")
    return kept


def wanted(hashes: np.ndarray, counts: np.ndarray, min_words: int, share: float) -> np.ndarray:
    """Which shingles of an item (in order) it has to be looked up by."""
    n = len(hashes)
    rank = np.empty(n, dtype=np.int64)
    rank[np.lexsort((hashes, counts))] = np.arange(n)
    out = np.zeros(n, dtype=bool)
    for words, changes in window_sizes(n + SHINGLE - 1, min_words, share):
        size, prefix = words - SHINGLE + 1, SHINGLE * changes + 1
        windows = np.lib.stride_tricks.sliding_window_view(rank, size)
        limit = np.partition(windows, prefix - 1, axis=1)[:, prefix - 1]
        at, inside = np.nonzero(windows <= limit[:, None])
        out[at + inside] = True
    return out


def _reach(a: list[str], b: list[str], most: int) -> list[int]:
    """For each number of changes up to most, how many words of a from the first on can be covered, the last of them a match."""
    out = [0] * (most + 1)
    n, m = len(a), len(b)
    # The furthest word of a per diagonal (b's place less a's).
    far = {0: 0}
    for c in range(most + 1):
        if c:
            before, far = far, {}
            for d in range(-c, c + 1):
                i = min(max(before.get(d, -2) + 1, before.get(d - 1, -2), before.get(d + 1, -2) + 1), n, m - d)
                if i >= max(0, -d):
                    far[d] = i
        for d, i in far.items():
            start = i
            while i < n and 0 <= i + d < m and a[i] == b[i + d]:
                i += 1
            far[d] = i
            if i > start and i > out[c]:
                out[c] = i
    return out


def longest_passage(item: list[str], word_of: list[int], doc: list[str], places: dict[str, list[int]], min_words: int, share: float) -> tuple[int, int] | None:
    """(words, changed) of the longest sufficient passage of item that doc holds, None if there is none.

    places: where in doc each shingle begins. Every sufficient passage holds a
    run of equal words as long as a shingle; from each such run both ends are
    moved as far as each number of changes allows.
    """
    least = least_kept(min_words, share)
    most = round((word_of[-1] + 1) * share)
    hits = sorted((d - k, k) for k in range(len(item) - SHINGLE + 1) for d in places.get(" ".join(item[k : k + SHINGLE]), ()))
    if len(hits) < least:
        return None
    size = len(item) + most
    best = None
    lo = hi = 0
    at = 0
    while at < len(hits):
        diagonal, k = hits[at]
        end = at
        while end + 1 < len(hits) and hits[end + 1] == (diagonal, hits[end][1] + 1):
            end += 1
        last = hits[end][1] + SHINGLE
        at = end + 1
        # Positional bound: enough shingles of the item near this diagonal and within its reach.
        while hits[lo][0] < diagonal - most:
            lo += 1
        while hi < len(hits) and hits[hi][0] <= diagonal + most:
            hi += 1
        if hi - lo < least or len({x for _, x in hits[lo:hi]}) < least:
            continue
        d0, d1 = k + diagonal, last + diagonal
        before = _reach(item[:k][::-1], doc[max(0, d0 - size) : d0][::-1], most)
        after = _reach(item[last:], doc[d1 : d1 + size], most)
        for x, b in enumerate(before):
            if x and not b:
                continue
            for y, a in enumerate(after[: most - x + 1]):
                if y and not a:
                    continue
                words = word_of[last - 1 + a] - word_of[k - b] + 1
                if words >= min_words and x + y <= round(words * share) and (best is None or (words, -x - y) > (best[0], -best[1])):
                    best = (words, x + y)
    return best


def _item_rows(items: DataFrame, item_id: str, text: str, min_words: int) -> DataFrame:
    """item, text, hashes, n_tokens of the distinct items that are long enough."""
    kind = items.schema[item_id].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            held: dict[int, list[int]] = defaultdict(list)
            for of, _, h in shingles.shingle_hashes(texts):
                for n in np.unique(of):
                    held[int(n)] = h[of == n].view(np.int64).tolist()
            keep = [n for n in sorted(held) if (words_of_tokens(texts[n])[1] or [-1])[-1] + 1 >= min_words]
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(keep)), pa.array([texts[n] for n in keep]), pa.array([held[n] for n in keep], pa.list_(pa.int64())), pa.array([len(held[n]) + SHINGLE - 1 for n in keep], pa.int32())], ["item", "text", "hashes", "n_tokens"])

    rows = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("item"), F.col(text).alias("text")).distinct()
    return rows.mapInArrow(parse, f"item {kind}, text string, hashes array<bigint>, n_tokens int")


def _filter_of(parsed: DataFrame, bits: int) -> shingles.Filter:
    """The filter of all items' shingles; its words are joined by the executors before they reach the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = shingles.Filter(bits)
        for batch in batches:
            h = batch.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.unique(np.concatenate(empty.places(h)))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            if len(word):
                bit = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bit.view(np.int64))], ["word", "bit"])

    found = parsed.select("hashes").mapInArrow(mark, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = shingles.Filter(bits)
    out.add_words(found["word"].to_numpy(), found["bit"].to_numpy().view(np.uint64))
    return out


def leaks(documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, min_words: int = 14, changed_share: float = 0.15) -> DataFrame:
    """doc_id, item_id, words, changed: the longest passage of the item that the text holds.

    A passage has at least min_words successive words of the item, of which up
    to changed_share (rounded) are replaced, added or left out; it begins and
    ends with a word that is the same. NULL and empty texts and items hold
    nothing; an item shorter than min_words cannot leak; rows that repeat a
    doc_id or item_id are looked at one by one and give distinct rows. Other
    columns play no part, whatever their names.
    """
    least = least_kept(min_words, changed_share)
    spark = documents.sparkSession
    kinds = {"doc": documents.schema[doc_id].dataType.simpleString(), "item": items.schema[item_id].dataType.simpleString()}
    rows = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    parsed = cut(_item_rows(items, item_id, item_text, min_words))
    size = parsed.agg(F.sum(F.size("hashes")).alias("n"), F.max("n_tokens").alias("longest")).first()
    if not size["n"]:
        return spark.createDataFrame([], f"`{doc_id}` {kinds['doc']}, `{item_id}` {kinds['item']}, words int, changed int")
    bits = min(MOST_BITS, max(10, int(16 * size["n"]).bit_length()))
    known = spark.sparkContext.broadcast(_filter_of(parsed, bits))
    reach = size["longest"] + round(size["longest"] * changed_share)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, at, h in shingles.shingle_hashes(batch.column("text").to_pylist()):
                hit = np.flatnonzero(known.value.held(h))
                if len(hit) < least:
                    continue
                of, at, h = of[hit], at[hit], h[hit]
                # Where least of them lie within an item's reach.
                dense = np.flatnonzero((of[least - 1 :] == of[: len(of) - least + 1]) & (at[least - 1 :] - at[: len(at) - least + 1] <= reach))
                keep = np.zeros(len(of) + 1, dtype=np.int64)
                np.add.at(keep, dense, 1)
                np.add.at(keep, dense + least, -1)
                keep = np.cumsum(keep[:-1]) > 0
                if keep.any():
                    # A document needs each shingle once from here on.
                    pairs = np.unique(np.stack([of[keep], h[keep].view(np.int64)]), axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(pairs[0])), pa.array(pairs[1])], ["doc", "h"])

    # Used three times, read from the corpus once; a narrow row per kept place.
    places = cut(rows.mapInArrow(look, f"doc {kinds['doc']}, h bigint"))
    counts = places.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    each = parsed.select("item", "text", F.posexplode("hashes").alias("k", "h"))
    counted = each.join(counts, "h", "left").groupBy("item", "text").agg(F.array_sort(F.collect_list(F.struct("k", "h", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")))).alias("l"))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"row": [], "h": [], "n": []}
            for n, listed in enumerate(batch.column("l").to_pylist()):
                h, c = (np.array([x[key] for x in listed], dtype=np.int64) for key in ("h", "n"))
                # What no document has cannot be found; it still takes its place in the order.
                chosen = wanted(h, c, min_words, changed_share) & (c > 0)
                for a, b in sorted(set(zip(h[chosen].tolist(), c[chosen].tolist(), strict=True))):
                    out["row"].append(n)
                    out["h"].append(a)
                    out["n"].append(b)
            if out["row"]:
                take = pa.array(out["row"])
                yield pa.RecordBatch.from_arrays([batch.column("item").take(take), batch.column("text").take(take), pa.array(out["h"], pa.int64()), pa.array(out["n"], pa.int64())], ["item", "item_text", "h", "n"])

    looked_up = counted.select("item", "text", "l").mapInArrow(prefix, f"item {kinds['item']}, item_text string, h bigint, n bigint")
    often = F.col("n") >= FREQUENT
    looked_up = looked_up.withColumn("salt", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("n")
    frequent = counts.where(often).select("h", F.lit(True).alias("often"))
    salted = places.join(frequent, "h", "left").withColumn("salt", F.when(F.col("often"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    pairs = cut(salted.join(looked_up, ["h", "salt"]).select("doc", "item", "item_text").distinct())
    n_docs = pairs.groupBy("doc").agg(F.ceil(F.count(F.lit(1)) / F.lit(ITEMS_A_CALL)).cast("int").alias("calls"))
    few = n_docs.count() <= BROADCAST_ROWS
    near = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    lists = pairs.join(n_docs, "doc").groupBy("doc", F.pmod(F.xxhash64("item", "item_text"), "calls").alias("call")).agg(F.collect_list(F.struct("item", "item_text")).alias("items"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[list[str], list[int]]] = {}
        for batch in batches:
            out: dict[str, list] = {"at": [], "item": [], "words": [], "changed": []}
            kind = batch.schema.field("items").type.value_type.field("item").type
            for n, (value, listed) in enumerate(zip(batch.column("text").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                doc = tokens(value)
                found: dict[str, list[int]] = defaultdict(list)
                for d in range(len(doc) - SHINGLE + 1):
                    found[" ".join(doc[d : d + SHINGLE])].append(d)
                for x in listed:
                    if x["item_text"] not in seen:
                        if len(seen) > 5_000:
                            seen.clear()
                        seen[x["item_text"]] = words_of_tokens(x["item_text"])
                    got = longest_passage(*seen[x["item_text"]], doc, found, min_words, changed_share)
                    if got:
                        for key, v in zip(out, (n, x["item"], *got), strict=True):
                            out[key].append(v)
            if out["at"]:
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(out["at"])), pa.array(out["item"], kind), pa.array(out["words"], pa.int32()), pa.array(out["changed"], pa.int32())], ["doc", "item", "words", "changed"])

    # A document of many items comes once per call, so one text is never met with an unbounded list.
    met = rows.join(near(lists.select("doc", "items")), "doc").select("doc", "text", "items")
    passages = met.mapInArrow(verify, f"doc {kinds['doc']}, item {kinds['item']}, words int, changed int")
    longest = passages.groupBy("doc", "item").agg(F.max(F.struct("words", (-F.col("changed")).alias("c"))).alias("x"))
    return longest.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.col("x.words").alias("words"), (-F.col("x.c")).alias("changed"))
