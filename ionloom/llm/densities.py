"""Densities learned from labelled texts: how much a text's words speak for a label.

Every word, pair of words and word beginning is hashed into a table of fixed
size; a bucket's weight is the shrunk log-odds of its being in texts with the
label. A text is described by its densest stretch of a few words, its weightiest
word and its total, worked out for many texts at once from hashes of words.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from ionloom.llm import shingles
from ionloom.llm.text import plain

#: Buckets per kind, and the kinds: words, pairs of words, first letters of words.
BITS, KINDS = 18, 3
#: Words of a stretch, letters of a beginning.
STRETCH, LETTERS = 8, 5
NAMES = ("learned_stretch", "learned_word", "learned_total")
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def buckets(texts: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(text number of every word, bucket of it per kind); a text's first word has its pair with nothing."""
    of, words, begun = shingles.word_hashes([plain(t).casefold() for t in texts], LETTERS)
    before = np.concatenate([np.zeros(1, np.uint64), words[:-1]]) if len(words) else words
    if len(words):
        before = np.where(np.r_[True, of[1:] != of[:-1]], np.uint64(0), before)
    down = np.uint64(64 - BITS)
    return of, [(h >> down).astype(np.int64) for h in (words, (words + before * _PAIR) * _PAIR, begun)]


def presence(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket over all kinds) of what each text holds, each once."""
    of, kinds = buckets(texts)
    every = np.unique(np.concatenate([(of << (BITS + 2)) + (k << BITS) + b for k, b in enumerate(kinds)])) if len(of) else np.empty(0, np.int64)
    return every >> (BITS + 2), every & ((1 << (BITS + 2)) - 1)


def weights(bucket: np.ndarray, positive: np.ndarray, negative: np.ndarray, n_positive: int, n_negative: int) -> np.ndarray:
    """Table of log-odds from counts of texts per bucket; buckets that were hardly seen weigh little."""
    out = np.zeros(KINDS << BITS, dtype=np.float32)
    seen = positive + negative
    odds = np.log((positive + 1) / (n_positive + 2)) - np.log((negative + 1) / (n_negative + 2))
    out[bucket] = np.clip(odds * seen / (seen + 4.0), -2.0, 4.0)
    return out


def described(texts: Sequence[str | None], table: np.ndarray) -> np.ndarray:
    """A row of NAMES per text; zeros for NULL and empty ones."""
    out = np.zeros((len(texts), len(NAMES)))
    lot: list[tuple[int, str]] = []
    size = 0
    for n, text in enumerate([*texts, None]):
        if lot and (n == len(texts) or size + len(text or "") > shingles.CHARACTERS):
            of, kinds = buckets([t for _, t in lot])
            if len(of):
                score = sum(table[(k << BITS) + b] for k, b in enumerate(kinds)).astype(float)
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                ends = np.r_[first[1:], len(of)]
                # Sums of stretches that end with each word and do not reach into the text before.
                sums = np.concatenate([[0.0], np.cumsum(score)])
                at = np.arange(1, len(of) + 1)
                begin = np.maximum(at - STRETCH, np.repeat(first, ends - first))
                stretch = np.maximum.reduceat((sums[at] - sums[begin]) / STRETCH, first)
                which = np.array([n_ for n_, _ in lot])[of[first]]
                out[which] = np.stack([stretch, np.maximum.reduceat(score, first), np.add.reduceat(np.maximum(score - 1.0, 0.0), first)], axis=1)
            lot, size = [], 0
        if n < len(texts) and text:
            lot.append((n, text))
            size += len(text)
    return out
