"""Word shingles of many texts at once, as 64-bit hashes (numpy over code points)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

from ionloom.llm.text import plain

#: Words of a shingle.
WORDS = 3
#: Characters worked on at once; a longer text is worked on alone.
CHARACTERS = 1 << 20
_BASE, _MIX_1, _MIX_2, _SECOND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


@lru_cache(maxsize=1)
def _in_word() -> np.ndarray:
    """For every code point whether it is a letter or a digit, as in text.tokens."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX_1
    h = (h ^ (h >> np.uint64(27))) * _MIX_2
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: Sequence[str], beginnings: int | None = None) -> tuple[np.ndarray, ...]:
    """(text number, hash) of every word of the texts, which are plain and casefolded, in order; with beginnings also the hash of so many of its first letters."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    inside = _in_word()[codes]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    start = np.flatnonzero(begin)
    if not len(start):
        return (np.empty(0, np.int64), *[np.empty(0, np.uint64)] * (1 if beginnings is None else 2))
    letters = codes[inside].astype(np.uint64)
    first = np.flatnonzero(begin[inside])
    sizes = np.diff(first, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _BASE, dtype=np.uint64))
    parts = letters * powers[place]
    ends = np.cumsum([len(t) + 1 for t in texts])
    out = [np.searchsorted(ends, start, side="right"), _mixed(np.add.reduceat(parts, first) + sizes.astype(np.uint64))]
    if beginnings is not None:
        parts[place >= beginnings] = 0
        out.append(_mixed(np.add.reduceat(parts, first) + np.minimum(sizes, beginnings).astype(np.uint64)))
    return tuple(out)


def shingle_hashes(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, place of the first word in its text, hash) of every shingle, in order, for lots of texts.

    NULL texts and those of fewer words than a shingle have none.
    """
    lot: list[str] = []
    size, begin = 0, 0
    for n, text in enumerate([*texts, None]):
        last = n == len(texts)
        if lot and (last or size + len(text or "") > CHARACTERS):
            of, words = word_hashes(lot)
            if len(words) >= WORDS:
                joined = _mixed(words[:-2] * _MIX_1 + _mixed(words[1:-1] * _MIX_2 + words[2:]))
                whole = of[:-2] == of[2:]
                start = np.searchsorted(of, of[:-2])
                yield (of[:-2][whole] + begin, (np.arange(len(joined)) - start)[whole], joined[whole])
            lot, size, begin = [], 0, n
        if not last:
            lot.append("" if text is None else plain(text).casefold())
            size += len(lot[-1]) + 1


class Filter:
    """Which hashes may be among those put in; of a fixed size, so more of them only let more others pass."""

    def __init__(self, bits: int):
        self.bits = bits
        self.words = np.zeros(1 << max(0, bits - 6), dtype=np.uint64)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - self.bits)
        return hashes >> shift, (hashes * _SECOND) >> shift

    def add_words(self, words: np.ndarray, values: np.ndarray) -> None:
        self.words[words] |= values

    def held(self, hashes: np.ndarray) -> np.ndarray:
        one, two = self.places(hashes)
        bit = lambda p: (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)
        out = bit(one).astype(bool)
        out[out] = bit(two[out]).astype(bool)
        return out
