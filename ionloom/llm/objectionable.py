"""Scores for abusive, hateful or sexually explicit language.

Every text becomes a few dozen dense features: densities learned from labelled
texts over all its words; and per sentence the densities of the word lists, patterns, the distance from the person spoken to to the nearest
harsh word, capitals, punctuation and spellings made to evade lists; the text's
features are those of its worst sentence and some totals. Gradient-boosted
trees are fitted here on what reviewers said, and isotonic regression turns
their margin into a probability. Fitting takes at most ``max_labels`` labelled
texts, the ones whose hash is smallest; scoring covers every text in full.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.llm import densities, lexicon
from ionloom.llm.text import INVISIBLE, plain
from ionloom.session import stored

# Letters of other scripts that look like Latin ones, and digits and signs used for letters.
LOOKALIKE = str.maketrans("асеорхуіѕјԁѵкмтвнАСЕОРХУІЅЈКМТВНαοερτυικν", "aceopxyisjdvkmtbhACEOPXYISJKMTBHaoeptuikv")
LEET = str.maketrans("013457@$!|€", "oieastasile")

KINDS = ("insult", "profanity", "violence", "sexual", "soft", "group", "dehumanise", "second", "first", "technical")
_LISTS = dict(zip(KINDS, (lexicon.INSULT, lexicon.PROFANITY, lexicon.VIOLENCE, lexicon.SEXUAL, lexicon.SOFT, lexicon.GROUP, lexicon.DEHUMANISE, lexicon.SECOND, lexicon.FIRST, lexicon.TECHNICAL), strict=True))
_BIT = {k: 1 << i for i, k in enumerate(KINDS)}
_HARSH = _BIT["insult"] | _BIT["profanity"] | _BIT["violence"] | _BIT["sexual"] | _BIT["dehumanise"]
_TOUCHED = _HARSH | _BIT["soft"] | _BIT["group"]
#: Put behind a word whose evasive spelling was undone.
_MARK = "\ue000"
_EVADED = _BIT["insult"] | _BIT["profanity"] | _BIT["sexual"] | _BIT["soft"]
#: Words of these lists count as evaded only if long, as short ones come about by chance.
_EVADED_LONG, _LONG = _BIT["violence"] | _BIT["dehumanise"], 5
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”’)\]]*\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
#: Single letters set apart, letters masked by signs, and signs or digits within a word.
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*·]){2,}[^\W\d_](?![^\W_])")
_APART = re.compile(r"(?<![^\W_])[^\W\d_](?![^\W_])")
_MASKED = re.compile(r"(?<![^\W_*#])[^\W\d_]+[*#]+[^\W\d_]*(?![^\W_*#])")
_BROKEN = re.compile(r"(?<![^\W_])[^\W\d_]+(?:[.\-_·|][^\W\d_]+)+(?![^\W_])")
_OTHER_SCRIPT = re.compile("[\u0370-\u03ff\u0400-\u052f]")
_OUTER = ".,;:!?\"'“”‘’()[]{}<>«»"
_SIGNS = frozenset("013457@$!|€")
_TRIPLES = [c * 3 for c in "abcdefghijklmnopqrstuvwxyzäöüéèêáíóúñç"]
_LONG_RUN = re.compile(r"[^\W\d_]*([^\W\d_])\1{2,}[^\W\d_]*")
_MIXED = re.compile(r"(?<![^\W_@$!|€])(?=[^\s]*[^\W\d_])(?=[^\s]*[0134570@$!|€])[0134570@$!|€\w]+(?![^\W_])")
# Short words that may stand between words whose letters are set apart.
_BETWEEN = frozenset("a an and are be i in is it like me my no of off so such the this to u up you your das dein der die du ein eine ihr und wie con de el en eres la le les te ton tu un una une y".split())


#: Latin letters with marks to those without, ß to ss; from Unicode's own decompositions.
_UNMARKED = {i: "".join(c for c in unicodedata.normalize("NFD", chr(i)) if not unicodedata.combining(c)) for r in ((0xC0, 0x250), (0x1E00, 0x1F00)) for i in range(*r)} | {0xDF: "ss"} | dict.fromkeys(range(0x300, 0x370))


def fold(text: str) -> str:
    """Without accents; ß as ss."""
    return text if text.isascii() else text.translate(_UNMARKED)


_WHOLE: dict[str, int] = {}
_STEMS: dict[str, int] = {}
for _kind, _words in _LISTS.items():
    for _w in _words:
        _target = _STEMS if _w.endswith("*") else _WHOLE
        _key = fold(_w.rstrip("*").casefold())
        _target[_key] = _target.get(_key, 0) | _BIT[_kind]
_LONGEST = max(map(len, _STEMS))


@lru_cache(maxsize=200_000)
def word_bits(word: str) -> int:
    """Lists that hold the (folded) word."""
    bits = _WHOLE.get(word, 0)
    for n in range(3, min(len(word), _LONGEST) + 1):
        bits |= _STEMS.get(word[:n], 0)
    return bits


def listed(word: str) -> bool:
    """Whether a word whose spelling was undone is one that people disguise."""
    bits = word_bits(fold(word.casefold()))
    return bool(bits & _EVADED) or len(word) >= _LONG and bool(bits & _EVADED_LONG)


@lru_cache(maxsize=20_000)
def _unmask(masked: str) -> str | None:
    """The listed word that a masked spelling such as i***t stands for."""
    pattern = re.compile(re.sub(r"\\?[*#]", "[a-z]", re.escape(masked)) + r"\Z")
    for words in (_WHOLE, _STEMS):
        for word, bits in words.items():
            if len(word) == len(masked) and (bits & _EVADED or len(word) >= _LONG and bits & _EVADED_LONG) and pattern.match(word):
                return word
    return None


@lru_cache(maxsize=20_000)
def _parted(run: str) -> str | None:
    """Letters set apart as the words they spell, listed ones marked; None unless the whole run is listed and short words, one of them listed."""
    if listed(run):
        return run + _MARK
    # For every place the fewest words up to it, as (words, text).
    best: list[tuple[int, str, bool] | None] = [(0, "", False), *[None] * len(run)]
    for end in range(1, len(run) + 1):
        for begin in range(max(0, end - 16), end):
            word, before = run[begin:end], best[begin]
            if before is None:
                continue
            bad = len(word) >= 3 and listed(word)
            if (bad or word.casefold() in _BETWEEN) and (best[end] is None or before[0] + 1 < best[end][0]):
                best[end] = (before[0] + 1, f"{before[1]} {word}{_MARK if bad else ''}", before[2] or bad)
    return best[-1][1].strip() if best[-1] and best[-1][2] else None


@lru_cache(maxsize=200_000)
def _disguise(word: str) -> int:
    """1: masked, 2: broken up, 4: with signs or digits for letters, so that a listed word may be meant; 8: with a letter set apart."""
    apart = 8 if _APART.search(word) else 0
    word = word.strip(_OUTER)
    if len(word) < 3 or word.isalpha() or not any(map(str.isalpha, word)):
        return apart
    masked = "*" in word or "#" in word
    broken = not word.isalnum() and any(listed(re.sub(r"[.\-_·|]", "", m.group())) for m in _BROKEN.finditer(word))
    return apart + masked + 2 * broken + 4 * (not _SIGNS.isdisjoint(word) and listed(word.translate(LEET).strip("_")))


def reveal(text: str) -> str:
    """The text with evasive spellings undone where they stand for a listed word, each marked by _MARK behind it."""

    def joined(m: re.Match) -> str:
        word = re.sub(r"[.\-_·|]", "", m.group())
        return word + _MARK if listed(word) else m.group()

    def parted(m: re.Match) -> str:
        return _parted(re.sub(r"[ .\-_*·]", "", m.group())) or m.group()

    def unmasked(m: re.Match) -> str:
        word = _unmask(fold(m.group().casefold()))
        return word + _MARK if word else m.group()

    def unleet(m: re.Match) -> str:
        word = m.group().translate(LEET).strip("_")
        return word + _MARK if word.isalpha() and listed(word) else m.group()

    def shortened(m: re.Match) -> str:
        word = m.group()
        for short in (_RUN.sub(r"\1", word), _RUN.sub(r"\1\1", word)):
            if listed(short):
                return short + _MARK
        return word

    def latin(m: re.Match) -> str:
        word = m.group().translate(LOOKALIKE)
        return word + _MARK if word != m.group() and listed(word) else m.group()

    if not text.isascii() and _OTHER_SCRIPT.search(text):
        text = _WORD.sub(latin, text)
    # Patterns are tried only where the text's words give them something to find.
    found, letters = 0, 0
    for word in set(text.split()):
        if word.isalpha():
            letters += len(word) == 1
        elif not word.replace(".", "").isdigit():
            # Plain numbers, of which each is another, hide nothing.
            found |= _disguise(word)
    if found & 1:
        text = _MASKED.sub(unmasked, text)
    if found & 2:
        text = _BROKEN.sub(joined, text)
    if found & 4:
        text = _MIXED.sub(unleet, text)
    # Letters set apart are words of one letter, or lie within a word of single letters and signs.
    if letters > 1 or found & 8:
        text = _SPACED.sub(parted, text)
    low = text.lower()
    for c in _TRIPLES:
        if c in low:
            return _LONG_RUN.sub(shortened, text)
    return text


def alternatives(pattern: str) -> list[str]:
    """A pattern cut at its outermost bars."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(pattern):
        if c in "([" and pattern[i - 1 : i] != "\\":
            depth += 1
        elif c in ")]" and pattern[i - 1 : i] != "\\":
            depth -= 1
        elif c == "|" and not depth:
            out.append(pattern[begin:i])
            begin = i + 1
    return [x for x in [*out, pattern[begin:]] if x]


def openings(pattern: str) -> set[str]:
    """What the first word of any match begins with; with a blank behind it the whole word. "" stands for any word."""
    if pattern[:1] == "(":
        depth = end = 0
        for end, c in enumerate(pattern):
            depth += (c == "(") - (c == ")")
            if not depth:
                break
        rest = pattern[end + 1 :]
        optional = rest[:1] in ("?", "*")
        rest = rest[1:] if optional else rest
        out = {x for a in alternatives(pattern[1:end].removeprefix("?:")) for x in openings(a + rest)}
        return out | (openings(rest) if optional else set())
    word = ""
    for i, c in enumerate(pattern):
        if c == " ":
            return {word + " "}
        if not c.isalpha() or pattern[i + 1 : i + 2] in ("?", "*", "{"):
            return {word}
        word += c
    return {word + " "}


#: (kind, pattern, what its matches begin with) of every phrase.
_PHRASES = [(kind, re.compile(f"(?:{x})" + r"(?:\b|(?<=\s))"), tuple(openings(x))) for kind, lines in lexicon.PHRASES.items() for line in lines.strip().split("\n") for x in alternatives(line)]


@lru_cache(maxsize=200_000)
def about(word: str) -> tuple[int, tuple]:
    """(lists that hold the word, phrases that may begin with it)."""
    return word_bits(word), tuple((k, p) for k, p, begins in _PHRASES if any((word + " ").startswith(b) for b in begins))


def phrases(words: list[str], told: list[tuple[int, tuple]], begun: set[str] | None = None) -> dict[str, int]:
    """How many phrases of each kind the words hold, none within another of its kind; each is tried only where its first word stands.
    begun: takes the first words of those found, but for phrases that say nothing by themselves."""
    out = dict.fromkeys(lexicon.PHRASES, 0)
    if any(t for _, t in told):
        flat, at, until = " ".join(words), 0, dict.fromkeys(out, 0)
        for word, (_, may) in zip(words, told, strict=True):
            for kind, pattern in may:
                if at >= until[kind] and (m := pattern.match(flat, at)):
                    out[kind] += 1
                    until[kind] = max(m.end(), at + 1)
                    if begun is not None and kind != "exclude":
                        begun.add(word)
            at += len(word) + 1
    return out


def _words(low: str) -> list[str]:
    words = _WORD.findall(low)
    return [w.replace("'", "").replace("’", "") for w in words] if "'" in low or "’" in low else words


SENTENCE_FEATURES = (*(f"{k}_density" for k in KINDS), *(f"{k}_count" for k in KINDS), "degrade", "threat", "hate", "lewd", "second_to_harsh", "group_to_dehumanise", "capitals", "marks", "evaded", "words", "evidence")
N_SENTENCE = len(SENTENCE_FEATURES)
LISTED = (*(f"worst_{x}" for x in SENTENCE_FEATURES), "total_evaded")
FEATURES = (*LISTED, *densities.NAMES)


def sentence_features(sentence: str, low: str, hidden: int) -> list[float] | None:
    """Features of one revealed sentence (low: folded and in lower case), or None
    where no list or pattern is touched. hidden: invisible characters taken out."""
    words = _words(low)
    if not words:
        return None
    evaded = sentence.count(_MARK)
    told = [about(w) for w in words]
    bits = [b for b, _ in told]
    found = phrases(words, told)
    group_named = any(b & _BIT["group"] for b in bits)
    excluded = found.pop("exclude")
    found["hate"] += excluded if group_named else 0
    if not any(b & _TOUCHED for b in bits) and not any(found.values()):
        return None
    counts = [sum(1 for b in bits if b & _BIT[k]) for k in KINDS]
    n = len(words)
    c = dict(zip(KINDS, counts, strict=True))
    near = lambda a, b: max((1.0 / (1 + abs(i - j)) for i, x in enumerate(bits) if x & a for j, y in enumerate(bits) if y & b and (i != j)), default=0.0)
    second = near(_BIT["second"], _HARSH)
    group = near(_BIT["group"], _BIT["dehumanise"] | _BIT["insult"] | _BIT["violence"])
    letters = sum(ch.isalpha() for ch in sentence)
    capitals = sum(ch.isupper() for ch in sentence) / letters if letters > 8 else 0.0
    marks = sum(ch in "!?*#@$" for ch in sentence) / max(1, len(sentence))
    if hidden:
        evaded += 1 if c["insult"] + c["profanity"] + c["sexual"] + c["soft"] else 0
    evidence = (
        2.0 * (found["degrade"] > 0) + 1.6 * (found["threat"] > 0) + 2.0 * (found["hate"] > 0) + 2.4 * (found["lewd"] > 0)
        + 1.0 * c["insult"] + 1.2 * c["profanity"] + 0.5 * c["violence"] + 1.2 * c["sexual"] + 0.4 * c["soft"] + 0.3 * c["group"] + 0.6 * c["dehumanise"]
        + 2.0 * second + 1.5 * group + 2.0 * min(evaded, 2) - 0.8 * c["technical"]
    )
    return [x / n for x in counts] + [float(x) for x in counts] + [float(found["degrade"]), float(found["threat"]), float(found["hate"]), float(found["lewd"]), second, group, capitals, marks, float(evaded), float(n), evidence]


def text_features(text: str | None) -> np.ndarray:
    """The text's features from lists and phrases; zeros for NULL, empty and blank texts."""
    out = np.zeros(len(LISTED))
    if not text:
        return out
    rows, at = [], N_SENTENCE - 1

    def look(part: str, hidden: int) -> None:
        shown = reveal(part)
        # Most texts hold nothing of any list: seen once for the whole text, not per sentence.
        words = _words(fold(shown.casefold()))
        told = [about(w) for w in words]
        begun: set[str] = set()
        phrases(words, told, begun)
        telling = begun | {w for w, (b, _) in zip(words, told, strict=True) if b & _TOUCHED}
        if not telling:
            return
        for sentence in _SENTENCE.split(shown):
            low = fold(sentence.casefold())
            # Letters as they are looked for: words lose their apostrophes.
            flat = low.replace("'", "").replace("’", "") if "'" in low or "’" in low else low
            for word in telling:
                if word in flat:
                    row = sentence_features(sentence, low, hidden)
                    if row is not None:
                        rows.append(row)
                    break

    look(plain(text), 0)
    if rows and not text.isascii() and INVISIBLE.search(text):
        # The sentences with invisible characters once more, as such.
        for part in _SENTENCE.split(text):
            if INVISIBLE.search(part):
                look(plain(part), 1)
    if rows:
        worst = max(range(len(rows)), key=lambda i: rows[i][at])
        out[:N_SENTENCE] = rows[worst]
        out[N_SENTENCE] = sum(r[N_SENTENCE - 3] for r in rows)
    return out


#: Parts of the labelled texts, each described and judged by what the others taught.
FOLDS = 5
#: Features that speak for objectionable language whatever else holds.
RISING = frozenset(i for i, x in enumerate(FEATURES) if x.removeprefix("worst_") in {"evidence", "degrade", "threat", "hate", "lewd", "second_to_harsh", "group_to_dehumanise", "evaded", "insult_count", "profanity_count", "sexual_count", "total_evaded", *densities.NAMES})


class BoostedTrees:
    """Gradient-boosted trees on quantile-binned features with logistic loss."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, smallest_leaf: float = 4.0, penalty: float = 3.0, bins: int = 32, columns: float = 0.4, rising: frozenset[int] = frozenset(), seed: int = 7):
        """columns: share of the features each tree may use; rising: features whose larger values may not lower a split's side."""
        self.rounds, self.depth, self.rate, self.smallest_leaf, self.penalty, self.bins = rounds, depth, rate, smallest_leaf, penalty, bins
        self.columns, self.rising, self.seed = columns, rising, seed
        self.base, self.edges, self.trees = 0.0, [], []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1) if x.shape[1] else x.astype(int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(p / (1 - p)))
        self.edges = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, self.bins + 1)[1:-1])) if len(np.unique(c)) > 1 else np.empty(0) for c in x.T]
        b, margin = self._binned(x), np.full(len(y), self.base)
        pick = np.random.default_rng(self.seed)
        for _ in range(self.rounds):
            use = pick.permutation(x.shape[1])[: max(1, round(self.columns * x.shape[1]))]
            q = 1 / (1 + np.exp(-margin))
            g, h = q - y, q * (1 - q)
            node, tree = np.zeros(len(y), dtype=int), {}
            for level in range(self.depth):
                for leaf in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == leaf)
                    split = self._best(b[rows], g[rows], h[rows], use) if len(rows) > 1 else None
                    if split:
                        tree[leaf] = split
                        node[rows] = 2 * leaf + 1 + (b[rows, split[0]] > split[1])
            leaves = 2 ** (self.depth + 1)
            values = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.penalty)
            margin += values[node]
            self.trees.append((tree, values))
        return self

    def _best(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, use: np.ndarray) -> tuple[int, int] | None:
        total_g, total_h, best, found = g.sum(), h.sum(), 1e-6, None
        parent = total_g**2 / (total_h + self.penalty)
        for f in use:
            e = self.edges[f]
            if not len(e):
                continue
            size = len(e) + 1
            left_g = np.cumsum(np.bincount(b[:, f], g, size))[:-1]
            left_h = np.cumsum(np.bincount(b[:, f], h, size))[:-1]
            left_n = np.cumsum(np.bincount(b[:, f], minlength=size))[:-1]
            gain = left_g**2 / (left_h + self.penalty) + (total_g - left_g) ** 2 / (total_h - left_h + self.penalty) - parent
            if int(f) in self.rising:
                gain[-left_g / (left_h + self.penalty) > -(total_g - left_g) / (total_h - left_h + self.penalty)] = 0
            gain[(left_n < self.smallest_leaf) | (len(g) - left_n < self.smallest_leaf)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], (int(f), k)
        return found

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = self._binned(x), np.full(len(x), self.base)
        for tree, values in self.trees:
            node = np.zeros(len(x), dtype=int)
            for leaf in sorted(tree):
                f, k = tree[leaf]
                here = node == leaf
                node[here] = 2 * leaf + 1 + (b[here, f] > k)
            out += values[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margins, probabilities) of the non-decreasing fit, by pooling adjacent violators."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, t in zip(margin[order], y[order], strict=True):
        blocks.append([float(t), 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, last]
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Scorer:
    """Trees with their calibration and the table of learned densities; some megabytes, so it is sent to all tasks.

    Too few labels, or labels of one kind only, teach nothing: every score is then NaN, which scored() gives as NULL.
    """

    def __init__(self, x: np.ndarray, labels: list[int], fold: np.ndarray | None = None, table: np.ndarray | None = None, least_labels: int = 10):
        """x: rows of FEATURES; the learned ones of a row must come from texts of other folds than its own, or they would promise too much."""
        y = np.array(labels, dtype=float)
        self.trees, self.table = None, table
        if len(y) < least_labels or y.min() == y.max():
            return
        fold = np.arange(len(y)) % FOLDS if fold is None else fold
        # Calibrated on margins of trees that had not seen the text.
        held = np.zeros(len(y))
        for k in np.unique(fold):
            seen = fold != k
            held[~seen] = BoostedTrees(rising=RISING).fit(x[seen], y[seen]).margin(x[~seen]) if 0 < y[seen].sum() < seen.sum() else 0.0
        self.trees = BoostedTrees(rising=RISING).fit(x, y)
        self.at, self.probability = isotonic(held, y)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if self.trees is None:
            return np.full(len(texts), np.nan)
        x = np.stack([text_features(t) for t in texts])
        return np.interp(self.trees.margin(np.hstack([x, densities.described(texts, self.table)])), self.at, self.probability)


def fit(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_labels: int = 20_000) -> Scorer:
    """Scorer from labelled texts; several labels of a text count by their mean, ties as not objectionable.

    The labelled texts (at most max_labels, those with the smallest hash) are fetched once and kept in the checkpoint folder.
    Executors count words and describe texts; counts per bucket and feature rows are all that reaches the driver.
    """
    spark = documents.sparkSession
    said = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id).agg(F.avg(label).alias("_y"))
    said = said.orderBy(F.xxhash64(doc_id), doc_id).limit(max_labels)
    held = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(said.withColumnRenamed(doc_id, "id")), "id")
    held = held.select("id", "text", (F.col("_y") > 0.5).cast("int").alias("y"), F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold"))
    held = stored(held.repartition(spark.sparkContext.defaultParallelism))
    sizes = {(r["fold"], r["y"]): r["n"] for r in held.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("fold").to_numpy() * 2 + batch.column("y").to_numpy()
            of, bucket = densities.presence(batch.column("text").to_pylist())
            key, n = np.unique(part[of].astype(np.int64) << 40 | bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 40), pa.array(key & ((1 << 40) - 1)), pa.array(n)], ["part", "bucket", "n"])

    # A bucket that one text holds tells nothing.
    counts = held.mapInArrow(count, "part bigint, bucket bigint, n bigint").groupBy("bucket").pivot("part", list(range(2 * FOLDS))).agg(F.sum("n")).na.fill(0)
    counts = counts.where(sum((F.col(str(p)) for p in range(2 * FOLDS)), F.lit(0)) > 1).toArrow()
    bucket = counts["bucket"].to_numpy()
    by = np.stack([counts[str(p)].to_numpy() for p in range(2 * FOLDS)]) if len(bucket) else np.zeros((2 * FOLDS, 0))
    of_kind = lambda y, without: sum((by[2 * k + y] for k in range(FOLDS) if k != without), np.zeros(len(bucket)))
    texts_of = lambda y, without: sum(n for (k, label_), n in sizes.items() if label_ == y and k != without)
    tables = [densities.weights(bucket, of_kind(1, k), of_kind(0, k), texts_of(1, k), texts_of(0, k)) for k in (*range(FOLDS), None)]
    shared = spark.sparkContext.broadcast(tables[:FOLDS])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, fold = batch.column("text").to_pylist(), batch.column("fold").to_numpy()
            x = np.hstack([np.array([text_features(t) for t in texts]).reshape(-1, len(LISTED)), np.zeros((len(texts), len(densities.NAMES)))])
            for k in np.unique(fold):
                some = np.flatnonzero(fold == k)
                # With the weights that texts of the other folds gave.
                x[some, len(LISTED) :] = densities.described([texts[i] for i in some], shared.value[k])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), batch.column("fold"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "y", "fold", "x"])

    kind = documents.schema[doc_id].dataType.simpleString()
    rows = held.mapInArrow(describe, f"id {kind}, y int, fold int, x array<double>").collect()
    rows.sort(key=lambda r: (r["id"], r["x"]))
    return Scorer(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), [r["y"] for r in rows], np.array([r["fold"] for r in rows]), tables[-1])


def scored(documents: DataFrame, scorer: Scorer, doc_id: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, and score in 0..1 for every row; NULL and empty texts score lowest. NULL scores where the scorer had nothing to learn from."""
    shared = documents.sparkSession.sparkContext.broadcast(scorer)
    rows = documents.select(doc_id, *keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in (doc_id, *keep)) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(shared.value.score(batch.column("_text").to_pylist()), pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (doc_id, *keep)), score], [doc_id, *keep, "score"])

    return rows.mapInArrow(run, schema)
