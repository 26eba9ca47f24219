"""Reading level by gradient-boosted regression trees.

Features of a document are distributions over its segments (sentences and note lines), weighted by their
length: word and sentence length, vocabulary grade (how demanding the labelled documents are in which a word
occurs), syntax (function words, commas, subordinators), and cohesion (words shared by successive segments).
The trees predict a grade; five folds by source give held-out grades, on which the four cut points between
the bands are calibrated; the accuracy is measured on each fold with cut points of the others. Texts of other
languages are told by their function words and by the letter trigrams of the labelled texts. The fit uses at most SAMPLE labelled documents, in the
order of a hash; every document is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.session import spread

SAMPLE = 4_000
LEAST_CHARS = 150
PLENTY, MARGIN = 0.2, 0.3  # share of function words of which nothing else is asked; log units below the labelled texts' lowest spelling
FOLDS, TREES, DEPTH, RATE, BINS, LEAF = 5, 80, 4, 0.1, 32, 8
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
ASCII_TOKEN = re.compile(r"[a-z]+(?:'[a-z]+)?")  # the same in lower-cased ASCII
SEGMENT = re.compile(r"\s(?:(?<=[.!?]\s)\s*|(?<=[\r\n])[\r\n]*|(?<=[a-z] )and (?=[A-Z]))")  # a blank first, which is searched for fast
MARKUP = re.compile(r"<[^<>]{1,200}>|https?://\S+|\S+@\S+")
# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is for that we with by at be it are as from this was have has not will you can on or an if our my so your there their which were been before after should could all any".split(),
    "de": "der die das und nicht wir ist bitte für mit zum den dem ein eine sie ich noch von vor bis auf im am beginnt haben sind daher werden zur".split(),
    "fr": "le la les des est vous pour avec une nous dans du au aux et un de que qui sur pas ce sont merci".split(),
    "es": "el los las que para con una por del se la de en un y no es lo su al más antes favor".split(),
}
SUBORDINATORS = frozenset("although because while since whereas which that if when unless provided thereby whose nor notwithstanding pursuant".split())
LANGUAGE = defaultdict(tuple)
for _number, _list in enumerate(FUNCTION_WORDS.values()):  # English is number 0
    for _w in _list:
        LANGUAGE[_w] += (_number,)
LANGUAGE = dict(LANGUAGE)


def analysed(text: str | None, least: int = LEAST_CHARS) -> tuple[list[list[str]], int, int, int] | None:
    """Words of each segment, numbers of digits, commas and characters, if the text is English prose or notes; else None.

    That is: at least `least` characters, letters rather than figures, and no more words of another language than of English.
    """
    if not text or len(text) < least:
        return None
    plain = MARKUP.sub(" ", text) if "<" in text or "@" in text or "://" in text else text
    found = (ASCII_TOKEN if plain.isascii() else TOKEN).findall
    segments = [w for s in SEGMENT.split(plain) if len(w := found(s.lower())) >= 2]
    letters, digits = sum(map(len, chain.from_iterable(segments))), sum(map(plain.count, "0123456789"))
    if letters + digits < 0.6 * least or digits > 0.3 * letters:
        return None
    seen = [0] * len(FUNCTION_WORDS)
    for languages in filter(None, map(LANGUAGE.get, chain.from_iterable(segments))):
        for k in languages:
            seen[k] += 1
    other = max(seen[1:])
    return (segments, digits, plain.count(","), len(plain)) if other <= seen[0] or other < 3 else None


NAMES = [
    "words", "chars a word", "long 7", "long 10", "long 13", "words a segment", "segment spread", "function words", "subordinators", "commas", "digits",
    "types", "cohesion", "grade", "grade spread", "low grade", "high grade", *[f"band {k}" for k in range(1, 6)], *[f"length {k}" for k in range(4)], "unknown",
]
NAN = float("nan")
EN = frozenset(FUNCTION_WORDS["en"])
SIZES = np.array([6, 12, 22])  # words, where the classes of segments begin


def features(parts: tuple[list[list[str]], int, int, int], grades: dict[str, float]) -> list[float]:
    segments, digits, commas, chars = parts
    many = [len(s) for s in segments]
    sizes = np.array(many, float)
    flat = list(chain.from_iterable(segments))
    m = len(flat)
    lengths = np.fromiter(map(len, flat), float, m)
    g = np.fromiter(map(grades.get, flat, repeat(NAN)), float, m)
    starts = np.array([0, *accumulate(many[:-1])])
    known = g == g
    total = np.add.reduceat(np.where(known, g, 0.0), starts)
    n = np.add.reduceat(known.astype(float), starts)
    weight = np.add.reduceat(lengths, starts) + sizes
    rated = n > 0
    grade = total[rated] / n[rated] if rated.any() else np.array([3.0])
    share = weight[rated] / weight[rated].sum() if rated.any() else np.array([1.0])
    mean = float(grade @ share)
    order = np.argsort(grade)
    cum = np.cumsum(share[order])
    bands = np.bincount(np.minimum(np.maximum(np.rint(grade), 1), 5).astype(int), share, 6)[1:]
    whole = weight.sum()
    bins = np.bincount(SIZES.searchsorted(sizes, "right"), weight, 4) / whole
    sets = list(map(set, segments))
    pairs = [len(a & b) / min(x, y) for a, b, x, y in zip(sets, sets[1:], many, many[1:])]
    apart = sizes - m / len(sizes)
    low, high = cum.searchsorted((0.25, 0.75))
    count = np.count_nonzero
    return [
        np.log1p(m), lengths.sum() / m, count(lengths >= 7) / m, count(lengths >= 10) / m, count(lengths >= 13) / m, float(sizes @ weight / whole), math.sqrt((apart * apart).sum() / len(sizes)),
        sum(map(EN.__contains__, flat)) / m, sum(map(SUBORDINATORS.__contains__, flat)) / m, commas / m, digits / chars,
        len(set().union(*sets)) / m ** 0.8, float(np.array(pairs).sum() / len(pairs)) if pairs else 0.0, mean, math.sqrt(share @ (grade - mean) ** 2),
        float(grade[order[low]]), float(grade[order[min(high, len(cum) - 1)]]), *bands.tolist(), *bins.tolist(), 1 - count(known) / m,
    ]


def word_grades(texts: list[tuple], bands: np.ndarray, least: int = 3) -> dict[str, float]:
    """Mean band of the documents a word occurs in, of the words in at least `least` of them, drawn towards those of its rarest use."""
    total, n = defaultdict(float), Counter()
    for text, band in zip(texts, bands):
        for w in {w for segment in text[0] for w in segment}:
            total[w] += band
            n[w] += 1
    mean = float(np.mean(bands)) if len(bands) else 3.0
    return {w: (total[w] + mean) / (n[w] + 1) for w in n if n[w] >= least}


class Trees:
    """Gradient-boosted regression trees for squared error, on binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        rows, width = x.shape
        self.base, self.trees = float(y.mean()), []
        at = np.full(rows, self.base)
        column = np.arange(width) * BINS
        for _ in range(TREES):
            rest, node = y - at, np.zeros(rows, int)
            split = np.zeros((2**DEPTH - 1, 2), int)
            split[:, 1] = BINS  # no split: all go left
            for level in range(DEPTH):
                first, many = 2**level - 1, 2**level
                slot = ((node - first) * width * BINS)[:, None] + column + binned
                count = np.bincount(slot.ravel(), minlength=many * width * BINS).reshape(many, width, BINS).cumsum(2)
                total = np.bincount(slot.ravel(), np.repeat(rest, width), minlength=many * width * BINS).reshape(many, width, BINS).cumsum(2)
                n, s = count[:, :, -1:], total[:, :, -1:]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((count >= LEAF) & (n - count >= LEAF), total**2 / count + (s - total) ** 2 / (n - count) - s**2 / n, 0)
                best = gain.reshape(many, -1).argmax(1)
                ok = gain.reshape(many, -1)[np.arange(many), best] > 1e-9
                split[first : first + many, 0] = np.where(ok, best // BINS, 0)
                split[first : first + many, 1] = np.where(ok, best % BINS, BINS)
                node = 2 * node + 1 + (binned[np.arange(rows), split[node, 0]] > split[node, 1])
            leaf = node - (2**DEPTH - 1)
            n = np.bincount(leaf, minlength=2**DEPTH)
            value = RATE * np.bincount(leaf, rest, minlength=2**DEPTH) / np.maximum(n, 1)
            self.trees.append((split, value))
            at = at + value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for split, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[rows, split[node, 0]] > split[node, 1])
            out += value[node - (2**DEPTH - 1)]
        return out


def cut_points(predicted: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """The four grades between bands that put most held-out documents in their band."""
    cuts = []
    for k in range(1, 5):
        tries = np.arange(k + 0.2, k + 0.81, 0.02)
        wrong = [((predicted <= t) & (bands > k)).sum() + ((predicted > t) & (bands <= k)).sum() for t in tries]
        cuts.append(float(tries[np.flatnonzero(np.array(wrong) == min(wrong))].mean()))
    return np.array(cuts)


class Letters:
    """How English the spelling of a text is: mean log share of its words' letter trigrams among those of labelled texts."""

    def __init__(self, words: Counter) -> None:
        counts: Counter = Counter()
        for w, n in words.items():
            for g in self._grams(w):
                counts[g] += n
        total = sum(counts.values()) + len(counts) + 1
        self.least = -math.log(total)
        self.shares = {g: math.log((n + 1) / total) for g, n in counts.items()}
        self._known: dict[str, float] = {}

    @staticmethod
    def _grams(word: str) -> list[str]:
        w = f" {word} "
        return [w[i : i + 3] for i in range(len(w) - 2)]

    def _sum(self, word: str) -> float:
        if word not in self._known:
            if len(self._known) > 100_000:
                self._known.clear()
            self._known[word] = sum(self.shares.get(g, self.least) for g in self._grams(word))
        return self._known[word]

    def score(self, parts: tuple) -> float:
        words = [w for segment in parts[0] for w in segment]
        return sum(map(self._sum, words)) / sum(map(len, words)) if words else self.least


def word_counts(texts: list[tuple]) -> Counter:
    counts: Counter = Counter()
    for parts in texts:
        for segment in parts[0]:
            counts.update(segment)
    return counts


@dataclass
class Model:
    grades: dict[str, float]
    trees: Trees
    cuts: np.ndarray
    held_out: list[tuple[str, int, int]]  # source, band, predicted band, by the cut points of all held-out grades
    nested: list[tuple[str, int, int]]  # by those of the other folds: what the accuracy is stated on
    letters: Letters
    spelled: float  # the score from which a text of few English function words is English

    def english(self, parts: tuple) -> bool:
        """Enough English function words, or an English spelling: other languages and scripts have neither."""
        n = sum(map(len, parts[0]))
        return sum(map(EN.__contains__, chain.from_iterable(parts[0]))) >= PLENTY * n or self.letters.score(parts) >= self.spelled

    def bands(self, texts: list[tuple]) -> np.ndarray:
        x = np.array([features(t, self.grades) for t in texts], float).reshape(len(texts), len(NAMES))
        return np.digitize(self.trees.predict(x), self.cuts) + 1


def fitted(texts: list[tuple], bands: np.ndarray, sources: list[str]) -> Model:
    import xxhash

    fold = np.array([xxhash.xxh64_intdigest(s or "") % FOLDS for s in sources])
    x, held = np.zeros((len(texts), len(NAMES))), np.zeros(len(texts))
    for k in range(FOLDS):  # word grades of a document never come from its own fold
        inside, outside = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        grades = word_grades([texts[i] for i in outside], bands[outside])
        for i in inside:
            x[i] = features(texts[i], grades)
    for k in range(FOLDS):
        inside, outside = fold == k, fold != k
        if inside.any():
            held[inside] = Trees().fit(x[outside], bands[outside].astype(float)).predict(x[inside]) if outside.any() else bands.mean()
    cuts = cut_points(held, bands)
    # For the accuracy stated a fold's bands come from cut points of the other folds' held-out grades.
    predicted, nested = np.digitize(held, cuts) + 1, np.zeros(len(texts), int)
    for k in range(FOLDS):
        inside, outside = fold == k, fold != k
        nested[inside] = np.digitize(held[inside], cut_points(held[outside], bands[outside]) if outside.any() else cuts) + 1
    counts = [word_counts([t for t, f in zip(texts, fold) if f == k]) for k in range(FOLDS)]
    every = sum(counts, Counter())
    spelling = [Letters(every - counts[k]) for k in range(FOLDS)]
    scores = [spelling[f].score(t) for t, f in zip(texts, fold)]  # of texts its letters were not counted in
    spelled = float(np.quantile(scores, 0.001)) - MARGIN
    return Model(word_grades(texts, bands), Trees().fit(x, bands.astype(float)), cuts, list(zip(sources, bands.tolist(), predicted.tolist())), list(zip(sources, bands.tolist(), nested.tolist())), Letters(every), spelled)


def trained(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of at most `sample` labelled documents; None without any. Labels outside 1 to 5 and null ones don't count; of several the smallest does."""
    label = labels.filter(F.col("band").between(1, 5) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("band").alias("band"))
    chosen = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select("doc_id", "text", "source").join(F.broadcast(chosen), "doc_id").filter("text is not null").collect()
    rows = [(parts, r["band"], r["source"] or "") for r in sorted(rows, key=lambda r: r["doc_id"]) if (parts := analysed(r["text"]))]
    return fitted([r[0] for r in rows], np.array([r[1] for r in rows]), [r[2] for r in rows]) if len(rows) >= 20 else None


def reading_bands(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, band) of each document of English prose or notes; null, empty, short, foreign and figure texts have none."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [analysed(t) for t in b.column("text").to_pylist()] if shared.value else []
            at = [i for i, p in enumerate(parts) if p and shared.value.english(p)]
            bands = shared.value.bands([parts[i] for i in at]) if at else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(bands.astype(np.int64))], names=["doc_id", "band"])

    return spread(documents.select("doc_id", "text")).mapInArrow(scan, "doc_id long, band long")
