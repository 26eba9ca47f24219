"""Words and word runs of texts as 64-bit hashes, for whole batches at a time."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
CACHE_WORDS = 500_000  # the cache of word hashes is emptied beyond this, so its memory is bounded

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """Word to 64-bit hash, kept for the words seen."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


HASHES = WordHashes()


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits of the lower-cased text; none of a null text."""
    return WORD.findall(text.lower()) if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: Sequence[str | None], least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of the texts behind one another, and each text's number of words (0 where under `least`)."""
    get, flat, counts = HASHES.__getitem__, [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text and len(found := WORD.findall(text.lower())) >= least:
            counts[i] = len(found)
            flat.extend(map(get, found))
    return np.array(flat, np.uint64), counts


def runs(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n successive words, not crossing texts, and each text's number of them."""
    sizes = np.maximum(counts - (n - 1), 0)
    if not sizes.sum():
        return np.zeros(0, np.uint64), sizes
    h = mixed(hashes + _M1)
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = mixed(out * _M1 + h[k : len(h) - n + 1 + k])
    ends = np.cumsum(counts)
    inside = np.ones(len(h), bool)
    for k in range(1, n):
        inside[np.maximum(ends[counts > 0] - k, 0)] = False
    short = (counts > 0) & (counts < n)
    if short.any():
        starts = ends - counts
        for s, e in zip(starts[short], ends[short]):
            inside[s:e] = False
    return out[inside[: len(out)]], sizes


def distinct_runs(text: str | None, n: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the runs of n successive words of one text."""
    return np.unique(runs(*word_hashes([text]), n)[0])
