"""Words and shingles: unbroken runs of letters and digits, lower-cased, and runs of ``K`` consecutive words."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

K = 5
WORD = re.compile(r"[^\W_]+")
_CACHE: dict[str, int] = {}
_CACHE_ENTRIES = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def words_column(text: Column) -> Column:
    """The words of a text as an array, by Spark's own functions; null stays null."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def word_hashes(ws: list[str]) -> np.ndarray:
    if len(_CACHE) > _CACHE_ENTRIES:
        _CACHE.clear()
    try:
        return np.array([_CACHE[w] for w in ws], dtype=np.uint64)
    except KeyError:
        for w in ws:
            if w not in _CACHE:
                _CACHE[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.array([_CACHE[w] for w in ws], dtype=np.uint64)


def shingle_hashes(ws: list[str], k: int = K) -> np.ndarray:
    """A 64-bit hash for each run of ``k`` words, in text order; empty for shorter texts."""
    n = len(ws) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = word_hashes(ws)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * _MUL + h[i : i + n]
    return mix(out)


def shingle_set(ws: list[str], k: int = K) -> set[tuple[str, ...]]:
    """The distinct runs of ``k`` words themselves, for exact checks."""
    return set(zip(*(ws[i:] for i in range(k))))


def likeness(a: list[str], b: list[str], k: int = K) -> float:
    """Distinct runs found in both over those found in either; 0 if neither has any."""
    x, y = shingle_set(a, k), shingle_set(b, k)
    both = len(x & y)
    either = len(x) + len(y) - both
    return both / either if either else 0.0


def text_digest(ws: list[str]) -> str:
    return xxhash.xxh3_128_hexdigest(" ".join(ws).encode("utf-8", "surrogatepass"))
