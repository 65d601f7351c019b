"""Word splitting and vectorised 64-bit hashing shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = 0x9E3779B97F4A7C15


def slices(batches: Iterable[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what a worker holds for one does not depend on the session's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def spaced_words(text: Column) -> Column:
    """The words of ``text`` (longest runs of letters and digits, lower-cased), one space between them; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def word_count(spaced: Column) -> Column:
    """Number of words in the output of :func:`spaced_words`."""
    return F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash; kept between batches of a task and emptied when it grows large, which changes no result."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def flatten(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of every spaced text, number of words of each text)."""
    words = [t.split(" ") if t else [] for t in texts]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return hashes.array([w for ws in words for w in ws]), sizes


def shingle_hashes(flat: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``n`` words within a text, index of its text)."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    if len(flat) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    end = len(flat) - n + 1
    h = np.zeros(end, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = mix(h * np.uint64(GOLDEN) + flat[k : k + end])
    inside = doc[:end] == doc[n - 1 :]
    return h[inside], doc[:end][inside]
