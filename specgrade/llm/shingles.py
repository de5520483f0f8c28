"""Word hashes and shingle sets of texts, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 300_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hashes of words; remembers a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str) -> np.ndarray:
        """Hashes of the words of a text: A-Z in lower case, split at ASCII white space."""
        if len(self) > CACHE_WORDS:
            self.clear()
        words = text.encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def spread_bits(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves all bits even."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """Hashes of sequences whose members are given column by column."""
    out = spread_bits(parts[0] + _ODD)
    for p in parts[1:]:
        out = spread_bits(out * _ODD + p)
    return out


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; a shorter text is one shingle, none without words."""
    n = len(words)
    if n == 0:
        return words
    if n <= size:
        return chain([words[i : i + 1] for i in range(n)])
    return np.unique(chain([words[i : n - size + 1 + i] for i in range(size)]))
