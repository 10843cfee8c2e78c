"""Words of a text and hashes of its word shingles, as numpy arrays."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Entries after which a task's table of word hashes starts anew; it bounds memory.
MOST_WORDS = 500_000
_WORD = re.compile(r"\w+").findall
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return _WORD((text or "").lower())


class WordHashes(dict):
    """64-bit hashes of words, each computed once."""

    def __missing__(self, word):
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        found = words_of(text)
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; a shorter text is one shingle, no word none."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    k = min(k, n)
    out = word_hashes[: n - k + 1].copy()
    for i in range(1, k):
        out = mixed(out + _MIX[0]) + word_hashes[i : n - k + 1 + i]
    return mixed(out + np.uint64(k))
