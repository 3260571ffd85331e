"""Word shingles of whole batches of texts as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

#: Words of a shingle.
WORDS = 5


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word of the text: lower case, split at white space."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of each value for each seed."""
    x = (x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Batch:
    """Texts laid one after another. words, and starts of each text in them; shingles likewise.

    A shingle is `size` words. A text of fewer words than a shingle has one shingle of all its words, unless it has no word.
    """

    def __init__(self, texts: list[str | None], size: int = WORDS):
        self.size = size
        self._lay([word_hashes(t) if t else np.zeros(0, np.uint64) for t in texts])

    @classmethod
    def of_words(cls, each: list[np.ndarray]) -> "Batch":
        batch = cls.__new__(cls)
        batch.size = WORDS
        batch._lay(each)
        return batch

    def _lay(self, each: list[np.ndarray]) -> None:
        self.sizes = np.array([len(w) for w in each], np.int64)
        self.words = np.concatenate(each) if each else np.zeros(0, np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.counts = np.maximum(np.minimum(self.sizes, 1), self.sizes - self.size + 1)
        self.first = np.cumsum(self.counts) - self.counts
        self.text_of = np.repeat(np.arange(len(each)), self.counts)
        at = np.arange(len(self.text_of)) - self.first[self.text_of]
        begin, size = self.starts[self.text_of] + at, self.sizes[self.text_of]
        h = np.zeros(len(begin), np.uint64)
        for k in range(self.size):
            inside = at + k < size
            w = self.words[np.minimum(begin + k, max(0, len(self.words) - 1))] if len(self.words) else h
            h = np.where(inside, (h ^ w) * np.uint64(0x9E3779B97F4A7C15), h)
            h ^= h >> np.uint64(29)
        self.shingles, self.at = h, at

    def occurrences(self) -> np.ndarray:
        """Which occurrence of the same shingle in its text each shingle is, from 0."""
        order = np.lexsort((self.at, self.shingles, self.text_of))
        s, t = self.shingles[order], self.text_of[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        run = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        out = np.empty(len(s), np.int64)
        out[order] = run
        return out
