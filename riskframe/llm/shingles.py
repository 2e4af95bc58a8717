"""Word shingles as 64-bit hashes, in numpy, one text at a time."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes of word hashes that a task keeps before it starts afresh, some hundred per entry besides the word.
WORD_CACHE, PER_WORD = 24 << 20, 160


class WordHashes(dict):
    """Word (bytes) to 64-bit hash; forgets everything beyond a size."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + PER_WORD
        if self.held > WORD_CACHE:
            self.clear()
            self.held = len(word) + PER_WORD
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's ``size``-word shingles.

    A-Z are lower-cased; words are runs without ASCII white space. A text with
    fewer words has its whole sequence as one shingle; without words it has none.
    """
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    width = min(size, len(codes))
    hashes = np.full(len(codes) - width + 1, width, np.uint64)
    for i in range(width):
        hashes = mix(hashes + codes[i : len(codes) - width + 1 + i])
    return np.unique(hashes)
