"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the hashes (fixed values of common mixers).
_P = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    # hashing a word costs less than finding it among those seen before
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of all words as one run if they are fewer."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    x = np.full(n, np.uint64(min(len(w), width)))
    for i in range(min(width, len(w))):
        x = (x ^ w[i : i + n]) * _P
        x ^= x >> np.uint64(29)
    x = mix(x)
    x.sort()
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]
