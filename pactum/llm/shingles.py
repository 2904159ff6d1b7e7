"""Word shingles of whole texts as sorted 64-bit hashes.

Words are the maximal runs outside ``[\\x20\\x09-\\x0D]`` after A-Z are lower-cased (what
``bytes.lower().split()`` does); other code points, other Unicode white space included, are
part of words.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit integers; works on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text has its whole word sequence as one.

    Null, empty and blank texts have none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = mix64(out * _GOLDEN + hashes[i : i + n])
    return np.unique(out)
