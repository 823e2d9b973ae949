"""Words and 5-word shingles of whole texts as 64-bit hashes, one numpy pass a text."""

from __future__ import annotations

import numpy as np
import xxhash

MASK = (1 << 64) - 1
#: Odd multipliers, one for each place in a shingle.
PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * i + 3) ^ 0xD1B54A32D192ED03) & MASK | 1 for i in range(32)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word -> 64-bit hash, each distinct word hashed once; emptied when it grows past ``limit``."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ``[\\x20\\x09-\\x0D]+``; bytes.split() and bytes.lower() do just that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, memo: Words, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; with fewer words, of the whole sequence."""
    h = memo.hashes(words_of(text))
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += mix(h[i : i + n] ^ PLACES[i])* PLACES[i + 1]
    return np.unique(mix(total))
