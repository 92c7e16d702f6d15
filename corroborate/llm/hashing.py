"""Word and shingle hashes for Python tasks: 64-bit, the same in every process."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_29, _32 = np.uint64(29), np.uint64(32)


class WordHashes(dict):
    """Word -> 64-bit hash, kept for repeated words; emptied at ``most`` entries to bound memory."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = (x ^ (x >> _29)) * _A
    x = (x ^ (x >> _32)) * _B
    return x ^ (x >> _29)


def chain(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the ordered pair (a, b)."""
    return mix(a * _A + (b ^ np.uint64(salt)) * _C)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows; with fewer words, of the whole sequence; without any, none."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = chain(out, h[k : len(h) - n + 1 + k], k)
    return mix(out ^ np.uint64(n))
