"""Hashes of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


class Known(dict):
    """Hash of a word, kept while there are not too many."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"))
        return out


_KNOWN = Known(100_000)


def hashes(words: list, size: int, known: Known = _KNOWN) -> np.ndarray:
    """A hash of each run of ``size`` words, in order; fewer words are one run, and of no words there is none."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out ^= out >> np.uint64(29)
        out = (out + h[k : k + n]) * _STEPS[k % len(_STEPS)]
    return out ^ (out >> np.uint64(32))
