"""Words and word windows over the byte buffer of many texts at once, in numpy.

Words are runs of word bytes. Polynomial hashes modulo 2**64 over random byte
values give the hash of any word, or of any run of words, from prefix sums.
"""

from __future__ import annotations

import numpy as np

#: A-Z become a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_WORD_BASE = 0xD6E8FEB86659FD93


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, base % 2**64
    while have < n:
        take = min(have, n - have)
        out[have:have + take] = out[:take] * np.uint64(step)
        step = step * step % 2**64
        have += take
    return out[:n]


class Powers:
    """Powers of a base and of its inverse, kept and grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(self.base, n), powers(self.inverse, n)
        return self.up[:n], self.down[:n]


class Hasher:
    """Hashes of words and of runs of words."""

    def __init__(self):
        self.bytes, self.words = Powers(_BASE), Powers(_WORD_BASE)

    def of_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self.bytes.get(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * up[:-1], out=sums[1:])
        return (sums[ends] - sums[starts]) * down[starts]

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        up, _ = self.words.get(len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum((hashes | np.uint64(1)) * up[:-1], out=sums[1:])
        return sums

    def of_runs(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """Hash of every run of ``size`` words."""
        n = len(prefix) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        _, down = self.words.get(len(prefix))
        return (prefix[size:] - prefix[:n]) * down[:n]


def find_words(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word of each text (one more at the end).

    ``data`` holds the texts back to back, text i at ``at[i]:at[i+1]``; no word
    crosses from one text to the next.
    """
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < at[1:]]
    first[edges] |= inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges[1:] - 1] |= inside[edges[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)
