"""Vectorised word hashing of whole texts for task functions.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased; UTF-8 never holds
these bytes inside a character. A word's hash is a polynomial over random byte values modulo 2^64, mixed
with its length, so it does not depend on where the word stands.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20  # bytes handled at once; chunks end between words
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Tables of one task."""

    def __init__(self):
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.is_space = np.zeros(256, dtype=bool)
        self.is_space[[32, *range(9, 14)]] = True
        self.value = mix(np.arange(1, 257, dtype=np.uint64))
        self.value[self.is_space] = 0
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            step, back = pow(BASE, m, 1 << 64), pow(pow(BASE, -1, 1 << 64), m, 1 << 64)
            self.up, self.down = (np.concatenate([p, p * np.uint64(s)]) for p, s in ((self.up, step), (self.down, back)))

    def split(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words in lower-cased bytes."""
        solid = np.zeros(len(data) + 2, dtype=np.int8)
        solid[1:-1] = ~self.is_space[data]
        edge = np.diff(solid)
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def bytes_of(self, text: str | None) -> np.ndarray:
        return self.lower[np.frombuffer((text or "").encode(), dtype=np.uint8)]

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """Hash of every word, in order."""
        out, at = [], 0
        while at < len(data):
            end = min(len(data), at + CHUNK)
            while end < len(data) and not self.is_space[data[end]]:  # to the end of the word
                stop = np.flatnonzero(self.is_space[data[end:end + CHUNK]])
                end = end + int(stop[0]) if len(stop) else min(len(data), end + CHUNK)
            part = data[at:end]
            self._powers(len(part) + 1)
            starts, ends = self.split(part)
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(self.value[part] * self.up[:len(part)], out=total[1:])
            out.append(mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)))
            at = end
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Distinct hashes, sorted, of all runs of ``size`` words; fewer words make one shingle, none makes none."""
    if not len(words):
        return words
    if len(words) < size:
        words, size = words, len(words)
    n = len(words) - size + 1
    got = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        got = got * np.uint64(BASE) + words[k:k + n]
    got = mix(got)
    got.sort()
    return got[np.concatenate([[True], got[1:] != got[:-1]])]
