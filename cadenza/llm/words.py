"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

The separators of every word class here are ASCII, so a class over code points is the same class
over bytes. A word's 64-bit value is a polynomial over its bytes modulo 2**64, with a random value
for each byte, passed through an invertible mixer; windows of words are polynomials over the mixed
values. Equal sequences always get equal values; n different ones collide with a chance of about
n**2 / 2**65.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1


def _stream(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit values from a counter-based generator."""
    out = []
    for _ in range(n):
        seed = (seed + 0x9E3779B97F4A7C15) & _MASK
        z = seed
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, np.uint64)


_BYTES = _stream(11, 256)
_BASES = [int(x) for x in _stream(12, 4)]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16) * 5 // 4, base, np.uint64)
        full[0] = 1
        have = _powers[base] = np.multiply.accumulate(full)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _table(separators: bytes, fold: bool) -> np.ndarray:
    table = _BYTES.copy()
    if fold:
        table[65:91] = table[97:123]
    table[list(separators)] = 0
    return table


class WordClass:
    """Maximal runs of bytes outside ``separators``; with ``fold``, A-Z count as a-z."""

    def __init__(self, separators: bytes, fold: bool):
        self.separators, self.fold = separators, fold
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False
        self.table = _table(separators, fold)

    def spans(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the words begin and end in ``data``, and where each row's words begin among them."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        inside = self.inside[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = ~inside[:-1]
        edge[at] = True  # a word ends where its row ends
        starts = np.flatnonzero(edge[:-1] & inside)
        outside = np.empty(len(data) + 1, bool)
        outside[:-1] = ~inside
        outside[-1] = True
        outside[at] = True
        ends = np.flatnonzero(outside[1:] & inside) + 1
        return starts, ends, np.searchsorted(starts, at)

    def values(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The words' 64-bit values. Separators count nothing, so a word may reach to the next one's start."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        base = _BASES[0]
        v = self.table[data]
        v *= powers(base, len(data))
        return mix(np.add.reduceat(v, starts) * powers(pow(base, -1, 1 << 64), len(data))[starts])


    def beginnings(self, data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """The 64-bit values of the words' first n bytes; of shorter words, of what there is and no use."""
        out = np.full(len(starts), n, np.uint64)
        for i in range(n):
            out = out * np.uint64(_BASES[1]) + self.table[data[np.minimum(starts + i, len(data) - 1)]]
        return mix(out)


def windows(values: np.ndarray, size: int, which: int = 1) -> np.ndarray:
    """The 64-bit value of each run of ``size`` words (rows aren't told apart); ``which`` picks the function."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    base = _BASES[which]
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    n = len(values) - size + 1
    return mix((sums[size:] - sums[:n]) * powers(pow(base, -1, 1 << 64), n))


def fingerprint(values: np.ndarray, which: int) -> int:
    """A 64-bit value of a whole sequence."""
    total = (values * powers(_BASES[which], len(values))).sum(dtype=np.uint64) if len(values) else np.uint64(0)
    return int(mix(np.array([total + np.uint64(len(values) * 0x9E3779B97F4A7C15 & _MASK)], np.uint64))[0])


SPACED = WordClass(b"\x20\x09\x0a\x0b\x0c\x0d", fold=False)
SPACED_FOLDED = WordClass(b"\x20\x09\x0a\x0b\x0c\x0d", fold=True)
ALNUM_FOLDED = WordClass(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), fold=True)
