"""Words and Rabin-Karp window hashes of many texts at once, in numpy.

All arithmetic is modulo 2^64 with odd bases, so that a base's powers have inverses: a stretch's polynomial is a difference
of prefix sums times an inverse power, which is the rolling hash of every window in a few passes.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_POWERS: dict[int, np.ndarray] = {}
BYTE_BASE, WORD_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), kept and grown as needed."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, U)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have, dtype=U)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h + U(0x9E3779B97F4A7C15 * (seed + 1) & (1 << 64) - 1)
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def stretches(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial of the values in each stretch, the same wherever it stands."""
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values)), out=sums[1:], dtype=U)
    return (sums[ends] - sums[starts]) * powers(inverse(base), len(values) + 1)[starts]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, one after the other, and where each text's words begin (and the last end)."""
    buffer = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    space = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    bounds = np.searchsorted(starts, np.concatenate([[1], 1 + np.cumsum(sizes)]))
    if not len(starts):
        return np.zeros(0, U), bounds
    return mix(stretches(buffer.astype(U), starts, ends, BYTE_BASE) + (ends - starts).astype(U)), bounds


def windows(tokens: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of so many words start, text by text, and where each text's windows begin among them (and the last end)."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    return np.arange(at[-1]) + np.repeat(bounds[:-1] - at[:-1], counts), at
