"""Hashes of byte strings and of their pieces, in numpy, the same on every node."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: The base of the second half of 128-bit digests.
SECOND = np.uint64(0xD6E8FEB86659FD93)


class Powers:
    """Powers of a base and of its inverse modulo 2**64, as far as needed so far."""

    def __init__(self, base: np.uint64 = BASE) -> None:
        self.base, self.back = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.base)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.back)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


POWERS, POWERS_TWO = Powers(), Powers(SECOND)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit matters to every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(raw: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Sums of (byte + 1) * base**place before each place; n + 1 of them."""
    out = np.zeros(len(raw) + 1, np.uint64)
    up, _ = powers.of(len(raw) + 1)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def windows(raw: np.ndarray, q: int, powers: Powers = POWERS) -> np.ndarray:
    """Mixed hash of each of the n - q + 1 strings of q bytes."""
    if len(raw) < q:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(raw, powers)
    _, down = powers.of(len(raw) + 1)
    return mix((sums[q:] - sums[:-q]) * down[: len(raw) - q + 1])


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(raw: np.ndarray) -> np.ndarray:
    start, end = word_spans(raw)
    if not len(start):
        return np.zeros(0, np.uint64)
    sums = prefix_sums(raw)
    _, down = POWERS.of(len(raw) + 1)
    return mix((sums[end] - sums[start]) * down[start])


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles, A-Z in lower case; with fewer words, of the whole sequence."""
    words = word_hashes(np.frombuffer((text or "").encode().lower(), np.uint8))
    if not len(words):
        return words
    width = min(k, len(words))
    n = len(words) - width + 1
    h = np.full(n, np.uint64(width))
    for i in range(width):
        h = mix(h * np.uint64(31) + words[i : i + n])
    return np.unique(h)
