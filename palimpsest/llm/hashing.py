"""Polynomial hashes of byte strings and words, over whole arrays at a time."""

from __future__ import annotations

import numpy as np

#: Two independent bases; names that must not collide use both.
BASES = (0x9E3779B97F4A7C15, 0xA24BAED4963EE407)
_POWERS = {b: [np.ones(1, np.uint64), np.ones(1, np.uint64)] for b in BASES}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """base ** k and base ** -k for k under ``n``, modulo 2 ** 64."""
    kept = _POWERS[base]
    if len(kept[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((base, pow(base, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            kept[k] = np.cumprod(steps, dtype=np.uint64)
    return kept[0], kept[1]


def prefixes(data: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """p[i]: the hash of the first i bytes; any substring's hash follows from two of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), base)[0][: len(data)], out=out[1:])
    return out


def substrings(p: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hashes of the substrings from ``start`` to ``end``; equal strings have equal hashes."""
    h = (p[end] - p[start]) * powers(len(p), base)[1][start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(text: bytes, n: int = 5) -> np.ndarray:
    """The distinct hashes, in order, of a text's ``n``-word shingles, A-Z in lower case; of all words if they are fewer."""
    data = _LOWER[np.frombuffer(text, np.uint8)]
    if not len(data):
        return np.empty(0, np.uint64)
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(word[1:] != word[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    words = substrings(prefixes(data), start, end)
    m = min(n, len(words))
    h = np.zeros(len(words) - m + 1, np.uint64)
    for k in range(m):
        h = h * np.uint64(0x9FB21C651E98DF25) + words[k : len(words) - m + 1 + k]
    return np.unique(mix(h + np.uint64(m)))
