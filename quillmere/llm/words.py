"""Vectorised word kernels over UTF-8 bytes.

Both word definitions used here are unions of byte classes: every byte of a
character outside ASCII is a word byte, so the work on bytes is exact.
Words are hashed to 64 bits by a polynomial over random byte values, modulo
2**64, finished with an avalanche step; equality of texts is judged on these
hashes only for set similarity, never where the contract asks for an exact place.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
#: Base of a second hash, for those who need 128 bits.
SECOND = 0xD6E8FEB86659FD93
_SEGMENT = 1 << 18
_POWERS: dict[int, list[np.ndarray]] = {}

SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, _SEGMENT + 4096)
        _POWERS[base] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (base, pow(base, -1, 2**64))]
    return _POWERS[base][0], _POWERS[base][1]


def spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each text the index of its first word (n+1 values)."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = word[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    starts = edge[:-1] & inside
    ends = edge[1:] & inside
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    starts[offsets[full]] = inside[offsets[full]]
    ends[offsets[full + 1] - 1] = inside[offsets[full + 1] - 1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit hash of each word; ``data`` is already lower-cased."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SEGMENT, "right")))
        lo, hi = starts[i], ends[j - 1]
        up, down = _powers(int(hi - lo) + 1, base)
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        np.cumsum(_VALUE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def shingles(word_hashes: np.ndarray, first: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles.

    A text of fewer words is one shingle, the whole sequence; one without words has none.
    """
    n = len(word_hashes)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    if n >= width:
        rolled = word_hashes[: n - width + 1] * factors[0]
        for k in range(1, width):
            rolled = rolled + word_hashes[k : n - width + 1 + k] * factors[k]
        rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix((word_hashes[a:b] * factors[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
