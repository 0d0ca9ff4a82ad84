"""Vectorised 64-bit hashes of spans of bytes: a polynomial over random byte codes, modulo 2^64, then mixed.

Hashes only find candidates here: whatever decides a result compares the bytes too.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
CHUNK = 1 << 17  # bytes hashed at once, however long a text is
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int) -> np.ndarray:
    """base**0 .. base**CHUNK."""
    out = np.full(CHUNK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


UP, DOWN = _powers(BASE), _powers(pow(BASE, -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _prefixes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each x of `at`, ascending: the polynomial of data[:x], and BASE**-x."""
    sums, inverse = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
    before, up, down, k = 0, 1, 1, 0
    for low in range(0, len(data) + 1, CHUNK):
        part = data[low : low + CHUNK]
        own = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_CODE[part] * UP[: len(part)], out=own[1:])
        j = int(at.searchsorted(low + CHUNK))
        place = at[k:j] - low
        sums[k:j] = own[place] * np.uint64(up) + np.uint64(before)
        inverse[k:j] = DOWN[place] * np.uint64(down)
        before, up, down, k = (before + up * int(own[-1])) % 2**64, up * int(UP[-1]) % 2**64, down * int(DOWN[-1]) % 2**64, j
    return sums, inverse


def span_hashes(raw: bytes | np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of raw[start:end] for each span; starts and ends ascend."""
    data = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
    (low, inverse), (high, _) = _prefixes(data, starts), _prefixes(data, ends)
    return mix((high - low) * inverse + (ends - starts).astype(np.uint64))


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in UTF-8 bytes."""
    edge = np.zeros(len(raw) + 2, np.int8)
    edge[1:-1] = ~WHITE[np.frombuffer(raw, np.uint8)]
    turn = np.diff(edge)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
