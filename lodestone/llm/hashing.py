"""Hashes of byte ranges of texts laid end to end.

Every step is non-linear in the bytes, so no family of texts (runs of two letters and
their complements, say) has equal hashes by construction. Where a result must be exact
for equal hashes too, words of up to ``SHORT`` bytes are compared by their bytes, which
fit two 64-bit numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np

GOLD = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xD6E8FEB86659FD93)
#: Longest word that ``packed`` can hold.
SHORT = 15
#: Longer ranges are hashed one by one.
LONG = 256
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (zeros follow the end), for len(data) + 8 places."""
    raw = np.concatenate((data, np.zeros(16, dtype=np.uint8))).tobytes()
    return np.ndarray(shape=(len(data) + 8,), dtype=np.uint64, buffer=raw, strides=(1,))


def packed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of at most SHORT bytes as two numbers, the size in the last byte: equal if and only if the words are."""
    eight = eights(data)
    low = eight[starts] & MASKS[np.minimum(sizes, 8)]
    return low, eight[starts + 8] & MASKS[np.clip(sizes - 8, 0, 7)] | sizes.astype(np.uint64) << np.uint64(56)


def digest(raw: bytes) -> int:
    """64 bits of BLAKE2, signed as Spark's bigint."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of the ranges [start, end), eight bytes a step."""
    sizes = ends - starts
    eight, at = eights(data), 0
    h = sizes.astype(np.uint64) * GOLD
    live = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    while len(live):
        part = eight[starts[live] + at] & MASKS[np.minimum(sizes[live] - at, 8)]
        h[live] = mix((h[live] ^ mix(part + GOLD)) * ODD)
        at += 8
        live = live[sizes[live] > at]
    for k in np.flatnonzero(sizes > LONG).tolist():
        h[k] = digest(data[starts[k] : ends[k]].tobytes()) & (2**64 - 1)
    return h


def run_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` units (64-bit values) from each place on; runs beyond the end go on with zeros."""
    n = len(units)
    padded = np.concatenate((units, np.zeros(size, dtype=np.uint64)))
    h = np.zeros(n, dtype=np.uint64)
    for q in range(size):
        h = mix((h ^ padded[q : q + n]) * ODD + GOLD)
    return h
