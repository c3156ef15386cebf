"""Numpy kernels over byte strings for the repeated-window search."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
_HALF = np.uint64(32)
_PLACE = np.uint64((1 << 20) - 1)
#: Windows that are looked at together; their places need 20 bits.
BLOCK = (1 << 20) - (1 << 12)
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 1) for b in range(256)], np.uint64)


def digits(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit digest of the so many bytes from each place; size is a power of two."""
    h, k = _BYTES[data], 1
    while k < size:
        h = h[:-k] * _MIX + h[k:]
        h ^= h >> _HALF
        h *= _ODD
        k *= 2
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the so many values from each place."""
    k = 1
    while 2 * k <= width:
        values = np.minimum(values[:-k], values[k:])
        k *= 2
    return np.minimum(values[: len(values) - width + k], values[width - k :]) if k < width else values


def anchors(data: bytes, depth: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, place of the anchor, digest of its gram) of each run of windows.

    A window of ``depth`` bytes is dealt out by the least of its grams, the
    leftmost of equal ones. That hangs on the window's bytes alone, so equal
    windows have equal anchors at equal distances. Windows in a row with the
    same anchor form a run.
    """
    parts = []
    for at in range(0, len(data) - depth + 1, BLOCK):
        part = np.frombuffer(data, np.uint8, min(len(data) - at, BLOCK + depth - 1), at)
        h = digits(part, gram)
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        place = (_least(key, depth - gram + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        parts.append((first + at, last + at, place[first] + at, h[place[first]].view(np.int64)))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
