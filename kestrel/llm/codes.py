"""Compact messages between blocks of documents and shards of a statistic.

Where a statistic has far more rows than a row's worth is (counters, windows,
word pairs), tasks exchange arrays of numbers as bytes: one row for a block
and a shard, ascending values as differences of a few bits.
"""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers, seven bits a byte, low first."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        more = (size[own] > k + 1).astype(np.uint8) << 7
        out[at[own] + k] = (values[own] >> np.uint64(7 * k) & np.uint64(0x7F)).astype(np.uint8) | more
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(raw < 128)
    start = np.append(0, end[:-1] + 1)[: len(end)]
    out = np.zeros(len(end), np.uint64)
    for k in range(int((end - start).max(initial=-1)) + 1):
        own = np.flatnonzero(end - start >= k)
        out[own] |= (raw[start[own] + k] & np.uint8(0x7F)).astype(np.uint64) << np.uint64(7 * k)
    return out


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, from zero."""
    return np.diff(values, prepend=np.uint64(0))


def zigzag(x: np.ndarray) -> np.ndarray:
    return (x << 1 ^ x >> 63).view(np.uint64)


def unzigzag(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)


def shard_of(values: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Shards are equal ranges of values of so many bits (the top 32 decide)."""
    top = values >> np.uint64(bits - 32) if bits > 32 else values << np.uint64(32 - bits)
    return (top * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
