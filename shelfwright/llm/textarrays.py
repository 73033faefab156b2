"""Numpy helpers over Arrow batches of texts: flat bytes, words, and hashes of byte or word ranges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
PIECE_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C15


def slices(batch: pa.RecordBatch, column: str, size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``size`` bytes of text, each with its bytes (uint8) and row offsets (int64). Null is empty."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield batch.slice(i, j - i), flat[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def is_space(flat: np.ndarray) -> np.ndarray:
    return (flat == 32) | ((flat >= 9) & (flat <= 13))


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true bytes; runs end with their row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    cuts = off[(off > 0) & (off < len(inside))]
    head[cuts] = inside[cuts]
    tail[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def row_of(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(off, at, "right") - 1


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2 ** 64, 256, dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers of the base, or of its inverse, modulo 2^64."""
    size = 1 << max(12, int(n).bit_length())
    return _powers(size, pow(BASE, -1, 2 ** 64) if inverse else BASE)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(flat: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(byte_values()[flat] * powers(len(flat)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal ranges have equal hashes."""
    return mix((prefix[stop] - prefix[start]) * powers(len(prefix), True)[start] + (stop - start).astype(np.uint64))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` neighbours of ``h``; shorter by n - 1."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = (out * np.uint64(BASE) + h[k:len(h) - n + 1 + k])
    return mix(out)


def lower(flat: np.ndarray) -> np.ndarray:
    """A-Z only."""
    return np.where((flat >= 65) & (flat <= 90), flat | 32, flat)
