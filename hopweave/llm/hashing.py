"""Vectorised hashing of word sequences, for code that runs in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def byte_list(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` values, in order; by doubling, so in log(width) passes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers, out, done, at = words, None, 0, 1
    while True:
        if width & at:
            part = powers[done : done + n]
            out = part.copy() if out is None else mix(out * MULTIPLIER + part)
            done += at
        at *= 2
        if at > width:
            return mix(out ^ np.uint64(width))
        half = at // 2
        powers = mix(powers[:-half] * MULTIPLIER + powers[half:] + np.uint64(at))
