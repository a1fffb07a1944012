"""Vectorised 64-bit hashes of runs of ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer (splitmix) of each number."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(ids: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of each run of k consecutive ids; position i is the run that starts at i (len(ids) - k + 1 of them).

    A polynomial in an odd base modulo 2^64 over mixed ids, taken as differences of one cumulative sum.
    """
    n = len(ids)
    if n < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.full(n, BASE, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(ids, seed) * powers, out=sums[1:])
        back = np.full(n - k + 1, INVERSE, np.uint64)
        back[0] = 1
        np.cumprod(back, out=back)
        return mix((sums[k:] - sums[:-k]) * back, seed + 1)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; a null list is empty, a null id is the smallest INT and equals other null ids."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    values = column.flatten()
    if values.null_count:
        values = values.fill_null(-(1 << 31))
    return values.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
