"""Hashes of many short sequences at once, in arrays."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def place_in(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each of the groups of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def polynomial(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each group of values, by place in the group."""
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(sizes.max()) - 1, _BASE)], dtype=np.uint64)
    h = np.add.reduceat((values + np.uint64(1)) * powers[place_in(sizes)], np.cumsum(sizes) - sizes) + sizes.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))
