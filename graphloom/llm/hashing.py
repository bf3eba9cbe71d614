"""Polynomial hashes of byte strings in numpy, modulo 2**64."""

from __future__ import annotations

import numpy as np

#: Fixed value: an odd multiplier, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash over all 64 bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``P[i]``: the sum of ``(data[j] + 1) * BASE**j`` for ``j < i``."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hashes of ``data[start:end]``, not mixed."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def window_hashes(prefix: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of all windows of ``k``."""
    n = len(prefix) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = powers(len(prefix))
    return mix((prefix[k:] - prefix[:n]) * down[:n])
