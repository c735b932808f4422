"""Hilbert keys of integer points, for a whole batch at once."""

from __future__ import annotations

import numpy as np


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``points`` (n x dims, values below 2**bits).

    dims * bits may be at most 62. The Gray-code form: undo the excess work from the highest bit down, then
    Gray-encode across dimensions and interleave the bits.
    """
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    if dims * bits > 62:
        raise ValueError("dims * bits must be at most 62")
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        high = one << np.uint64(level)
        low = high - one
        for d in range(dims):
            hit = (x[d] & high) != 0
            swap = np.where(hit, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        high = one << np.uint64(level)
        turn = np.where((x[dims - 1] & high) != 0, turn ^ (high - one), turn)
    key = np.zeros_like(x[0])
    x ^= turn
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << one) | ((x[d] >> np.uint64(level)) & one)
    return key.astype(np.int64)
