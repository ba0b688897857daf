"""Hashed character n-grams of whole texts, vectorised."""

from __future__ import annotations

import numpy as np

_P = np.uint32(0x9E3779B1)
_K = np.uint32(0x85EBCA6B)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def gram_hashes(points: np.ndarray, sizes: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """For each n of ``sizes`` (rising), the hash of every n-gram in its order, in 0 .. 2**bits - 1."""
    out, weight, h = [], np.uint32(1), np.zeros(len(points), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, sizes[-1] + 1):
            weight = weight * _P
            m = max(0, len(points) - n + 1)
            h = h[:m] + points[n - 1 : n - 1 + m] * weight
            if n in sizes:
                x = (h ^ h >> np.uint32(15)) * _K
                out.append((x ^ x >> np.uint32(13)) * _P >> np.uint32(32 - bits))
    return out


class Distinct:
    """Distinct values of arrays below 2**bits in linear time, without clearing a table."""

    def __init__(self, bits: int) -> None:
        self.last = np.zeros(1 << bits, np.int32)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        order = np.arange(len(values), dtype=np.int32)
        self.last[values] = order
        return values[self.last[values] == order]
