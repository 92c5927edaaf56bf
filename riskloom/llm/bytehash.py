"""Bucket identifiers of byte strings by doubling, over numpy arrays.

A string of 2k bytes is named by the pair of names of its halves, so that one pass of each width names the strings at every
offset: the name at p is refined by the name at the later offset p + k, and each width reuses the names of the width before.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def _mixed(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


_LETTER = np.array([_mixed(i + 1) for i in range(256)], _U)
_LEFT, _RIGHT, _LAST = (_U(_mixed(i) | 1) for i in (1001, 1002, 1003))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of ordered pairs of names."""
    x = a * _LEFT
    x ^= x >> _U(29)
    x += b
    x *= _RIGHT
    x ^= x >> _U(32)
    x *= _LAST
    x ^= x >> _U(29)
    return x


def names(data: np.ndarray, *widths: int) -> list[np.ndarray]:
    """For each width (rising), the names of the strings of that width at each offset of data (uint8)."""
    out, wide, now = [], 1, _LETTER[data]
    for w in widths:
        while wide * 2 <= w:
            now = pair(now[:-wide], now[wide:]) if len(now) > wide else now[:0]
            wide *= 2
        over = w - wide
        out.append(now if not over else pair(now[:-over], now[over:]) if len(now) > over else now[:0])
    return out


def lowest(order: np.ndarray, window: int) -> np.ndarray:
    """Minimum over each run of window values."""
    wide, now = 1, order
    while wide * 2 <= window:
        now = np.minimum(now[:-wide], now[wide:]) if len(now) > wide else now[:0]
        wide *= 2
    over = window - wide
    return now if not over else np.minimum(now[:-over], now[over:]) if len(now) > over else now[:0]
