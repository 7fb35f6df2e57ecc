"""A small seeded generator (Marsaglia's xorshift with 32 bits) whose draws are the same everywhere."""

from __future__ import annotations

from collections.abc import Callable
from math import cos, log, pi, sqrt

import numpy as np


def _signed(x: int) -> int:
    x &= 0xFFFFFFFF
    return x - (1 << 32) if x >> 31 else x


def generator(seed: int) -> Callable[[], float]:
    """Draws from [0, 1); a seed of 0 counts as 1. The right shift keeps the sign, as the definition has it."""
    state = _signed(int(seed)) or 1

    def draw() -> float:
        nonlocal state
        state = _signed(state ^ (state << 13))
        state = _signed(state ^ (state >> 17))
        state = _signed(state ^ (state << 5))
        return (state & 0xFFFFFFFF) / 2**32

    return draw


def permutation(n: int, seed: int) -> list[int]:
    """Fisher-Yates from the end."""
    draw, out = generator(seed), list(range(n))
    for i in range(n - 1, 0, -1):
        j = int(draw() * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def gaussian(draw: Callable[[], float]) -> float:
    """A standard normal draw by Box and Muller, cosine branch."""
    u = 0.0
    while u == 0.0:
        u = draw()
    return sqrt(-2 * log(u)) * cos(2 * pi * draw())


def projection_matrix(source: int, target: int, seed: int = 42) -> np.ndarray:
    """target x source Gaussian entries over sqrt(target), drawn by rows, in single precision."""
    draw = generator(seed)
    return (np.array([[gaussian(draw) for _ in range(source)] for _ in range(target)]) / sqrt(target)).astype(np.float32)
