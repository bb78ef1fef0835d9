"""Reproducible pseudo-random integers from row numbers, the same on any engine.

The steps use 32-bit values in 64-bit integers with a 27-bit multiplier, so nothing
overflows under ANSI arithmetic.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The multiplier of the 32-bit mixer and the golden-ratio increment.
MULTIPLIER = 0x45D9F3B
INCREMENT = 0x9E3779B9
MASK = 0xFFFFFFFF


def mix_int(x: int) -> int:
    """The mixer on a plain integer."""
    for _ in range(2):
        x = (((x >> 16) ^ x) * MULTIPLIER) & MASK
    return (x >> 16) ^ x


def _fold(x: Column) -> Column:
    return F.shiftright(x, 16).bitwiseXOR(x)


def mix(x: Column) -> Column:
    """The mixer on a column.

    Each step uses its input twice; a fold over two rounds binds it once, where plain
    nesting would double the expression with every step.
    """
    rounds = F.array(F.lit(1), F.lit(2))
    return F.aggregate(
        rounds, x, lambda v, _: (_fold(v) * F.lit(MULTIPLIER)).bitwiseAND(F.lit(MASK)), _fold
    )


def draw63(seed: int, rep: str, index: str) -> Column:
    """A 63-bit number per (seed, rep, index); ``index`` is a bigint column."""
    mask = F.lit(MASK)
    i = F.col(index)
    a = mix(F.col(rep).cast("bigint").bitwiseXOR(F.lit(mix_int(seed))))
    b = mix(i.bitwiseAND(mask).bitwiseXOR(a))
    c = mix((i.bitwiseAND(mask) + a + F.lit(INCREMENT)).bitwiseAND(mask))
    c = mix(F.shiftright(i, 32).bitwiseXOR(c))
    return b.bitwiseAND(F.lit(0x7FFFFFFF)) * F.lit(2**32) + c


def _mix_array(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (((x >> np.uint64(16)) ^ x) * np.uint64(MULTIPLIER)) & np.uint64(MASK)
    return (x >> np.uint64(16)) ^ x


def draw63_array(seed: int, rep: np.ndarray | int, index: np.ndarray) -> np.ndarray:
    """``draw63`` on arrays of whole numbers."""
    i, mask = np.asarray(index, np.uint64), np.uint64(MASK)
    a = _mix_array(np.asarray(rep, np.uint64) ^ np.uint64(mix_int(seed)))
    b = _mix_array((i & mask) ^ a)
    c = _mix_array(((i & mask) + a + np.uint64(INCREMENT)) & mask)
    c = _mix_array((i >> np.uint64(32)) ^ c)
    return ((b & np.uint64(0x7FFFFFFF)) << np.uint64(32)) | c


def stream63_array(seed: int, rep: np.ndarray | int, name: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Number ``k`` (below 2**32) of the stream of (seed, rep, name): the stream's own 63-bit number
    takes the place of ``rep`` and of the index's upper half, so that streams share nothing."""
    key = draw63_array(seed, rep, name)
    return draw63_array(seed, key & np.uint64(MASK), ((key >> np.uint64(32)) << np.uint64(32)) | np.asarray(k, np.uint64))
