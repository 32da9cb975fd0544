"""A shuffle without state: a keyed bijection on [0, n), evaluated where it is needed.

Four rounds of a Feistel network over the smallest even number of bits that holds n - 1; what falls outside [0, n) is sent through
again. All arithmetic is on unsigned 64-bit numbers that wrap around, which is why it runs in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The multipliers and the increment of splitmix64, the number of rounds, and the most passes.
M1, M2, STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
ROUNDS, PASSES = 4, 96
_FULL = (1 << 64) - 1


def mix(x: int) -> int:
    """The finaliser of splitmix64."""
    x &= _FULL
    for shift, factor in ((30, M1), (27, M2)):
        x = ((x ^ (x >> shift)) * factor) & _FULL
    return x ^ (x >> 31)


def epoch_seed(base: int, epoch: int) -> int:
    """The seed of an epoch, of 63 bits."""
    return mix(base * STEP + (epoch + 1) * M1) & (_FULL >> 1)


def half_width(n: int) -> int:
    """Bits of each half of the network for a domain of n."""
    return (max(2, (n - 1).bit_length()) + 1) // 2


def round_keys(seed: int) -> list[int]:
    return [mix(seed * STEP + k * STEP) for k in range(1, ROUNDS + 1)]


def _mix_all(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, M1), (27, M2)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where the bijection of (n, seed) sends each index of [0, n)."""
    out = np.asarray(index).astype(np.uint64)
    if n <= 1:
        return out.astype(np.int64)
    half = half_width(n)
    shift, low = np.uint64(half), np.uint64((1 << half) - 1)
    keys = [np.uint64(k) for k in round_keys(seed)]
    todo = np.arange(len(out))
    for _ in range(PASSES + 1):
        a, b = out[todo] >> shift, out[todo] & low
        for k in keys:
            a, b = b, a ^ (_mix_all(b + k) & low)
        out[todo] = (a << shift) | b
        todo = todo[out[todo] >= np.uint64(n)]
        if not len(todo):
            return out.astype(np.int64)
    raise RuntimeError("the walk did not end")


def permute(index: Column, n: int, seed: int) -> Column:
    """Column form of permuted() for one (n, seed)."""

    @F.pandas_udf("bigint")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(), n, seed))

    return run(index)


def permute_epochs(index: Column, epoch: Column, n: int, base_seed: int) -> Column:
    """Column form where each row's epoch gives the seed."""

    @F.pandas_udf("bigint")
    def run(x: pd.Series, e: pd.Series) -> pd.Series:
        out = np.empty(len(x), np.int64)
        for one in e.unique():
            own = (e == one).to_numpy()
            out[own] = permuted(x.to_numpy()[own], n, epoch_seed(base_seed, int(one)))
        return pd.Series(out)

    return run(index, epoch)
