"""The linear congruential recurrence of the Monte-Carlo workload, inside Catalyst."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MULTIPLIER, INCREMENT, MODULUS = 998_244_353, 19_260_817, 134_456
HALF = MODULUS // 2


def step(n: Column) -> Column:
    """One draw. The state stays below MODULUS, so the product stays far below 2^63."""
    return (n * F.lit(MULTIPLIER).cast("bigint") + F.lit(INCREMENT)) % F.lit(MODULUS)


def hits(seed: Column, draws: int) -> Column:
    """Points inside the unit circle among ``draws`` points, two steps a point."""
    start = F.struct((seed.cast("bigint") % MODULUS).alias("n"), F.lit(0).cast("bigint").alias("c"))

    def one(acc: Column, _: Column) -> Column:
        nx = step(acc["n"])
        x = nx / F.lit(float(HALF)) - 1
        ny = step(nx)
        y = ny / F.lit(float(HALF)) - 1
        return F.struct(ny.alias("n"), (acc["c"] + F.when(x * x + y * y < 1, 1).otherwise(0).cast("bigint")).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(draws)), start, one, lambda a: a["c"])


def hits_by_state(draws: int) -> np.ndarray:
    """Hits of ``draws`` points from each state 0..MODULUS-1, a table of fixed size.

    Where 2^k points lead from each state, and their hits, composed with themselves give those of
    2^(k+1), so the work grows with the logarithm of ``draws``.
    """
    draw = lambda n: (n * MULTIPLIER + INCREMENT) % MODULUS
    at = np.arange(MODULUS, dtype=np.int64)
    nx = draw(at)
    ny = draw(nx)
    x, y = nx / float(HALF) - 1, ny / float(HALF) - 1
    to, won = ny, (x * x + y * y < 1).astype(np.int64)
    total = np.zeros(MODULUS, np.int64)
    while draws:
        if draws & 1:
            total, at = total + won[at], to[at]
        won, to = won + won[to], to[to]
        draws >>= 1
    return total
