"""Reproducible draws from integer keys: the same in Spark and in any SQL engine with 64-bit integers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_M1, _M2 = 2147483647, 2147483629


def draw(key: Column, seed: int | Column = 0) -> Column:
    """A number in [0, 2147483629) from a non-negative integer key and a seed."""
    s = F.lit(seed).cast("long") if isinstance(seed, int) else seed.cast("long")
    h = ((key.cast("long") % _M1 + 1) * F.lit(1103515245).cast("long") + s * F.lit(12345).cast("long")) % _M1
    return (h * h + F.lit(7919).cast("long") * h) % _M2


def fold_of(key: Column, k: int | Column, seed: int | Column = 0) -> Column:
    return (draw(key, seed) % k).cast("int")


def draw_sql(key: str, seed: str | int = 0) -> str:
    """The same number as SQL text."""
    h = f"((CAST({key} AS BIGINT) % {_M1} + 1) * CAST(1103515245 AS BIGINT) + CAST({seed} AS BIGINT) * 12345) % {_M1}"
    return f"((({h}) * ({h}) + CAST(7919 AS BIGINT) * ({h})) % {_M2})"


#: Draws below these have 0, 1, ... occurrences: the Poisson(1) distribution in steps of 1 / 2147483629.
_POISSON = [int(_M2 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def poisson(key: Column, replicate: Column, seed: int = 0) -> Column:
    """A Poisson(1) count from a key and a replicate's number; 12 at most."""
    at = draw(draw(key, seed) + replicate.cast("long") * F.lit(1000003).cast("long"), seed)
    return sum((F.when(at >= F.lit(t).cast("long"), 1).otherwise(0) for t in _POISSON[1:]), F.when(at >= F.lit(_POISSON[0]).cast("long"), 1).otherwise(0))


def poissons(keys: np.ndarray, replicates: np.ndarray, seed: int = 0) -> np.ndarray:
    """``poisson`` of arrays of keys and replicates, for tasks that work on arrays."""

    def drawn(x: np.ndarray) -> np.ndarray:
        h = ((x % _M1 + 1) * 1103515245 + seed * 12345) % _M1
        return (h * h + 7919 * h) % _M2

    at = drawn(drawn(keys.astype(np.int64)) + replicates.astype(np.int64) * 1000003)
    return np.searchsorted(np.array(_POISSON, np.int64), at.ravel(), side="right").reshape(at.shape)


def poisson_sql(key: str, replicate: str, seed: int = 0) -> str:
    """The same count as SQL text."""
    at = draw_sql(f"({draw_sql(key, seed)} + CAST({replicate} AS BIGINT) * 1000003)", seed)
    return f"list_sum(list_transform([{', '.join(map(str, _POISSON))}], lambda t: CASE WHEN {at} >= t THEN 1 ELSE 0 END))"
