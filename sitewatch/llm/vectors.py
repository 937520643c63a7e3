"""Embedding vectors as exact integers, for the operators that read them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integers up to this size square and sum over 64 places within 64 bits.
NARROW = 2**24


def is_finite(vector: str) -> Column:
    """True where the array is there and every component is a finite number."""
    inside = F.forall(
        F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf))
    )
    return F.coalesce(inside, F.lit(False))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of doubles: 64-bit integers, or Python's where one is large.

    ``scale`` is a power of two, so the product is exact.
    """
    values = np.asarray(values, dtype=np.float64)
    if not len(values) or np.abs(values).max() <= NARROW / scale:
        return np.floor(values * scale).astype(np.int64)
    return np.array(
        [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in values.tolist()],
        dtype=object,
    )


def narrow(integers: np.ndarray) -> bool:
    return integers.dtype != object
