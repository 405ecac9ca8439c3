"""Vectors as arrays of doubles.  Sums go from left to right, so that results are the same in any plan."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def pair_max(a: Column, b: Column) -> Column:
    """Position by position, the larger one."""
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def normalised(a: Column) -> Column:
    """At length 1; a zero vector stays."""
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x))


def ordered_products(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Inner products (queries, rows of block), bit for bit those of dot()."""
    out = np.zeros((len(queries), len(block)))
    for d in range(queries.shape[1]):
        out += queries[:, d, None] * block[None, :, d]
    return out
