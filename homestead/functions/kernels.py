"""Weights by distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epanechnikov(distance: Column, width: Column | float) -> Column:
    """0.75 (1 - t^2) within the width, 0 beyond; null if the width is 0."""
    t = F.try_divide(distance, F.lit(width) if not isinstance(width, Column) else width)
    return F.when(t.isNull(), None).when(F.abs(t) <= 1, 0.75 * (1 - t * t)).otherwise(0.0)


def gaussian(distance: Column, bandwidth: float) -> Column:
    return F.exp(-distance * distance / bandwidth)


def nearest_k(rank: Column, k: int) -> Column:
    return (rank <= k).cast("double")
