"""Scalar functions and standardisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS-84 ellipsoid: long half axis in metres, squared eccentricity.
AXIS, ECC2 = 6378137.0, 0.00669437999014


def round_half_up(c: Column, digits: int = 0) -> Column:
    return F.floor(c * 10**digits + 0.5) / 10**digits


def metres_per_latitude(lat: Column) -> Column:
    return F.lit(math.pi * AXIS * (1 - ECC2) / 180) / F.pow(1 - ECC2 * F.pow(F.sin(F.radians(lat)), 2), 1.5)


def metres_per_longitude(lat: Column) -> Column:
    return F.lit(math.pi * AXIS / 180) * F.cos(F.radians(lat)) / F.sqrt(1 - ECC2 * F.pow(F.sin(F.radians(lat)), 2))


def space_distance2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared metres between two places, with the degree lengths of their mean latitude."""
    mean = (lat1 + lat2) / 2
    return F.pow((lat1 - lat2) * metres_per_latitude(mean), 2) + F.pow((lon1 - lon2) * metres_per_longitude(mean), 2)


def time_distance2(year1: Column, year2: Column, metres_per_year: float) -> Column:
    return F.pow((year1 - year2) * metres_per_year, 2)


def surface_distance(lat1: Column, lon1: Column, year1: Column, lat2: Column, lon2: Column, year2: Column, metres_per_year: float) -> Column:
    return F.sqrt(space_distance2(lat1, lon1, lat2, lon2) + time_distance2(year1, year2, metres_per_year))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def softmax(a: Column) -> Column:
    """Of an array; shifted by its maximum, so that nothing overflows. The maximum and the sum are taken once for an array."""
    shifted = F.transform(F.array(F.struct(a.alias("a"), F.array_max(a).alias("m"))), lambda s: F.transform(s["a"], lambda x: F.exp(x - s["m"])))[0]
    summed = F.transform(F.array(shifted), lambda p: F.struct(p.alias("p"), F.aggregate(p, F.lit(0.0), lambda s, y: s + y).alias("s")))
    return F.transform(summed, lambda t: F.transform(t["p"], lambda x: x / t["s"]))[0]


def fraction_of(part: Column, rest: Column) -> Column:
    """part / (part + rest), null where that is 0."""
    return F.try_divide(part, part + rest)


def weighted_midpoint(counts: list[Column], midpoints: list[float]) -> Column:
    """Mean of the bands' midpoints by their counts; null without counts."""
    total = sum((c for c in counts[1:]), counts[0])
    return F.try_divide(sum((c * m for c, m in zip(counts[1:], midpoints[1:], strict=True)), counts[0] * midpoints[0]), total)


def substitute(c: Column, pairs: list[tuple[object, object]]) -> Column:
    """Replaces values one pair after the other: what a pair put in, a later one may replace."""
    for old, new in pairs:
        c = F.when(c == old, F.lit(new)).otherwise(c)
    return c


def one_hot(c: Column, values: list[str]) -> list[Column]:
    """An indicator for each value; null where the code is empty."""
    return [F.when(c == "", None).otherwise((c == v).cast("int")) for v in values]


def one_hot_inverse(columns: dict[str, Column]) -> Column:
    """The value whose indicator is 1; null unless there is exactly one."""
    ones = sum((F.coalesce(c, F.lit(0)) for c in list(columns.values())[1:]), F.coalesce(next(iter(columns.values())), F.lit(0)))
    return F.when(ones == 1, F.coalesce(*(F.when(c == 1, F.lit(v)) for v, c in columns.items())))


def z_scores(df: DataFrame, columns: list[str], population: bool = True, suffix: str = "_z", fit_on: DataFrame | None = None) -> DataFrame:
    """df with a z-score for each column, by the mean and deviation of fit_on (df itself if none).

    population: divide by n, else by n - 1. One pass of partial aggregation makes one row, which is joined by broadcast. A constant column has null scores.
    """
    spread = F.stddev_pop if population else F.stddev_samp
    stats = (fit_on or df).agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}__m"), spread(c).alias(f"{c}__s"))))
    both = df.crossJoin(F.broadcast(stats))
    return both.select(*df.columns, *(F.try_divide(F.col(c) - F.col(f"{c}__m"), F.col(f"{c}__s")).alias(c + suffix) for c in columns))
