"""Reproducible splits, permutations, samples and draws.

All chance comes from a hash of a key and a seed, so a row has the same lot however it is partitioned and whenever a lost
task runs again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homestead.operators.frame import global_ordinal


def digits(key: Column, seed: int) -> Column:
    """52 random bits for each key and seed, as 13 hexadecimal digits; null for a null key."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 13)


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) with 52 random bits for each key and seed; null for a null key."""
    return F.conv(digits(key, seed), 16, 10).cast("long") / float(1 << 52)


def labelled(df: DataFrame, key: str, shares: dict[str, float], seed: int = 1, name: str = "part") -> DataFrame:
    """df with one of the labels for each row, by shares of 1; rows of one key get one label. The last label takes what is left."""
    lot, upto, label = uniform(F.col(key), seed), 0.0, None
    for part, share in list(shares.items())[:-1]:
        upto += share
        label = F.when(lot < upto, part) if label is None else label.when(lot < upto, part)
    last = F.lit(list(shares)[-1])
    return df.withColumn(name, last if label is None else label.otherwise(last))


def permuted(df: DataFrame, key: str, seed: int = 1, name: str = "place") -> DataFrame:
    """df with the place of each row, from 1, in a random order. Keys are unique."""
    lot = f"__{name}_lot"
    return global_ordinal(df.withColumn(lot, uniform(F.col(key), seed)), [lot, key], name).drop(lot)


def exact_parts(df: DataFrame, key: str, shares: dict[str, float], seed: int = 1, name: str = "part") -> DataFrame:
    """df with labels of which each but the last has exactly round(share * rows) rows, drawn without replacement."""
    placed = permuted(df, key, seed, "__place")
    n, label, upto = df.count(), None, 0
    for part, share in list(shares.items())[:-1]:
        upto += math.floor(share * n + 0.5)
        label = F.when(F.col("__place") <= upto, part) if label is None else label.when(F.col("__place") <= upto, part)
    last = F.lit(list(shares)[-1])
    return placed.withColumn(name, last if label is None else label.otherwise(last)).drop("__place")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """n rows without replacement, or all if there are fewer. Each task sends its n first rows only."""
    return df.withColumn("__lot", uniform(F.col(key), seed)).orderBy("__lot", key).limit(n).drop("__lot")


def sample_again(df: DataFrame, key: str, n: int, seed: int = 1, name: str = "draw") -> DataFrame:
    """n rows with replacement, with the number of each draw, from 1. No row if df has none."""
    rows = df.count()
    placed = global_ordinal(df, [key], "__place")
    draws = df.sparkSession.range(1, n + 1).select(F.col("id").alias(name))
    draws = draws.withColumn("__place", (F.floor(uniform(F.col(name), seed) * rows) + 1).cast("long"))
    return draws.join(placed, "__place").drop("__place")


def whole(u: Column, low: int, high: int) -> Column:
    """A whole number from low to high, both included, from a uniform one."""
    return (F.floor(u * (high - low + 1)) + low).cast("long")


def bernoulli(u: Column, p: float) -> Column:
    return (u < p).cast("int")


def geometric(u: Column, p: float) -> Column:
    """Trials up to the first success, from 1."""
    return (F.floor(F.log(1 - u) / math.log(1 - p)) + 1).cast("long")


def exponential(u: Column, rate: float) -> Column:
    return -F.log(1 - u) / rate


def cauchy(u: Column, middle: float = 0.0, spread: float = 1.0) -> Column:
    return middle + spread * F.tan(math.pi * (u - 0.5))


def gaussian(u: Column, v: Column, mean: float = 0.0, deviation: float = 1.0) -> Column:
    """From two uniform numbers."""
    return mean + deviation * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def log_normal(u: Column, v: Column, mean: float = 0.0, deviation: float = 1.0) -> Column:
    return F.exp(gaussian(u, v, mean, deviation))
