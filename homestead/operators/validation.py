"""Folds, hyper-parameter grids and the choice of the best model."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homestead.operators import sampling
from homestead.operators.aggregates import coverage, rmse, within
from homestead.operators.frame import quantiles


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of the named values."""
    return spark.createDataFrame(list(product(*values.values())), list(values))


def random_settings(df: DataFrame, key: str, ranges: dict[str, tuple[str, float, float]], seed: int = 1) -> DataFrame:
    """Random settings for each key: each name uniform between its bounds, or geometric, that is uniform in its logarithm."""

    def drawn(name: str, kind: str, low: float, high: float):
        u = sampling.uniform(F.concat_ws(":", F.col(key), F.lit(name)), seed)
        return (low + u * (high - low) if kind == "uniform" else F.exp(math.log(low) + u * (math.log(high) - math.log(low)))).alias(name)

    return df.select(key, *(drawn(name, *how) for name, how in ranges.items()))


def random_grid(spark: SparkSession, n: int, ranges: dict[str, tuple[str, float, float]], seed: int = 1) -> DataFrame:
    """n random settings, numbered in `set` from 1."""
    return random_settings(spark.range(1, n + 1).select(F.col("id").alias("set")), "set", ranges, seed)


def is_best(df: DataFrame, model: str, loss: str, expected) -> DataFrame:
    """One row: the hypothesis that a model has the least mean loss, whether it holds, and the model that has."""
    found = best(df, model, loss)
    return found.select(F.lit(f"best model is {expected}").alias("hypothesis"), F.col(model).eqNullSafe(F.lit(expected)).alias("passed"), F.col(model).cast("string").alias("best"))


def performance(df: DataFrame, by: list[str], actual: str = "actual", estimate: str = "estimate") -> DataFrame:
    """rmse, within (10 %) and coverage for each group."""
    return df.groupBy(*by).agg(rmse(F.col(actual), F.col(estimate)).alias("rmse"), within(F.col(actual), F.col(estimate)).alias("within"), coverage(F.col(estimate)).alias("coverage"))


def best(df: DataFrame, model: str, loss: str) -> DataFrame:
    """The model with the least mean loss; of equal ones the smaller."""
    means = df.groupBy(model).agg(F.avg(loss).alias("mean_loss"))
    return means.agg(F.min_by(model, F.struct("mean_loss", model)).alias(model), F.min("mean_loss").alias("mean_loss"))


def cross_validate(df: DataFrame, fold: str, folds: int, models: dict[str, Callable[[DataFrame, DataFrame], DataFrame]]) -> DataFrame:
    """model, fold, rmse, within, coverage of all folds in one pass a model.

    Each model is given training and test rows with a column `fold`, the fold that is tested: a row is in the test rows once and in the training rows
    once for each other fold. It returns the test rows with actual and estimate, and learns for each fold by grouping.
    """
    test = df.withColumn("fold", F.col(fold).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    train = test.withColumn("fold", F.explode(others))
    return reduce(DataFrame.unionByName, [performance(run(train, test).withColumn("model", F.lit(name)), ["model", "fold"]) for name, run in models.items()])


def strata(df: DataFrame, value: str, name: str = "stratum") -> DataFrame:
    """rich above twice the median, poor below half of it, else middle."""
    mid = quantiles(df, value, {"__m": 0.5})
    return df.crossJoin(F.broadcast(mid)).withColumn(name, F.when(F.col(value) > 2 * F.col("__m"), "rich").when(F.col(value) < 0.5 * F.col("__m"), "poor").otherwise("middle")).drop("__m")
