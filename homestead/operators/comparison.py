"""Two sets of estimates compared with actual prices, day by day of an estimation grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homestead.operators.aggregates import within


def compared(actual: DataFrame, first: DataFrame, second: DataFrame, key: str, day: str, price: str, asked_for: Column, grid_day: Column, estimate: str = "estimate", share: float = 0.1) -> DataFrame:
    """One row of counts and errors. Prices and estimates are logarithms; estimates have one row for each key and day of the grid.

    actual is looked up at (key, grid_day), where grid_day maps its own day to one of the grid; rows for which `asked_for` does not hold are only
    counted. first_closer, second_closer and equal count whose absolute error is smaller; the root mean squared errors are those of logarithms; the
    fractions within a share (below it) are those of prices. All of this is over rows that both sets have.
    """
    rows = actual.where(F.col(price).isNotNull()).select(F.col(key).alias("__k"), grid_day.cast("date").alias("__d"), F.col(price).alias("__a"), F.coalesce(asked_for, F.lit(False)).alias("__asked"))
    named = lambda df, n: df.select(F.col(key).alias("__k"), F.col(day).cast("date").alias("__d"), F.col(estimate).alias(n))
    both = rows.join(named(first, "__f"), ["__k", "__d"], "left").join(named(second, "__s"), ["__k", "__d"], "left")
    has_f, has_s, asked = F.col("__f").isNotNull(), F.col("__s").isNotNull(), F.col("__asked")
    seen = asked & has_f & has_s
    only = lambda c: F.when(seen, c)
    far_f, far_s = F.abs(F.col("__a") - F.col("__f")), F.abs(F.col("__a") - F.col("__s"))
    inside = lambda e: within(only(F.exp("__a")), only(F.exp(e)), share, inclusive=False)
    return both.agg(
        F.count(F.lit(1)).alias("actual"),
        F.count_if(~asked).alias("not_asked_for"),
        F.count_if(asked & ~has_f & has_s).alias("not_in_first"),
        F.count_if(asked & has_f & ~has_s).alias("not_in_second"),
        F.count_if(asked & ~has_f & ~has_s).alias("in_neither"),
        F.count_if(seen).alias("compared"),
        F.count_if(seen & (far_f < far_s)).alias("first_closer"),
        F.count_if(seen & (far_f > far_s)).alias("second_closer"),
        F.count_if(seen & (far_f == far_s)).alias("equal"),
        F.sqrt(F.avg(only(far_f * far_f))).alias("first_rmse"),
        F.sqrt(F.avg(only(far_s * far_s))).alias("second_rmse"),
        inside("__f").alias("first_within"),
        inside("__s").alias("second_within"),
    )
