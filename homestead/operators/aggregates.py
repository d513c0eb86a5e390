"""Grouped statistics of errors, prices and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homestead.operators.frame import running_total
from homestead.shared import written


def rmse(actual: Column, estimate: Column) -> Column:
    """Pairs with a null are left out."""
    return F.sqrt(F.avg(F.pow(actual - estimate, 2)))


def within(actual: Column, estimate: Column, share: float = 0.1, inclusive: bool = True) -> Column:
    """Fraction of pairs whose relative error is at most (or below) the share; pairs with a null are left out."""
    far = F.abs(F.try_divide(actual - estimate, actual))
    return F.avg((far <= share if inclusive else far < share).cast("double"))


def coverage(estimate: Column) -> Column:
    return F.avg(estimate.isNotNull().cast("double"))


def sign_fractions(c: Column) -> list[Column]:
    """Number and fractions of negative, zero and positive values."""
    n = F.count(c)
    return [n.alias("n"), *(F.try_divide(F.count_if(p), n).alias(name) for name, p in (("negative", c < 0), ("zero", c == 0), ("positive", c > 0)))]


def cumulative_within(df: DataFrame, relative: Column, limits: list[float]) -> DataFrame:
    """limit, fraction of rows whose absolute relative value is at most the limit; one pass."""
    wide = df.agg(*(F.avg((F.abs(relative) <= x).cast("double")).alias(f"l{i}") for i, x in enumerate(limits)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(x).alias("limit"), F.col(f"l{i}").alias("fraction")) for i, x in enumerate(limits)))).alias("r")).select("r.*")


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """value, n and the running share of rows up to the value, values sorted. Values are counted before they are ordered."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    upto = running_total(counts, ["value"], "n", "upto")
    whole = upto.agg(F.max("upto").alias("__all"))
    return upto.crossJoin(F.broadcast(whole)).select("value", "n", (F.col("upto") / F.col("__all")).alias("cumulative"))


def confusion(df: DataFrame, actual: str, predicted: str, values: list) -> DataFrame:
    """A row for each actual value, a column for each predicted one."""
    return df.groupBy(actual).pivot(predicted, values).count().na.fill(0)


def error_rate(actual: Column, predicted: Column) -> Column:
    return 1 - F.avg((actual == predicted).cast("double"))


def flags_by(df: DataFrame, place: str, flags: dict[str, Column]) -> DataFrame:
    """For each place, whether any of its rows has each flag."""
    return df.groupBy(place).agg(*(F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()))


def declines(df: DataFrame, period: list[str], value: str) -> DataFrame:
    """Each period's value with its ratio to the one before. Periods are few: they are grouped before they are ordered."""
    return df.withColumn("ratio", F.try_divide(F.col(value), F.lag(value).over(Window.orderBy(*period))))


def index_to_base(df: DataFrame, value: str, base: Column) -> DataFrame:
    """value relative to that of the row for which `base` holds."""
    at = df.where(base).agg(F.max(value).alias("__base"))
    return df.crossJoin(F.broadcast(at)).withColumn("index", F.try_divide(F.col(value), F.col("__base"))).drop("__base")


def dense_periods(df: DataFrame, years: list[int]) -> DataFrame:
    """df (with year and month) and a row for each missing month of the years."""
    spark = df.sparkSession
    grid = spark.range(len(years) * 12).select((F.lit(years[0]) + F.floor(F.col("id") / 12)).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"))
    return F.broadcast(grid).join(df, ["year", "month"], "left")


#: Rows of a group that one task may gather for an exact quantile; beyond, groups are ranked over range partitions.
GATHERED = 2_000_000


def group_quantiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float], gathered: int = GATHERED, at_most: int | None = None) -> DataFrame:
    """keys and the exact, interpolated quantiles of a column under their names, for each group; groups without values have nulls.

    at_most: a bound of all rows that is known beforehand. Where it shows that no group is large, Spark's own percentile gathers each in a task. Else values are counted by group, once, into
    a table. If no group has many different values, percentiles come from its counts; else they are ranked by running counts over range partitions of
    (keys, value) and picked out, so that no group, however large, meets in one task. All give the same.
    """
    named = df.select(*keys, F.col(column).cast("double").alias("__v"))
    if at_most is not None and at_most <= gathered:
        return named.groupBy(*keys).agg(*(F.percentile("__v", q).alias(name) for name, q in shares.items()))
    counted = written(named.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n")), "counts")
    if (counted.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= gathered:
        return counted.groupBy(*keys).agg(*(F.percentile("__v", q, F.col("__n")).alias(name) for name, q in shares.items()))
    counts = counted.where("__v IS NOT NULL")
    upto = running_total(counts, [*keys, "__v"], "__n", "__upto")
    bounds = upto.groupBy(*keys).agg(F.min(F.col("__upto") - F.col("__n")).alias("__base"), F.max("__upto").alias("__top"))
    right = bounds.select(*(F.col(k).alias(f"__of_{k}") for k in keys), "__base", (F.col("__top") - F.col("__base")).alias("__size"))
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]
    ranked = upto.join(right, same).withColumn("__rank", F.col("__upto") - F.col("__base"))

    def quantile(share: float) -> Column:
        place = (F.col("__size") - 1) * share
        at = lambda p: F.min(F.when(F.col("__rank") > p, F.col("__v")))
        low = at(F.floor(place))
        return low + (at(F.ceil(place)) - low) * F.max(place - F.floor(place))

    found = ranked.groupBy(*keys).agg(*(quantile(q).alias(name) for name, q in shares.items()))
    every = counted.select(*keys).distinct()
    return every.join(found.select(*(F.col(k).alias(f"__of_{k}") for k in keys), *shares), same, "left").select(*keys, *shares)


def with_quantiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float], *others: Column, gathered: int = GATHERED, at_most: int | None = None) -> DataFrame:
    """keys, quantiles as of group_quantiles and other aggregates of each group; one pass where no group is large."""
    if at_most is not None and at_most <= gathered:
        return df.groupBy(*keys).agg(*(F.percentile(F.col(column).cast("double"), q).alias(name) for name, q in shares.items()), *others)
    found = group_quantiles(df, keys, column, shares, gathered)
    right = found.select(*(F.col(k).alias(f"__key_{k}") for k in keys), *shares)
    rest = df.groupBy(*keys).agg(*others)
    return rest.join(right, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]).drop(*(f"__key_{k}" for k in keys))


def with_bare(df: DataFrame, aggregates: list[Column], bare: list[str], order: list[str], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Aggregates beside columns that are not aggregated: those have their values in the group's last row of the order. One row without keys, as long as there are rows."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max_by(F.struct(*bare), F.struct(*order)).alias("__last"), *aggregates)
    return out.where("__n > 0").select(*keys, "__last.*", *(c for c in out.columns if c not in (*keys, "__last", "__n")))
