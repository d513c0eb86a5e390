"""Tests and intervals of means by resampling.

A resample is never held: each row has a weight or a group in each resample, drawn from a hash of its key, and resamples
are sums that combine before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homestead.operators import sampling
from homestead.operators.frame import running_total

#: Resamples that one pass takes; rows are read once for each block of them.
BLOCK = 250


def _name(key: Column, resample: Column) -> Column:
    return F.concat_ws(":", key.cast("string"), resample.cast("string"))


def lots(key: Column, resample: Column, seed: int) -> Column:
    """A number in [0, 1) for each key and resample."""
    return sampling.uniform(_name(key, resample), seed)


def poisson_weight(digits: Column) -> Column:
    """How often a row is in a bootstrap resample: a Poisson number of mean 1, from the digits of a lot (of sampling.digits), which are compared as they are."""
    term, total, weight = 0.36787944117144233, 0.0, F.lit(0)
    for k in range(8):
        total += term
        weight = weight + (digits >= f"{math.ceil(total * (1 << 52)):013x}").cast("int")
        term /= k + 1
    return weight


def _resampled(rows: DataFrame, resamples: int) -> DataFrame:
    """Each row once for each resample. Rows are dealt over all tasks first: a file that one task reads may give many times its rows here."""
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks).withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples))))


def _sums(rows: DataFrame, resamples: int, seed: int, parts) -> DataFrame:
    """resample and the sums that `parts` (a function of the weight) names."""
    lot = _resampled(rows, resamples).withColumn("__d", sampling.digits(_name(F.col("__k"), F.col("resample")), seed))
    return lot.withColumn("__w", poisson_weight(F.col("__d"))).groupBy("resample").agg(*parts(F.col("__w")))


def difference_significance(df: DataFrame, key: str, group: str, a: str, b: str, value: str, resamples: int = 1000, seed: int = 1) -> DataFrame:
    """observed difference of means of a and b, and the share of resamples with as large a one or larger (in its direction).

    In each resample rows are dealt to the two groups anew, with the groups' shares of the rows.
    """
    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select(F.col(key).alias("__k"), F.col(group).alias("__g"), F.col(value).alias("__v"))
    observed = rows.agg((F.avg(F.when(F.col("__g") == a, F.col("__v"))) - F.avg(F.when(F.col("__g") == b, F.col("__v")))).alias("observed"), F.avg((F.col("__g") == a).cast("double")).alias("share"))
    first = F.col("__u") < F.col("share")
    dealt = _resampled(rows.crossJoin(F.broadcast(observed)), resamples).withColumn("__u", lots(F.col("__k"), F.col("resample"), seed))
    means = dealt.groupBy("resample", "observed").agg((F.avg(F.when(first, F.col("__v"))) - F.avg(F.when(~first, F.col("__v")))).alias("d"))
    beyond = F.when(F.col("observed") < 0, F.col("d") <= F.col("observed")).otherwise(F.col("d") >= F.col("observed"))
    return means.groupBy("observed").agg(F.avg(beyond.cast("double")).alias("probability"))


def mean_interval(df: DataFrame, key: str, value: str, resamples: int = 1000, seed: int = 1, level: float = 0.9) -> DataFrame:
    """mean, low and high: the bias-corrected percentile interval of a mean."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    sums = _sums(rows, resamples, seed, lambda w: [F.try_divide(F.sum(w * F.col("__v")), F.sum(w)).alias("m")])
    whole = rows.agg(F.avg("__v").alias("mean"))
    kept = sums.where("m IS NOT NULL").crossJoin(F.broadcast(whole)).groupBy("mean").agg(F.avg((F.col("m") < F.col("mean")).cast("double")).alias("below"), F.array_sort(F.collect_list("m")).alias("ms"))  # one number a resample
    z0, z = normal_quantile(F.col("below")), normal_quantile(F.lit(0.5 + level / 2))
    some = (F.col("below") > 0) & (F.col("below") < 1)

    def end(sign: int) -> Column:
        share = F.when(some, normal_cdf(2 * z0 + sign * z)).otherwise(F.lit(float(sign > 0)))
        return F.get("ms", F.least(F.size("ms") - 1, F.floor(share * F.size("ms"))).cast("int"))

    return kept.select("mean", end(-1).alias("low"), end(1).alias("high"))


def bootstrap_difference(df: DataFrame, group: str, a: str, b: str, value: str, resamples: int = 1000, seed: int = 1, level: float = 0.95, key: str | None = None) -> DataFrame:
    """Mean difference between groups a and b over the resamples and its percentile interval. key: names rows; without one their places do, which depend on partitions."""
    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select((F.col(key) if key else F.monotonically_increasing_id()).alias("__k"), F.col(group).alias("__g"), F.col(value).alias("__v"))
    mean = lambda w, g: F.try_divide(F.sum(F.when(F.col("__g") == g, w * F.col("__v"))), F.sum(F.when(F.col("__g") == g, w)))
    means = _sums(rows, resamples, seed, lambda w: [(mean(w, a) - mean(w, b)).alias("d")])
    tail = (1 - level) / 2
    return means.agg(F.avg("d").alias("difference"), F.percentile("d", tail).alias("low"), F.percentile("d", 1 - tail).alias("high"))


#: Terms of the series below. A place where more would be needed is so far out that the function is 0 or 1.
TERMS = 200


def normal_cdf(z: Column) -> Column:
    """The normal distribution function, by its series around 0; 0 or 1 beyond 8 deviations."""
    step = lambda s, n: F.struct((s["t"] * s["z"] * s["z"] / (2 * n + 1)).alias("t"), (s["s"] + s["t"] * s["z"] * s["z"] / (2 * n + 1)).alias("s"), s["z"].alias("z"))
    start = F.struct(z.cast("double").alias("t"), z.cast("double").alias("s"), z.cast("double").alias("z"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: 0.5 + F.exp(-s["z"] * s["z"] / 2) / math.sqrt(2 * math.pi) * s["s"])
    return F.when(z > 8, 1.0).when(z < -8, 0.0).otherwise(found)


def normal_quantile(p: Column) -> Column:
    """The place where the normal distribution function is p, by halving; for p in (0, 1) and places within 8 deviations."""
    step = lambda s, n: F.transform(F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"), ((s["a"] + s["b"]) / 2).alias("m"), s["p"].alias("p"))), lambda t: F.when(normal_cdf(t["m"]) < t["p"], F.struct(t["m"].alias("a"), t["b"].alias("b"), t["p"].alias("p"))).otherwise(F.struct(t["a"].alias("a"), t["m"].alias("b"), t["p"].alias("p"))))[0]
    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(-8.0).alias("a"), F.lit(8.0).alias("b"), p.cast("double").alias("p")), step, lambda s: (s["a"] + s["b"]) / 2)


# The coefficients of the approximation of the gamma function with g = 7 and 9 terms, good to about 1e-15.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function, for x > 0.5."""
    base = x - 1 + 7.5
    total = sum((F.lit(c) / (x - 1 + i) for i, c in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.log(base) - base + F.log(total)


def gamma_cdf(x: Column, shape: Column) -> Column:
    """The distribution function of a gamma variable with rate 1, by its series; 1 where x is beyond what the series reaches."""
    step = lambda s, n: F.struct((s["t"] * s["x"] / (s["a"] + n)).alias("t"), (s["s"] + s["t"] * s["x"] / (s["a"] + n)).alias("s"), s["x"].alias("x"), s["a"].alias("a"))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"), x.cast("double").alias("x"), shape.cast("double").alias("a"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["s"])
    return F.when(x <= 0, 0.0).when(x > shape + 8 * F.sqrt(shape) + 40, 1.0).otherwise(F.exp(shape * F.log(x) - x - log_gamma(shape + 1)) * series)


def _in_batches(step) -> Callable[..., Column]:
    """The sum of a series of at most TERMS terms, from 1, over Arrow batches; step(x, n, shape) gives the ratio of a term to the one before. A batch stops where no term counts any more."""

    def run(x: pd.Series, shape: pd.Series) -> pd.Series:
        at, a = x.to_numpy(float), shape.to_numpy(float)
        term, total = np.ones(len(at)), np.ones(len(at))
        for n in range(1, TERMS + 1):
            term = term * step(at, n, a)
            total += term
            if not (term > 1e-18 * total).any():
                break
        return pd.Series(total)

    return F.pandas_udf(run, "double")


def many_normal_cdf(z: Column) -> Column:
    """normal_cdf for a column of many rows."""
    series = _in_batches(lambda x, n, a: x * x / (2 * n + 1))
    near = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return F.when(z > 8, 1.0).when(z < -8, 0.0).otherwise(0.5 + F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * z * series(near, F.lit(0.0)))


def many_gamma_cdf(x: Column, shape: Column) -> Column:
    """gamma_cdf for a column of many rows."""
    series = _in_batches(lambda x, n, a: x / (a + n))
    near = F.least(F.greatest(x, F.lit(0.0)), shape + 8 * F.sqrt(shape) + 40)
    return F.when(x <= 0, 0.0).when(x > shape + 8 * F.sqrt(shape) + 40, 1.0).otherwise(F.exp(shape * F.log(x) - x - log_gamma(shape + 1)) * series(near, shape))


def empirical(df: DataFrame, value: str) -> DataFrame:
    """value, n, below and upto: how many rows have each value, and the shares of rows below it and up to it.

    Values are counted before they are put in order, over range partitions; null and NaN are no values.
    """
    known = df.select(F.col(value).cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)")
    upto = running_total(known.groupBy("value").agg(F.count(F.lit(1)).alias("n")), ["value"], "n", "__upto")
    whole = upto.agg(F.max("__upto").alias("__all"))
    return upto.crossJoin(F.broadcast(whole)).select("value", "n", ((F.col("__upto") - F.col("n")) / F.col("__all")).alias("below"), (F.col("__upto") / F.col("__all")).alias("upto"))


def fit_distances(df: DataFrame, value: str) -> DataFrame:
    """distribution, distance: the greatest distance between the empirical distribution of the positive values and each fitted one (of fitted_distributions).

    Fits are three rows that are sent to where the values are; distances combine before the shuffle.
    """
    positive = df.where(F.col(value) > 0)
    fits = fitted_distributions(positive, value).agg(*(F.max(F.when(F.col("distribution") == d, F.struct("first", "second"))).alias(d) for d in ("lognormal", "gamma", "weibull")))
    x = F.col("value")
    cdf = {
        "lognormal": many_normal_cdf((F.log(x) - F.col("lognormal.first")) / F.col("lognormal.second")),
        "gamma": many_gamma_cdf(x * F.col("gamma.second"), F.col("gamma.first")),
        "weibull": 1 - F.exp(-F.pow(x / F.col("weibull.second"), F.col("weibull.first"))),
    }
    placed = empirical(positive, value).crossJoin(F.broadcast(fits)).select("below", "upto", *(c.alias(d) for d, c in cdf.items()))
    far = placed.agg(*(F.max(F.greatest(F.abs(F.col(d) - F.col("below")), F.abs(F.col(d) - F.col("upto")))).alias(d) for d in cdf))
    return far.select(F.explode(F.array(*(F.struct(F.lit(d).alias("distribution"), F.col(d).alias("distance")) for d in cdf))).alias("r")).select("r.*")


def fitted_distributions(df: DataFrame, value: str) -> DataFrame:
    """distribution, first, second: parameters of lognormal (mean and deviation of logs), gamma (shape, rate) and Weibull (shape, scale) for the positive values.

    Lognormal by maximum likelihood, gamma by the usual approximation of it, Weibull by the moments of logs; one pass.
    """
    x, log = F.col(value).cast("double"), F.log(F.col(value).cast("double"))
    s = df.where(F.col(value) > 0).agg(F.avg(x).alias("m"), F.avg(log).alias("ml"), F.stddev_pop(log).alias("sl"))
    gap = F.log("m") - F.col("ml")
    shape = (3 - gap + F.sqrt(F.pow(gap - 3, 2) + 24 * gap)) / (12 * gap)
    steep = F.lit(1.2825498301618641) / F.col("sl")
    rows = F.array(
        F.struct(F.lit("lognormal").alias("distribution"), F.col("ml").alias("first"), F.col("sl").alias("second")),
        F.struct(F.lit("gamma").alias("distribution"), shape.alias("first"), (shape / F.col("m")).alias("second")),
        F.struct(F.lit("weibull").alias("distribution"), steep.alias("first"), F.exp(F.col("ml") + 0.5772156649015329 / steep).alias("second")),
    )
    return s.select(F.explode(rows).alias("r")).select("r.*")
