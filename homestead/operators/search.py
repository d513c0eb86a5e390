"""Search of settings: all settings of a table are tried on the candidates of a query at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homestead.operators.validation import performance

#: Settings that one pass tries on each query; a larger table is taken in blocks.
MAX_SETTINGS = 1000


def combined(*frames: DataFrame) -> DataFrame:
    """All combinations of the distinct rows of some small frames of settings, one name (or more) each."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b.distinct())), frames[1:], frames[0].distinct())


def tried(candidates: DataFrame, settings: DataFrame) -> DataFrame:
    """query, k, metres, average, kernel: the estimates of each query under each setting (k, metres), from one pass over the candidates.

    candidates: query, id, y, space2, time2; those without y are left out. Of a query they are few (the candidates of the largest k), so they stand in one array and settings
    are tried on it one after the other: the k nearest by space2 + time2 * metres^2, ties by id. average: their mean y; kernel: Epanechnikov weights as wide
    as the k-th distance. Both are null with fewer than k; the kernel estimate also if all weights vanish.
    """
    listed = candidates.where("y IS NOT NULL").groupBy("query").agg(F.collect_list(F.struct("space2", "time2", "id", "y")).alias("__c"))
    known = settings.select(F.col("k").cast("int").alias("k"), F.col("metres").cast("double").alias("metres")).distinct()
    blocks = max(1, -(-known.count() // MAX_SETTINGS))

    def estimate(s: Column) -> Column:
        ordered = F.array_sort(F.transform("__c", lambda c: F.struct((c["space2"] + c["time2"] * s["metres"] * s["metres"]).alias("d2"), c["id"].alias("id"), c["y"].alias("y"))))
        near = F.transform(F.array(F.slice(ordered, 1, s["k"])), lambda n: F.struct(n.alias("n"), F.element_at(n, -1)["d2"].alias("w2"), (F.size(n) == s["k"]).alias("full")))
        total = lambda n, of: F.aggregate(n, F.lit(0.0), lambda t, x: t + of(x))
        weight = lambda x, w2: F.greatest(F.lit(0.0), 1 - F.try_divide(x["d2"], w2))
        return F.transform(near, lambda v: F.struct(s["k"].alias("k"), s["metres"].alias("metres"), F.when(v["full"], total(v["n"], lambda x: x["y"]) / s["k"]).alias("average"), F.when(v["full"], F.try_divide(total(v["n"], lambda x: x["y"] * weight(x, v["w2"])), total(v["n"], lambda x: weight(x, v["w2"])))).alias("kernel")))[0]

    parts = []
    for b in range(blocks):
        some = known.where(F.pmod(F.xxhash64("k", "metres"), F.lit(blocks)) == b) if blocks > 1 else known
        row = some.agg(F.collect_list(F.struct("k", "metres")).alias("__s"))
        parts.append(listed.crossJoin(F.broadcast(row)).select("query", F.explode(F.transform("__s", estimate)).alias("e")).select("query", "e.*"))
    return reduce(DataFrame.unionByName, parts)


def searched(candidates: DataFrame, settings: DataFrame, actual: DataFrame) -> DataFrame:
    """k, metres, model, rmse, within, coverage of each setting over the queries (query, actual) that have an actual value."""
    known = tried(candidates.where("id <> query"), settings).join(actual.where("actual IS NOT NULL"), "query")
    both = known.select("k", "metres", "actual", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("estimate")) for m in ("average", "kernel")))).alias("m")).select("k", "metres", "actual", "m.*")
    return performance(both, ["k", "metres", "model"])
