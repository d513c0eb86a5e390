"""Joins by key with the key rules of hand-made merges, nearest dates and latest earlier rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(x: DataFrame, y: DataFrame, by_x: str, by_y: str) -> DataFrame:
    """Inner join; columns with one name on both sides get the prefixes "x " and "y ". Null and NaN keys match nothing."""
    both = {c for c in x.columns if c in y.columns}
    left = x.select(*(F.col(c).alias(f"x {c}" if c in both else c) for c in x.columns))
    right = y.select(*(F.col(c).alias(f"y {c}" if c in both else c) for c in y.columns))
    key_x, key_y = f"x {by_x}" if by_x in both else by_x, f"y {by_y}" if by_y in both else by_y
    return left.join(right, left[f"`{key_x}`"] == right[f"`{key_y}`"])


def merge_first_last(x: DataFrame, y: DataFrame, by_x: str, by_y: str, x_order: Column, y_order: Column, key: str) -> DataFrame:
    """One row per common key: the first row of x and the last of y, the key last under a new name."""
    def usable(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))

    xs, ys = [c for c in x.columns if c != by_x], [c for c in y.columns if c != by_y]
    first = x.where(usable(by_x)).groupBy(F.col(by_x).alias(key)).agg(F.min_by(F.struct(*xs), x_order).alias("__x"))
    last = y.where(usable(by_y)).groupBy(F.col(by_y).alias(key)).agg(F.max_by(F.struct(*ys), y_order).alias("__y"))
    return first.join(last, key).select("__x.*", "__y.*", key)


def presence(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """For each combination of frames that have a key (a flag each), the number of keys."""
    marked = None
    for name, df in frames.items():
        one = df.select(*keys).distinct().select(*keys, *(F.lit(n == name).cast("int").alias(n) for n in frames))
        marked = one if marked is None else marked.unionByName(one)
    return marked.groupBy(*keys).agg(*(F.max(n).alias(n) for n in frames)).groupBy(*frames).agg(F.count(F.lit(1)).alias("n_keys"))


def nearest_day(df: DataFrame, day: str, candidates: DataFrame, candidate: str, name: str = "nearest") -> DataFrame:
    """df with the candidate day nearest to each row's day; of two as near the earlier one.

    Only the distinct days of df are looked at; for each the last candidate up to it and the first after it come from a
    running maximum and minimum over the merged days, so nothing is crossed.
    """
    days = df.select(F.col(day).cast("date").alias("__d")).where("__d IS NOT NULL").distinct().withColumn("__c", F.lit(None).cast("date"))
    marks = candidates.select(F.col(candidate).cast("date").alias("__d")).where("__d IS NOT NULL").distinct().withColumn("__c", F.col("__d"))
    merged = days.unionByName(marks).withColumn("__bucket", F.year("__d"))
    ahead = merged.groupBy("__bucket").agg(F.min("__c").alias("__low"), F.max("__c").alias("__high"))
    year = Window.orderBy("__bucket")
    around = ahead.select("__bucket", F.max("__high").over(year.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.min("__low").over(year.rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
    own = Window.partitionBy("__bucket").orderBy("__d")
    placed = merged.join(F.broadcast(around), "__bucket").select("__d", "__c", F.coalesce(F.max("__c").over(own.rangeBetween(Window.unboundedPreceding, 0)), F.col("__before")).alias("__p"), F.coalesce(F.min("__c").over(own.rangeBetween(0, Window.unboundedFollowing)), F.col("__after")).alias("__n"))
    near = placed.where("__c IS NULL").select("__d", F.when(F.col("__n").isNull() | (F.datediff("__d", "__p") <= F.datediff("__n", "__d")), F.col("__p")).otherwise(F.col("__n")).alias(name))
    return df.join(near, F.col(day).cast("date") == near["__d"], "left").drop("__d")


def latest_before(df: DataFrame, earlier: DataFrame, key: str, at: str, order: list[str], fields: list[str], prefix: str = "prior_") -> DataFrame:
    """df with the fields of the latest row of `earlier` (of the largest `at`, then first in order) of each key."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc(), *order)
    last = earlier.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(key, *(F.col(f).alias(prefix + f) for f in fields))
    return df.join(last, key, "left")


def previous_row(df: DataFrame, key: str, order: list[str], fields: list[str], prefix: str = "prior_") -> DataFrame:
    """df with the fields of the row before it among the rows of its key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.select("*", *(F.lag(f).over(w).alias(prefix + f) for f in fields))


def children(parents: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Parents with an array of structs for each kind of child rows; an empty array where there are none."""
    for name, rows in parts.items():
        rest = [c for c in rows.columns if c != key]
        grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
        parents = parents.join(grouped, key, "left")
        parents = parents.withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return parents


def as_of(df: DataFrame, earlier: DataFrame, key: str, at: str, fields: list[str], order: list[str] = [], tolerance: Column | None = None, strict: bool = True, prefix: str = "prior_", slices: int = 128) -> DataFrame:  # noqa: B006
    """df with the fields of the latest row of `earlier` of its key before its time `at` (at or before it, if not strict), and that row's time.

    Of rows of one key and time the first in `order` counts. tolerance: an interval; older rows are as none. Null keys and times match nothing; every
    row of df stays, once. The times of a key are cut into slices that hold about the same number of rows of `earlier` each, and the last row of a
    slice is carried into the later ones, so that a key with very many rows is dealt over many tasks. Only distinct times of a
    key are put in order; rows of df get theirs by a join.
    """
    named = [F.col(f).alias(prefix + f) for f in fields]
    given = earlier.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key).alias("__k"), F.col(at).alias("__t"))
    given = given.agg(F.min_by(F.struct(*named, F.col(at).alias(prefix + at)), F.struct(*(order or fields))).alias("__v"))
    asked = df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("__k"), F.col(at).alias("__t")).distinct()
    cuts = given.agg(F.percentile_approx("__t", [i / slices for i in range(1, slices)], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))

    def slice_of(low: int, high: int) -> Column:
        """The number of cuts up to a time, by halving."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("__t") < F.lit(cuts[mid]), slice_of(low, mid)).otherwise(slice_of(mid + 1, high))

    place = slice_of(0, len(cuts)).alias("__s")
    nothing = F.lit(None).cast(given.schema["__v"].dataType).alias("__v")
    given, asked = given.select("__k", place, "__t", "__v"), asked.select("__k", place, "__t", nothing)
    ends = given.groupBy("__k", "__s").agg(F.max_by("__v", "__t").alias("__v")).unionByName(asked.select("__k", "__s", nothing)).groupBy("__k", "__s").agg(F.max("__v").alias("__v"))
    carried = ends.select("__k", "__s", F.last("__v", ignorenulls=True).over(Window.partitionBy("__k").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)).alias("__v"))
    side = lambda rows, n: rows.withColumn("__side", F.lit(n))
    rows = side(carried.where("__v IS NOT NULL").select("__k", "__s", F.lit(None).cast(given.schema["__t"].dataType).alias("__t"), "__v"), 0).unionByName(side(given, 2)).unionByName(side(asked, 1 if strict else 3))
    so_far = Window.partitionBy("__k", "__s").orderBy(F.col("__t").asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("__v", F.last("__v", ignorenulls=True).over(so_far)).where(F.col("__side") == (1 if strict else 3)).select("__k", "__t", "__v")
    out = df.join(found, (df[key] == found["__k"]) & (df[at] == found["__t"]), "left")
    near = F.lit(True) if tolerance is None else F.col(f"__v.{prefix}{at}") >= F.col(at) - tolerance
    return out.select(*(df[c] for c in df.columns), *(F.when(near, F.col(f"__v.{prefix}{f}")).alias(prefix + f) for f in (*fields, at)))
