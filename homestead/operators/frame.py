"""Projection, row slicing, distinctness and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homestead.shared import written


def only_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def drop_columns(df: DataFrame, columns: list[str], must_exist: bool = False) -> DataFrame:
    if must_exist and (absent := [c for c in columns if c not in df.columns]):
        raise ValueError(f"no such columns: {absent}")
    return df.drop(*columns)


def drop_prefixed(df: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith(prefixes)))


def kinds(df: DataFrame) -> dict[str, str]:
    """number, string, boolean, date or nested for each column."""
    def kind(t: T.DataType) -> str:
        if isinstance(t, T.NumericType):
            return "number"
        return {"string": "string", "boolean": "boolean", "date": "date", "timestamp": "date"}.get(t.simpleString(), "nested")

    return {f.name: kind(f.dataType) for f in df.schema}


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def ordinal(df: DataFrame, order: list[str], partition: list[str], name: str = "ordinal") -> DataFrame:
    """The place of each row in its partition, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def _ranged(df: DataFrame, order: list[str], part: str, place: str) -> DataFrame:
    """df as a written table in range partitions of the order, with the number of each row's partition and its place there, from 0.

    Written once, so that whatever is counted and whatever is numbered are the same partitions.
    """
    at = F.monotonically_increasing_id()
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, at), "ranged")
    return ranged.withColumns({part: F.shiftright(place, 33), place: F.col(place).bitwiseAND(F.lit((1 << 33) - 1))})


def _before(totals: DataFrame, part: str, value: str, name: str) -> DataFrame:
    """part and the sum of value over all partitions before it: one row a partition."""
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias(name))


def global_ordinal(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """The place of each row in the order, from 1, without gathering rows in one task.

    Rows are range-partitioned by the order and numbered in their partition; the partitions' sizes, one number each,
    give what to add. The order must be total. An empty frame gives no rows.
    """
    part, place = f"__{name}_part", f"__{name}_at"
    ranged = _ranged(df, order, part, place)
    sizes = ranged.groupBy(part).agg((F.max(place) + 1).alias("__n"))
    return ranged.join(F.broadcast(_before(sizes, part, "__n", "__before")), part).select(*df.columns, (F.col("__before") + F.col(place) + 1).alias(name))


def running_total(df: DataFrame, order: list[str], value: str, name: str = "total") -> DataFrame:
    """df with the sum of value over all rows up to each in the order, by range partitions and their sums. The order must be total."""
    part, place = f"__{name}_part", f"__{name}_at"
    ranged = _ranged(df, order, part, place)
    sums = ranged.groupBy(part).agg(F.coalesce(F.sum(value), F.lit(0)).alias("__s"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(part).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return ranged.join(F.broadcast(_before(sums, part, "__s", "__before")), part).select(*df.columns, (F.col("__before") + own).alias(name))


def quantiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row with the exact, interpolated quantile of a whole column under each name; null without values.

    Values are counted before they are ordered, and found by their running counts, so that no task sees them all.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    upto = running_total(counts, ["value"], "n", "upto")
    rows = upto.agg(F.max("upto")).first()[0] or 0

    def at(place: int) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col("value").cast("double")))

    def quantile(share: float) -> Column:
        low, rest = divmod(share * max(rows - 1, 0), 1)
        return at(int(low)) + (at(int(low) + (rest > 0)) - at(int(low))) * F.lit(rest)

    return upto.agg(*(quantile(q).alias(name) for name, q in shares.items()))


def every_nth(df: DataFrame, order: list[str], n: int, start: int = 1) -> DataFrame:
    """Records start, start + n, start + 2n and so on of the order."""
    return global_ordinal(df, order, "__at").where((F.col("__at") - start) % n == 0).where(F.col("__at") >= start).drop("__at")


def split_rows(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for which the predicate holds, and all others, also those for which it is null."""
    holds = F.coalesce(predicate, F.lit(False))
    return df.where(holds), df.where(~holds)


def informative_columns(df: DataFrame) -> DataFrame:
    """column_name and n_distinct (null counts as a value) of columns with more than one value, in one pass."""
    stats = df.agg(*(F.struct(F.count_distinct(c).alias("d"), F.max(F.col(c).isNull().cast("int")).alias("m")).alias(c) for c in df.columns))
    long = stats.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), (F.col(f"`{c}`.d") + F.coalesce(F.col(f"`{c}`.m"), F.lit(0))).alias("n_distinct")) for c in df.columns))).alias("r"))
    return long.select("r.*").where("n_distinct > 1")


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, present, missing."""
    wide = df.agg(*(F.count(c).alias(c) for c in columns), F.count(F.lit(1)).alias("__n"))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("present"), (F.col("__n") - F.col(c)).alias("missing")) for c in columns))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def first_seen_codes(df: DataFrame, column: str, order: list[str], name: str = "code") -> DataFrame:
    """Codes 1, 2, ... for the values of a column in the order of their first appearance; null stays null.

    The distinct values are numbered, not the rows.
    """
    levels = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("__first"))
    levels = global_ordinal(levels, ["__first"], name).drop("__first")
    return df.join(levels, column, "left")


def drop_all_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose key occurs once."""
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n"), keys, "left_semi")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return ordinal(df, order, keys, "__at").where("__at = 1").drop("__at")


def beside(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of two frames with as many rows, pasted by their place."""
    a, b = global_ordinal(left, left_order, "__at"), global_ordinal(right, right_order, "__at")
    return a.join(b, "__at").drop("__at")


def equal_frames(a: DataFrame, b: DataFrame) -> bool:
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def fold_of(key: Column, folds: int) -> Column:
    """A fold from 0 by a whole number key."""
    return F.pmod(key, F.lit(folds))


def bernoulli_split(df: DataFrame, fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose lot, a hash of the seed and of all their values, is below the fraction, and the others; equal rows go together."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})).cast("binary"))
    lot = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(1 << 52)
    return df.where(lot < fraction), df.where(lot >= fraction)


def rows_at(df: DataFrame, order: list[str], places: DataFrame, place: str) -> DataFrame:
    """The rows at the places (from 1) of the order, one for each row of places; places beyond the rows give none."""
    return places.join(global_ordinal(df, order, "__at"), F.col(place) == F.col("__at")).drop("__at")


def has_indicators(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """The columns to keep, and has_ and has_not_ indicators (1 or 0) of each of the others: whether a row has a value there."""
    return df.select(*keep, *(c for name in columns for c in (F.col(name).isNotNull().cast("int").alias(f"has_{name}"), F.col(name).isNull().cast("int").alias(f"has_not_{name}"))))


def replaced(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """df with some columns replaced by expressions of its own columns, as when a query is asked for another day. Columns that it hasn't are an error."""
    if absent := [c for c in values if c not in df.columns]:
        raise ValueError(f"no such columns: {absent}")
    return df.withColumns(values)
