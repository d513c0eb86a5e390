"""Dictionaries of several columns: whole numbers for the values of each column, kept and used again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homestead.operators.frame import global_ordinal
from homestead.shared import written

#: A dictionary is sent to all tasks only if it was measured and has no more rows and bytes than this (the driver holds some five times the bytes); else it is joined by value.
SMALL_ROWS, SMALL_BYTES = 250_000, 16 << 20
#: What a value that the dictionary hasn't is coded as: nothing, or 0.
UNSEEN = {"null": None, "zero": 0}


def _levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (as text) and n: all values of the columns from one pass, combined before the one shuffle. Null is no value."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(cells).alias("c")).select("c.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _numbered(levels: DataFrame) -> DataFrame:
    """levels with a code from 1 in each column, by value; whole columns are numbered over range partitions, none in one task."""
    placed = written(global_ordinal(levels, ["column", "value"], "__at"), "levels")
    first = placed.groupBy("column").agg(F.min("__at").alias("__first"))  # a row for each column
    return placed.join(F.broadcast(first), "column").select("column", "value", "n", (F.col("__at") - F.col("__first") + 1).alias("code"))


def dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n (how many rows have it), code: codes 1, 2, ... in each column in the order of its values as text."""
    return written(_numbered(_levels(df, columns)), "dictionary")


def extended(known: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """The dictionary with the values of df that it hasn't: old codes stay, new ones follow the largest of the column. n is that of the rows a value was first learned from."""
    new = _numbered(_levels(df, columns).join(known, ["column", "value"], "left_anti"))
    top = known.groupBy("column").agg(F.max("code").alias("__top"))
    more = new.join(F.broadcast(top), "column", "left").select("column", "value", "n", (F.col("code") + F.coalesce("__top", F.lit(0))).alias("code"))
    return written(known.select("column", "value", "n", "code").unionByName(more), "dictionary")


def _sent(part: DataFrame) -> DataFrame:
    rows, size = part.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("__value") + 24), F.lit(0))).first()
    return F.broadcast(part) if rows <= SMALL_ROWS and size <= SMALL_BYTES else part.hint("merge")


def coded(df: DataFrame, known: DataFrame, columns: list[str], unseen: str = "null", suffix: str = "_code") -> DataFrame:
    """df with a code for each column. Null has none; a value that is not in the dictionary is coded as `unseen` says (null or zero)."""
    for c in columns:
        part = known.where(F.col("column") == c).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        code = F.col("__code") if unseen == "null" else F.when(F.col(c).isNotNull(), F.coalesce("__code", F.lit(UNSEEN[unseen])))
        names = df.columns
        df = df.join(_sent(part), F.col(c).cast("string") == F.col("__value"), "left").select(*(F.col(f"`{n}`") for n in names), code.cast("long").alias(c + suffix))
    return df


def decoded(df: DataFrame, known: DataFrame, column: str, code: str, kind: str = "string") -> DataFrame:
    """df with the value that a code stands for, as `column`; null for codes that the dictionary hasn't."""
    part = known.where(F.col("column") == column).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
    return df.join(_sent(part), F.col(code) == F.col("__code"), "left").withColumn(column, F.col("__value").cast(kind)).drop("__value", "__code")
