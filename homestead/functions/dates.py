"""Repair, choice and bucketing of dates, some of which come as YYYYMMDD with day 00."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_day(text: Column, zero_day: str = "01") -> Column:
    """YYYYMMDD or YYYY-MM-DD as a date; day 00 becomes `zero_day`; null if it is no date."""
    digits = F.regexp_replace(text, "-", "")
    return F.try_to_timestamp(F.regexp_replace(digits, "^([0-9]{6})00$", f"$1{zero_day}"), F.lit("yyyyMMdd")).cast("date")


def choose_day(first: Column, second: Column) -> Column:
    """The first text that is a date."""
    return F.coalesce(parse_day(first), parse_day(second))


def split_day(day: Column) -> tuple[Column, Column, Column]:
    return F.year(day), F.month(day), F.dayofmonth(day)


def days_since_1900(day: Column) -> Column:
    return F.datediff(day, F.lit("1900-01-01").cast("date"))


def standard_day(day: Column, mean: float, deviation: float) -> Column:
    return (days_since_1900(day) - mean) / deviation


def mid_month(day: Column) -> Column:
    return F.make_date(F.year(day), F.month(day), F.lit(15))


def mid_quarter(day: Column) -> Column:
    """The 15th of the middle month of the calendar quarter."""
    return F.make_date(F.year(day), F.quarter(day) * 3 - 1, F.lit(15))


def nearest_mid_quarter(day: Column) -> Column:
    """The mid-quarter day with the fewest days between; of two as near the earlier."""
    mids = F.array(F.make_date(F.year(day) - 1, F.lit(11), F.lit(15)), *(F.make_date(F.year(day), F.lit(m), F.lit(15)) for m in (2, 5, 8, 11)), F.make_date(F.year(day) + 1, F.lit(2), F.lit(15)))
    return F.array_min(F.transform(mids, lambda m: F.struct(F.abs(F.datediff(day, m)).alias("far"), m.alias("mid"))))["mid"]


def quarter_index(day: Column, first_year: int) -> Column:
    """Quarters since the start of first_year, from 1."""
    return (F.year(day) - first_year) * 4 + F.quarter(day)


def month_index(day: Column, first_year: int) -> Column:
    return (F.year(day) - first_year) * 12 + F.month(day)


def in_decade(day: Column, start: int) -> Column:
    return F.year(day).between(start, start + 9)


def is_mid_quarter(day: Column) -> Column:
    """Whether a day is the 15th of the middle month of its quarter."""
    return day == mid_quarter(day)


def quarter_of(index: Column, first_year: int) -> Column:
    """The mid-quarter day of a quarter's index, the inverse of quarter_index."""
    return F.make_date(F.lit(first_year) + F.floor((index - 1) / 4).cast("int"), (F.pmod(index - 1, F.lit(4)) * 3 + 2).cast("int"), F.lit(15))


def month_of(index: Column, first_year: int) -> Column:
    """The middle of the month of a month's index, the inverse of month_index."""
    return F.make_date(F.lit(first_year) + F.floor((index - 1) / 12).cast("int"), (F.pmod(index - 1, F.lit(12)) + 1).cast("int"), F.lit(15))
