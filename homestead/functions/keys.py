"""Cleaning of record keys that come in a plain and a formatted spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_key(plain: Column, formatted: Column) -> Column:
    """The plain key without hyphens if it is all digits, else the formatted one, else null."""
    no_hyphen = lambda c: F.regexp_replace(c, "-", "")
    good = lambda c: F.when(no_hyphen(c).rlike("^[0-9]+$"), no_hyphen(c))
    return F.coalesce(good(plain), good(formatted)).cast("long")


def number_key(plain: Column, formatted: Column) -> Column:
    """The plain key if it reads as a number, else the formatted one without hyphens, else null."""
    return F.coalesce(plain.try_cast("double"), F.regexp_replace(formatted, "-", "").try_cast("double"))


def padded_key(plain: Column, formatted: Column, width: int = 10) -> Column:
    """Hyphens, spaces and underscores dropped, left-padded with zeros; the first spelling that is a whole number of at most `width` digits."""
    def one(c: Column) -> Column:
        bare = F.regexp_replace(c, "[-_ ]", "")
        return F.when(bare.rlike(f"^[0-9]{{1,{width}}}$"), F.lpad(bare, width, "0"))

    return F.coalesce(one(plain), one(formatted))


def pack_key_date(key: Column, day: Column) -> Column:
    """Ten digits of key and eight of date as one string."""
    return F.concat(F.lpad(key.cast("string"), 10, "0"), F.date_format(day, "yyyyMMdd"))


def unpack_key_date(packed: Column) -> tuple[Column, Column]:
    return F.substring(packed, 1, 10).cast("long"), F.to_date(F.substring(packed, 11, 8), "yyyyMMdd")
