"""Named validity rules: rows that pass, first failing rule, and what each rule alone excludes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homestead.functions import codes, dates
from homestead.operators.frame import quantiles

Rules = dict[str, Column]


def _holds(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def valid(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows for which all rules hold; a rule that is null does not hold."""
    for rule in rules.values():
        df = df.where(rule)
    return df


def with_reason(df: DataFrame, rules: Rules, name: str = "reason") -> DataFrame:
    """df with the name of the first rule that fails, null for valid rows."""
    return df.withColumn(name, F.coalesce(*(F.when(~_holds(r), F.lit(n)) for n, r in rules.items())))


def exclusions(df: DataFrame, rules: Rules) -> DataFrame:
    """rule, excluded: how many rows each rule would exclude alone, in one pass."""
    wide = df.agg(*(F.count_if(~_holds(r)).alias(n) for n, r in rules.items()))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("excluded")) for n in rules))).alias("r")).select("r.*")


def positive_not_huge(df: DataFrame, column: str, q: float = 0.99) -> DataFrame:
    """Rows whose value lies above 0 and at most at the quantile of the whole column."""
    top = quantiles(df, column, {"__top": q})
    return df.crossJoin(F.broadcast(top)).where((F.col(column) > 0) & (F.col(column) <= F.col("__top"))).drop("__top")


def _long(c: Column) -> Column:
    return c.try_cast("long")


def _day(c: Column) -> Column:
    return dates.parse_day(c)


def _without_day_zero(c: Column) -> Column:
    return F.when(F.length(c) == 8, F.concat(F.substring(c, 1, 6), F.when(F.substring(c, 7, 2) == "00", "01").otherwise(F.substring(c, 7, 2)))).otherwise(c)


#: Filters by name, as in declarative field tables. Each takes a text column, in which a missing field is null or empty.
FIELD_FILTERS: dict[str, Callable[[Column], Column]] = {
    "any": lambda c: F.lit(True),
    "string or empty": lambda c: F.lit(True),
    "present": lambda c: c.isNotNull() & (c != ""),
    "string": lambda c: F.length(c) > 0,
    "string not empty": lambda c: F.length(c) != 0,
    "date": lambda c: _day(c).isNotNull(),
    "date fixed in [1979,2009]": lambda c: F.year(_day(c)).between(1979, 2009),
    "double": lambda c: c.try_cast("double").isNotNull(),
    "float": lambda c: c.try_cast("float").isNotNull(),
    "int": lambda c: c.try_cast("int").isNotNull(),
    "int or empty": lambda c: (c == "") | c.try_cast("int").isNotNull(),
    "long": lambda c: _long(c).isNotNull(),
    "long or empty": lambda c: (c == "") | _long(c).isNotNull(),
    "long > 0": lambda c: _long(c) > 0,
    "long > 1775": lambda c: _long(c) > 1775,
    "yes, no or empty": lambda c: c.isin("Y", "N", " ", ""),
    "Y N space empty": lambda c: c.isin("Y", "N", " ", ""),
} | {f"long in [{low}, {high}]": lambda c, low=low, high=high: _long(c).between(low, high) for low, high in ((0, 4), (1, 5), (100, 400), (572, 18898), (597, 5133), (1000, 10000000), (7975, 809657), (9799, 1353247))}

#: Recodings by name: what a kept field becomes.
RECODINGS: dict[str, Callable[[Column], Column]] = {
    "": lambda c: c,
    "date fix": lambda c: _without_day_zero(F.when(F.length(c) == 10, F.regexp_replace(c, "-", "")).otherwise(c)),
    "Y N space empty indicator": lambda c: F.when(c.isin("", "N", " "), "0").otherwise("1"),
    "empty to zero": lambda c: F.when(c == "", "0").otherwise(c),
    "new construction indicator": lambda c: F.when(c.isin("3", "003"), "1").otherwise("0"),
}


def field_rules(fields: dict[str, str]) -> Rules:
    """Rules from a table of column and filter name."""
    return {f"{c}: {f}": FIELD_FILTERS[f](F.col(c)) for c, f in fields.items()}


def recoded(df: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """The fields of a declarative table (column: filter and recoding), of rows whose fields all pass, recoded."""
    rows = valid(df, field_rules({c: f for c, (f, _) in fields.items()}))
    return rows.select(*(RECODINGS[recoding](F.col(c)).alias(c) for c, (_, recoding) in fields.items()))


#: The highest price that counts as one of a home.
TOP_PRICE = 85e6


def sale_rules(columns: dict[str, str]) -> Rules:
    """The rules a sale of one home passes. columns: the names that a table has for price, deed, transaction, sale_code, multi_flag, multi_count, buildings,
    total, land, improvement, year_built, effective_year, rooms, units, latitude, longitude and recorded; rules for columns that it hasn't are left out.
    """
    c = {k: F.col(v) for k, v in columns.items()}
    values = [c[k] for k in ("total", "land", "improvement") if k in c]
    rules = {
        "price": lambda: (c["price"] > 0) & (c["price"] <= TOP_PRICE),
        "deed": lambda: codes.DEEDS.any_of(c["deed"], "grant.deed", "deed.of.trust"),
        "transaction": lambda: codes.TRANSACTIONS.any_of(c["transaction"], "resale", "new.construction"),
        "sale_code": lambda: codes.SALES.has(c["sale_code"], "sale.price.full"),
        "multi_flag": lambda: c["multi_flag"].isNull() & (c["multi_count"] <= 1),
        "buildings": lambda: c["buildings"] == 1,
        "total": lambda: reduce(lambda a, b: a & b, [(v > 0) & (v < TOP_PRICE) for v in values]),
        "year_built": lambda: c["year_built"] > 0,
        "effective_year": lambda: c["effective_year"] > 0,
        "rooms": lambda: c["rooms"] > 0,
        "units": lambda: c["units"] == 1,
        "latitude": lambda: (c["latitude"] != 0) & (c["longitude"] != 0),
        "recorded": lambda: c["recorded"].isNotNull(),
    }
    return {name: rule() for name, rule in rules.items() if name in c}
