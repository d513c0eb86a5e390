"""From sales, parcels, tracts and places to one table of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homestead.operators import validity


def observations(sales: DataFrame, parcels: DataFrame, tracts: DataFrame, places: DataFrame, parcel: str, tract: str, place: str) -> DataFrame:
    """Inner joins on parcel, tract and place keys, in which nulls match nothing. Small sides are broadcast by Spark's own estimate."""
    return sales.join(parcels, parcel).join(tracts, tract).join(places, place)


def with_rejects(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with the first rule that they break."""
    marked = validity.with_reason(rows, rules)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def estimation_grid(keys: DataFrame, key: str, years: list[int]) -> DataFrame:
    """Every key with every mid-quarter day of the years; the days are few."""
    days = F.explode(F.array(*(F.lit(f"{y}-{m:02d}-15").cast("date") for y in years for m in (2, 5, 8, 11))))
    return keys.select(key).where(F.col(key).isNotNull()).distinct().select(key, days.alias("day"))
