"""Completion of a matrix with missing cells at low rank. Rows and columns are named by keys of any kind; the solver gets dense numbers for them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import recommendation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homestead.operators import dictionary, sampling
from homestead.shared import written

#: Numbers that the solver takes.
MOST_KEYS = (1 << 31) - 1
#: Starts that are tried at most, about how many cells they are tried on, and the error, as a share of the values' deviation, with which one is good enough.
STARTS, START_CELLS, GOOD_SHARE = 8, 50_000, 1e-4
#: Directions with less than this share of the learned factors' squares count as not learned; a cell may have this share of its factors in such directions.
NOT_LEARNED, OPEN_SHARE = 1e-6, 0.01


@dataclass
class Completion:
    """A fitted matrix: factors by number, the numbers of the keys, and the cells it was learned from, by number."""

    model: recommendation.ALSModel
    keys: DataFrame
    row: str
    column: str
    cells: DataFrame

    def _numbered(self, df: DataFrame) -> DataFrame:
        """The rows of df whose keys were both learned, with their numbers."""
        numbered = dictionary.coded(df, self.keys, [self.row, self.column], suffix="__number")
        known = numbered.where(F.col(f"{self.row}__number").isNotNull() & F.col(f"{self.column}__number").isNotNull())
        return known.withColumns({f"{c}__number": F.col(f"{c}__number").cast("int") for c in (self.row, self.column)})

    def transform(self, df: DataFrame) -> DataFrame:
        """df with a prediction for each row; rows whose row or column key was not learned are left out."""
        return self.model.transform(self._numbered(df)).drop(f"{self.row}__number", f"{self.column}__number")

    def determined(self, df: DataFrame, name: str = "determined") -> DataFrame:
        """df with whether the learned cells say what each cell is; rows whose row or column key was not learned are left out.

        The learned cells of a row give its factors only in the directions that the factors of their columns span, however
        many they are; in others any factors fit equally well. So the factors of a cell's column must lie in the span of
        those of the columns learned for its row, and those of its row in the span of those learned for its column.
        """
        out, rank = self._numbered(df), self.model.rank
        factors = {c: self._factors(c) for c in (self.row, self.column)}
        pairs = [(a, b) for a in range(rank) for b in range(a, rank)]
        told = F.lit(True)
        for own, other in ((self.row, self.column), (self.column, self.row)):
            at = F.col(f"__{other}_factors")
            learned = self.cells.join(self._sent(factors[other]), f"{other}__number").groupBy(f"{own}__number").agg(F.array(*(F.sum(at[a] * at[b]) for a, b in pairs)).alias(f"__{own}_learned"))
            side = written(learned.join(factors[own].hint("merge"), f"{own}__number"), "factors-learned")
            out = out.join(self._sent(side), f"{own}__number")
            told = told & (_open_share(F.col(f"__{own}_learned"), at) <= OPEN_SHARE)
        return out.select(*df.columns, told.alias(name))

    def _factors(self, side: str) -> DataFrame:
        found = self.model.userFactors if self.model.getUserCol() == f"{side}__number" else self.model.itemFactors
        return found.select(F.col("id").alias(f"{side}__number"), F.col("features").cast("array<double>").alias(f"__{side}_factors"))

    def _sent(self, side: DataFrame) -> DataFrame:
        """A table by number, sent to all tasks if it is measured and small: a few numbers may stand in all cells."""
        rows = side.count()
        width = 16 + 8 * self.model.rank * (2 + self.model.rank)
        return F.broadcast(side) if rows <= dictionary.SMALL_ROWS and rows * width <= dictionary.SMALL_BYTES else side.hint("merge")


def _open_share(learned: Column, factors: Column) -> Column:
    """Which share of the factors lies in directions that were not learned. learned: sums of the products of learned factors, the upper triangle by rows."""

    @F.pandas_udf("double")
    def share(sums: pd.Series, at: pd.Series) -> pd.Series:
        if not len(at):
            return pd.Series([], dtype=float)
        v, upper = np.stack(at.to_list()).astype(float), np.stack(sums.to_list()).astype(float)
        rank = v.shape[1]
        a, b = np.triu_indices(rank)
        m = np.zeros((len(v), rank, rank))
        m[:, a, b] = m[:, b, a] = upper
        least = np.maximum(NOT_LEARNED * np.trace(m, axis1=1, axis2=2), np.finfo(float).tiny)
        left = least[:, None] * np.linalg.solve(m + least[:, None, None] * np.eye(rank), v[:, :, None])[:, :, 0]
        return pd.Series(np.linalg.norm(left, axis=1) / np.maximum(np.linalg.norm(v, axis=1), np.finfo(float).tiny))

    return share(learned, factors)


def first_cells(cells: DataFrame, row: str, column: str, value: str, order: str | None = None) -> DataFrame:
    """One row a cell: of several values the first in `order`, or the smallest. Cells with a null in key or value are none."""
    known = cells.where(F.col(row).isNotNull() & F.col(column).isNotNull() & F.col(value).isNotNull())
    return known.groupBy(row, column).agg((F.min_by(value, order) if order else F.min(value)).cast("double").alias(value))


def keys_of(cells: DataFrame, row: str, column: str) -> DataFrame:
    """The dense numbers of row and column keys."""
    found = dictionary.dictionary(cells, [row, column])
    if (found.agg(F.max("code")).first()[0] or 0) > MOST_KEYS:
        raise ValueError("too many rows or columns for the solver")
    return found


def complete_matrix(cells: DataFrame, row: str, column: str, value: str, rank: int = 5, ridge: float = 0.1, iterations: int = 10, seed: int = 1, order: str | None = None, keys: DataFrame | None = None) -> Completion:
    """Low-rank completion of (row, column, value) cells. keys: numbers that were made before, for several fits.

    The solver starts at random factors and may end far from the best fit. So it starts on the side with fewer keys,
    whose factors don't fade as the other side grows, and starts are tried on whole lines of the other side, with about
    START_CELLS cells. All cells are then fitted from the best one, and from the next ones while the error over all
    cells is above twice that over the cells tried.
    """
    first = first_cells(cells, row, column, value, order)
    keys = keys if keys is not None else keys_of(first, row, column)
    numbered = dictionary.coded(first, keys, [row, column], suffix="__number")
    ready = numbered.select(F.col(f"{row}__number").cast("int").alias(f"{row}__number"), F.col(f"{column}__number").cast("int").alias(f"{column}__number"), F.col(value).cast("float").alias("rating"))
    ready = written(ready, "cells")
    cells_in, rows_in, columns_in, deviation = ready.agg(F.count(F.lit(1)), F.max(f"{row}__number"), F.max(f"{column}__number"), F.stddev_pop("rating")).first()
    short, long = (f"{row}__number", f"{column}__number") if (rows_in or 0) < (columns_in or 0) else (f"{column}__number", f"{row}__number")
    solver = recommendation.ALS(rank=rank, maxIter=iterations, regParam=ridge, userCol=short, itemCol=long, ratingCol="rating", seed=seed, nonnegative=False, coldStartStrategy="drop")
    tried = ready if cells_in <= START_CELLS else written(ready.where(sampling.uniform(F.col(long), seed) < START_CELLS / cells_in), "cells-tried")
    good = GOOD_SHARE * (deviation or 0.0)
    starts, best, least = _starts(solver, tried, seed, good), None, float("inf")
    for loss, start in starts:
        model = solver.copy().setSeed(start).fit(ready)
        own = loss if tried is ready else _loss(model, ready)
        if best is None or own < least:
            best, least = model, own
        if least <= max(good, 2 * loss):
            break
    return Completion(best, keys, row, column, ready)


def _loss(model: recommendation.ALSModel, cells: DataFrame) -> float:
    """The root of the mean squared error over the cells; infinite without any."""
    loss = model.transform(cells).agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("rating"), 2)))).first()[0]
    return float("inf") if loss is None else loss


def _starts(solver: recommendation.ALS, cells: DataFrame, seed: int, good: float) -> list[tuple[float, int]]:
    """Errors and seeds of the starts that were tried, the least first; one that is good ends the search."""
    found: list[tuple[float, int]] = []
    for start in range(seed, seed + STARTS):
        found.append((_loss(solver.copy().setSeed(start).fit(cells), cells), start))
        if found[-1][0] <= good:
            break
    return sorted(found)


def completion_search(cells: DataFrame, row: str, column: str, value: str, ranks: list[int], ridges: list[float], held: float = 0.2, seed: int = 1, iterations: int = 10) -> DataFrame:
    """rank, ridge, cells, rmse, determined, rmse_determined for each setting over the same held-out cells, drawn by a hash of row and column key; those of unknown rows and columns are left out.

    rmse_determined is that of the `determined` cells, which the learned ones determine at the largest rank; for the
    others many completions fit equally well.
    """
    first = written(first_cells(cells, row, column, value), "cells-first")
    lot = sampling.uniform(F.concat_ws(":", F.col(row).cast("string"), F.col(column).cast("string")), seed)
    train, test = first.where(lot >= held), first.where(lot < held).withColumnRenamed(value, "__actual")
    keys = keys_of(train, row, column)
    made = {(rank, ridge): complete_matrix(train, row, column, value, rank, ridge, iterations, seed, keys=keys) for rank in ranks for ridge in ridges}
    test = written(made[max(ranks), min(ridges)].determined(test, "__determined"), "cells-held")
    parts = []
    for (rank, ridge), fitted in made.items():
        off = F.pow(F.col("__actual") - F.col("prediction"), 2)
        errors_of = fitted.transform(test).agg(F.count(F.lit(1)).alias("cells"), F.sqrt(F.avg(off)).alias("rmse"), F.count_if("__determined").alias("determined"), F.sqrt(F.avg(F.when(F.col("__determined"), off))).alias("rmse_determined"))
        parts.append(errors_of.select(F.lit(rank).alias("rank"), F.lit(ridge).alias("ridge"), "cells", "rmse", "determined", "rmse_determined"))
    return reduce(DataFrame.unionByName, parts)


def errors(actual: DataFrame, estimates: DataFrame, row: str, column: str, price: str = "price", estimate: str = "estimate") -> DataFrame:
    """row, column, error (actual - estimate): the cells of the error matrix, where both are known.

    Cells that were made from few stored rows are taken for few by Spark, which would send them through the driver: they are joined by key.
    """
    left, right = first_cells(actual, row, column, price), first_cells(estimates, row, column, estimate)
    return left.join(right.hint("merge"), [row, column]).select(row, column, (F.col(price) - F.col(estimate)).alias("error"))


def corrected(estimates: DataFrame, fitted: Completion, estimate: str = "estimate", name: str = "corrected") -> DataFrame:
    """estimates plus the completed error of their cell; those without one are left out."""
    return fitted.transform(estimates).withColumn(name, F.col(estimate) + F.col("prediction")).withColumnRenamed("prediction", "error")
