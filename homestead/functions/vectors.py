"""Functions of arrays of numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def distance2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(distance2(a, b))


def p_distance(a: Column, b: Column, p: float) -> Column:
    return F.pow(total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x.cast("double") - y.cast("double")), F.lit(p)))), F.lit(1 / p))


def with_bias(a: Column) -> Column:
    return F.concat(F.array(F.lit(1.0)), F.transform(a, lambda x: x.cast("double")))


def kronecker(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x.cast("double") * y.cast("double"))))


def scaled(a: Column, diagonal: Column) -> Column:
    return F.zip_with(a, diagonal, lambda x, d: x.cast("double") * d.cast("double"))


def argmax(a: Column) -> Column:
    """Place of the first maximum, from 1."""
    return F.array_position(a, F.array_max(a))


def without(a: Column, place: Column) -> Column:
    """The array but for the element at a place, from 1."""
    return F.filter(a, lambda _, i: i + 1 != place)


def standardized(a: Column) -> Column:
    """z-scores in the array (population deviation); null if it is constant."""
    n = F.size(a)
    mean = total(a) / n
    spread = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") - mean, 2)) / n)
    return F.when(spread > 0, F.transform(a, lambda x: (x.cast("double") - mean) / spread))


def times_vector(matrix: Column, v: Column) -> Column:
    """The product of a matrix (array of rows) and a vector."""
    return F.transform(matrix, lambda row: dot(row, v))


def times_matrix(a: Column, b: Column) -> Column:
    """The product of two matrices (arrays of rows)."""
    width = F.size(F.element_at(b, 1))
    column = lambda j: F.transform(b, lambda row: F.get(row, j))
    return F.transform(a, lambda row: F.transform(F.sequence(F.lit(0), width - 1), lambda j: dot(row, column(j))))


def has_nan(a: Column) -> Column:
    return F.exists(a, lambda x: F.isnan(x.cast("double")))


def all_zero(a: Column) -> Column:
    return F.forall(a, lambda x: x == 0)


def sorted_keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def merged_maps(a: Column, b: Column) -> Column:
    """Entries of both; of a key that both have, b's value."""
    own = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.map_concat(own, b)


def path_parts(path: Column) -> tuple[Column, Column, Column]:
    """Folder, name without its ending, and ending of a path; empty where there is none."""
    folder, name = F.regexp_extract(path, "^(.*/)?([^/]*)$", 1), F.regexp_extract(path, "^(.*/)?([^/]*)$", 2)
    return F.regexp_replace(folder, "/$", ""), F.regexp_replace(name, r"(.)\.[^.]*$", "$1"), F.regexp_extract(name, r".\.([^.]*)$", 1)


def sparse_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, v of the product of two matrices held as cells (i, j, v), of any size; cells whose sum is 0 stay."""
    left, right = a.select("i", F.col("j").alias("m"), F.col("v").alias("p")), b.select(F.col("i").alias("m"), "j", F.col("v").alias("q"))
    return left.join(right, "m").groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("v"))


def cholesky_solved(matrix: Column, v: Column) -> Column:
    """struct(solution, logdet) of matrix x = v by the Cholesky factor of a small matrix in each row; null if it is not positive definite."""

    @F.pandas_udf("solution array<double>, logdet double")
    def solve(matrices: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        rows = []
        for m, x in zip(matrices, vectors, strict=True):
            try:
                factor = np.linalg.cholesky(np.array(m.tolist(), float))
            except (np.linalg.LinAlgError, AttributeError):
                rows.append((None, None))
                continue
            half = np.linalg.solve(factor, np.array(x, float))
            rows.append((np.linalg.solve(factor.T, half).tolist(), float(2 * np.log(np.diag(factor)).sum())))
        return pd.DataFrame(rows, columns=["solution", "logdet"])

    return solve(matrix, v)
