"""Nearest neighbours, kernel estimates and votes of stated queries against all rows.

Queries are a stated, bounded set: they are counted, and sent to where the rows are if there are at most MAX_QUERIES; more
are taken in blocks, each of which reads the rows once. Each task keeps the k nearest of its rows for every query before anything is
shuffled. The neighbours of all rows among each other are in neighbor_join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homestead.functions import kernels, numbers

#: Queries that one block, and so one pass over the rows, holds; queries whose distances to a batch of rows are held at once.
MAX_QUERIES, AT_ONCE = 10_000, 256


def euclidean(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - one) ** 2).sum(1))


def nearest(queries: DataFrame, rows: DataFrame, k: int, query_id: str, row_id: str, vector: str, keep: list[str] = [], leave_self_out: bool = True, metric: Callable[[np.ndarray, np.ndarray], np.ndarray] = euclidean, carry: bool = False) -> DataFrame:  # noqa: B006
    """query, neighbour, distance, rank (from 1) and the columns to keep of the k nearest rows of each query.

    metric: distances of some rows' vectors to one query's, in double; ties go to the smaller id. Null vectors are left out. carry: with the
    neighbour's vector as `at`, which spares a join with all rows.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("query"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("q"))
    blocks = max(1, -(-asked.count() // MAX_QUERIES))
    parts = [_block(asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b) if blocks > 1 else asked, rows, k, row_id, vector, leave_self_out, metric, carry) for b in range(blocks)]
    best = parts[0]
    for p in parts[1:]:
        best = best.unionByName(p)
    w = Window.partitionBy("query").orderBy("distance", "neighbour")
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(rows.select(F.col(row_id).alias("neighbour"), *keep), "neighbour") if keep else best


def matrix(column: pa.Array, kind: str = "f8") -> np.ndarray:
    """The rows of a column of arrays of one length; a null component is NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), kind)


def squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of all rows of a and b by a matrix product, and more than their error."""
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    return np.maximum(aa[:, None] + bb[None] - 2 * (a @ b.T), 0), 1e-11 * float(aa.max(initial=0) + bb.max(initial=0)) + 1e-300


def keep_nearest(ids: np.ndarray, far: np.ndarray, start: int, i: np.ndarray, new_ids: np.ndarray, new_far: np.ndarray, places: np.ndarray | None = None, new_places: np.ndarray | None = None) -> None:
    """Puts new neighbours, new_ids of the queries start + i, among the best of each query so far, by distance and then id."""
    if not len(i):
        return
    some, k = np.unique(i), far.shape[1]
    at = start + some
    who, dist, which = np.concatenate([np.repeat(some, k), i]), np.concatenate([far[at].ravel(), new_far]), np.concatenate([ids[at].ravel(), new_ids])
    order = np.lexsort((which, dist, who))
    who = who[order]
    begin = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    take = order[begin[:, None] + np.arange(k)]
    if places is not None:
        places[at] = np.concatenate([places[at].reshape(-1, places.shape[2]), new_places])[take]
    far[at], ids[at] = dist[take], which[take]


def _block(asked: DataFrame, rows: DataFrame, k: int, row_id: str, vector: str, leave_self_out: bool, metric: Callable, carry: bool) -> DataFrame:
    found = asked.toPandas()  # at most about MAX_QUERIES vectors
    held = asked.sparkSession.sparkContext.broadcast((found["query"].to_numpy(np.int64), np.array(found["q"].tolist(), float).reshape(len(found), -1)))
    product = metric is euclidean

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = held.value
        ids, far = np.full((len(names), k), np.iinfo(np.int64).max), np.full((len(names), k), np.inf)
        places = np.zeros((len(names), k, q.shape[1])) if carry else None
        for b in batches:
            if not b.num_rows:
                continue
            own, v = b.column("id").to_numpy(zero_copy_only=False), matrix(b.column("v"))
            for at in range(0, len(names), AT_ONCE):
                part = slice(at, at + AT_ONCE)
                d, slack = squares(q[part], v) if product else (np.stack([metric(v, one) for one in q[part]]), 0.0)
                if leave_self_out:
                    d[names[part][:, None] == own[None]] = np.inf
                edge = far[part, -1] ** 2 if product else far[part, -1]
                if np.isinf(edge).any() and len(own) > k:
                    edge = np.minimum(edge, np.partition(d, k - 1, axis=1)[:, k - 1] + slack)
                i, j = np.nonzero((d <= edge[:, None] * (1 + 1e-9) + slack) & (d < np.inf))
                exact = np.sqrt(((q[at + i] - v[j]) ** 2).sum(1)) if product else d[i, j]
                keep_nearest(ids, far, at, i, own[j], exact, places, v[j] if carry else None)
        where = np.isfinite(far)
        which, _ = np.nonzero(where)
        columns = {"query": pa.array(names[which]), "neighbour": pa.array(ids[where]), "distance": pa.array(far[where])}
        if carry:
            columns["at"] = pa.FixedSizeListArray.from_arrays(pa.array(places[where].ravel()), max(q.shape[1], 1)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_pydict(columns)

    given = rows.select(F.col(row_id).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v") if carry else F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return given.mapInArrow(top, "query bigint, neighbour bigint, distance double" + (", at array<double>" if carry else ""))


def knn_average(neighbours: DataFrame, y: str, k: int) -> DataFrame:
    """Mean y of the k nearest; null with fewer than k."""
    return neighbours.where(F.col("rank") <= k).groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.avg(y)).alias("estimate"))


def prefix_averages(neighbours: DataFrame, y: str) -> DataFrame:
    """The estimate for every k at once: the running mean over ranks."""
    return neighbours.withColumn("estimate", F.avg(y).over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))


def kernel_average(neighbours: DataFrame, y: str, k: int) -> DataFrame:
    """Epanechnikov weights whose width is the distance of the k-th neighbour; null if that is 0, weights vanish or there are fewer than k."""
    width = F.max(F.when(F.col("rank") == k, F.col("distance"))).over(Window.partitionBy("query"))
    weighted = neighbours.where(F.col("rank") <= k).withColumn("w", kernels.epanechnikov(F.col("distance"), width))
    return weighted.groupBy("query").agg(F.try_divide(F.sum(F.col("w") * F.col(y)), F.sum("w")).alias("estimate"))


def kernel_average_always(neighbours: DataFrame, y: str, k: int, least: float = 1e-10) -> DataFrame:
    """As kernel_average, but a width of 0 becomes `least`, and where all weights vanish (k neighbours at one distance) the first k - 1 weigh the same. Null with fewer than k."""
    w = Window.partitionBy("query")
    width = F.max(F.when(F.col("rank") == k, F.col("distance"))).over(w)
    weighted = neighbours.where(F.col("rank") <= k).withColumn("w", kernels.epanechnikov(F.col("distance"), F.when(width == 0, least).otherwise(width)))
    weighted = weighted.withColumn("w", F.when(F.max("w").over(w) > 0, F.col("w")).when(F.col("rank") < k, 1 / (k - 1)).otherwise(0.0))
    return weighted.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.try_divide(F.sum(F.col("w") * F.col(y)), F.sum("w"))).alias("estimate"))


def gaussian_weights(neighbours: DataFrame, bandwidth: float) -> DataFrame:
    """Weights that sum to 1 for each query; equal ones if all underflow."""
    w = Window.partitionBy("query")
    raw = neighbours.withColumn("raw", kernels.gaussian(F.col("distance"), bandwidth))
    return raw.withColumn("weight", F.coalesce(F.try_divide(F.col("raw"), F.sum("raw").over(w)), 1 / F.count(F.lit(1)).over(w))).drop("raw")


def class_vote(neighbours: DataFrame, label: str, bandwidth: float) -> DataFrame:
    """The class with the largest sum of Gaussian weights; of equal ones the smaller."""
    sums = neighbours.groupBy("query", label).agg(F.sum(kernels.gaussian(F.col("distance"), bandwidth)).alias("s"))
    return sums.groupBy("query").agg(F.min_by(label, F.struct(-F.col("s"), F.col(label))).alias("vote"))


def smooth(neighbours: DataFrame, own: DataFrame, y: str, k: int) -> DataFrame:
    """(own y + y of the k - 1 nearest others) / k."""
    near = neighbours.where(F.col("rank") <= k - 1).groupBy("query").agg(F.sum(y).alias("__s"), F.count(F.lit(1)).alias("__n"))
    return own.join(near, "query").where(F.col("__n") == k - 1).select("query", ((F.col(y) + F.col("__s")) / k).alias("estimate"))


def space2(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Squared metres between (latitude, longitude, ...) rows and one; as numbers.space_distance2."""
    mean = np.radians((rows[:, 0] + one[0]) / 2)
    bend = 1 - numbers.ECC2 * np.sin(mean) ** 2
    north = np.pi * numbers.AXIS * (1 - numbers.ECC2) / 180 / bend**1.5
    east = np.pi * numbers.AXIS / 180 * np.cos(mean) / np.sqrt(bend)
    return ((rows[:, 0] - one[0]) * north) ** 2 + ((rows[:, 1] - one[1]) * east) ** 2


def time2(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Squared years between (latitude, longitude, year, ...) rows and one."""
    return (rows[:, 2] - one[2]) ** 2


def surface(metres_per_year: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distance in space and time, a year being so many metres."""
    return lambda rows, one: np.sqrt(space2(rows, one) + time2(rows, one) * metres_per_year**2)


def places(df: DataFrame) -> DataFrame:
    """id and place: latitude, longitude, year and y (NaN if it is null or missing) of rows with a known place and year."""
    y = F.coalesce(F.col("y").cast("double"), F.lit(float("nan"))) if "y" in df.columns else F.lit(float("nan"))
    known = df.where("lat IS NOT NULL AND lon IS NOT NULL AND year IS NOT NULL")
    return known.select("id", F.array(F.col("lat").cast("double"), F.col("lon").cast("double"), F.col("year").cast("double"), y).alias("place"))


def surface_nearest(queries: DataFrame, rows: DataFrame, k: int, metres_per_year: float) -> DataFrame:
    """query, neighbour, distance, rank of the k nearest rows in space and time; lat, lon, year in both."""
    return nearest(places(queries), places(rows), k, "id", "id", "place", leave_self_out=False, metric=surface(metres_per_year))


def space_time_candidates(queries: DataFrame, rows: DataFrame, max_k: int) -> DataFrame:
    """query, id, space2, time2, y of the max_k nearest rows in space and in time (the union). lat, lon, year, y in both.

    Each task keeps its nearest rows, with their places, for each query.
    """
    asked, given = places(queries), places(rows)
    near = [nearest(asked, given, max_k, "id", "id", "place", leave_self_out=False, metric=m, carry=True).select("query", "neighbour", "at") for m in (space2, time2)]
    both = near[0].unionByName(near[1]).groupBy("query", "neighbour").agg(F.first("at").alias("at"))
    own = asked.select(F.col("id").alias("query"), F.col("place").alias("q"))
    at, q = F.col("at"), F.col("q")
    return both.join(own, "query").select("query", F.col("neighbour").alias("id"), numbers.space_distance2(at[0], at[1], q[0], q[1]).alias("space2"), numbers.time_distance2(at[2], q[2], 1.0).alias("time2"), F.nanvl(at[3], F.lit(None)).alias("y"))


def space_time_nearest(candidates: DataFrame, k: int, metres_per_year: float) -> DataFrame:
    """The k nearest of the candidates with a known y, by space2 + time2 * metres_per_year^2."""
    d2 = F.col("space2") + F.col("time2") * metres_per_year**2
    known = candidates.where("y IS NOT NULL").withColumn("distance", F.sqrt(d2))
    return known.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).where(F.col("rank") <= k)


def local_linear(neighbours: DataFrame, y: str, x: str, at: str, k: int, ridge: float = 1e-3) -> DataFrame:
    """Local linear regression at each query: weighted least squares of y on (1, x) over its k neighbours, ridge on all but the constant.

    x is a neighbour's vector, `at` the query's. A group is the k neighbours of one query.
    """
    width = F.max(F.when(F.col("rank") == k, F.col("distance"))).over(Window.partitionBy("query"))
    rows = neighbours.where(F.col("rank") <= k).withColumn("w", kernels.epanechnikov(F.col("distance"), width)).select("query", F.col(y).alias("y"), F.col(x).alias("x"), F.col(at).alias("at"), "w")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        w, b = pdf["w"].to_numpy(float), np.array(pdf["x"].tolist(), float)
        out = None
        if len(pdf) >= k and np.nansum(w) > 0:
            b = np.column_stack([np.ones(len(b)), b])
            a = b.T @ (b * w[:, None]) + ridge * np.diag([0.0, *[1.0] * (b.shape[1] - 1)])
            beta = np.linalg.lstsq(a, b.T @ (w * pdf["y"].to_numpy(float)), rcond=None)[0]
            out = float(beta @ np.concatenate([[1.0], np.array(pdf["at"].iloc[0], float)]))
        return pd.DataFrame({"query": [pdf["query"].iloc[0]], "estimate": [out]})

    return rows.groupBy("query").applyInPandas(fit, "query bigint, estimate double")


def distance_columns(features: list[str], other: str = "q_") -> Column:
    """Euclidean distance over named columns of two joined rows."""
    return F.sqrt(sum((F.pow(F.col(f) - F.col(other + f), 2) for f in features[1:]), F.pow(F.col(features[0]) - F.col(other + features[0]), 2)))
