"""The exact nearest neighbours of every row: a join of a table with itself by space partitions.

Rows go to the nearest of a bounded number of pivots; the rows of a pivot, in order of their distance to it, are cut into
chunks of bounded size. A chunk knows its middle, its radius and, for each of its rows, the distance of the k-th nearest
row in the chunk itself: no neighbour can be farther. In the second round a chunk meets only those chunks that triangle
inequalities do not put beyond that distance. A task compares one chunk with a bounded number of others and
keeps the k nearest of each row. Pairs of chunks, not of rows, are what is joined.

Of rows with equal vectors one asks, and the k + 1 of smallest id are found (no more can be neighbours of anything); the
others have the same neighbours. So copies cost nothing, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from homestead.operators.neighbors import keep_nearest, matrix, squares
from homestead.shared import written

#: Rows of a chunk by number and bytes; pivots by number and bytes (they are broadcast); full chunks that one task compares with another; rows compared at once.
CHUNK_ROWS, CHUNK_BYTES = 4096, 4 << 20
PIVOTS, PIVOT_BYTES = 1024, 8 << 20
PART, AT_ONCE = 32, 512


@dataclass
class Plan:
    """listed: id, vector, nth of its copies, rep (the smallest id of the copies). chunks: the packed rows. pairs: chunks that are compared (q, d)."""

    rows: DataFrame
    listed: DataFrame
    chunks: DataFrame
    pairs: DataFrame
    kind: str


def _assign(pivots: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("vector"), kind).astype(float)
            cell = np.empty(len(v), np.int32)
            for at in range(0, len(v), AT_ONCE):
                cell[at : at + AT_ONCE] = squares(v[at : at + AT_ONCE], pivots)[0].argmin(1)
            r = np.sqrt(((v - pivots[cell]) ** 2).sum(1)) if len(v) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(r, pa.float64())], [*b.schema.names, "cell", "r"])

    return run


CHUNKS = "chunk long, cell int, n int, low double, high double, reach double, middle array<double>, radius double, theta double, ids binary, asks binary, thetas binary, vectors binary"


def _pack(k: int, kind: str):
    """Chunks of rows that come in order of cell and distance to its pivot; of each row the distance within which its k + 1 nearest (itself included) lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []

        def chunk(ids, asks, v, cell, r) -> pa.RecordBatch:
            nonlocal nth
            wide = v.astype(float)
            middle = wide.mean(0)
            radius = float(np.sqrt(((wide - middle) ** 2).sum(1).max()))
            thetas = np.full(len(ids), np.inf)
            if len(ids) > k:
                for at in range(0, len(ids), AT_ONCE):
                    d2, slack = squares(wide[at : at + AT_ONCE], wide)
                    thetas[at : at + AT_ONCE] = np.sqrt(np.partition(d2, k, axis=1)[:, k] + slack)
            reach = float(np.partition(r, k)[k]) if len(r) > k else None
            row = {"chunk": part + nth, "cell": int(cell), "n": len(ids), "low": float(r.min()), "high": float(r.max()), "reach": reach, "middle": middle.tolist(), "radius": radius, "theta": float(thetas[asks].max(initial=0))}
            nth += 1
            blobs = {"ids": ids.astype(np.int64).tobytes(), "asks": asks.astype(bool).tobytes(), "thetas": thetas.tobytes(), "vectors": v.tobytes()}
            return pa.RecordBatch.from_pylist([row | blobs], SCHEMA)

        def whole() -> pa.RecordBatch:
            parts = list(zip(*held, strict=True))
            held.clear()
            return chunk(*(np.concatenate(x) for x in parts[:3]), parts[3][0], np.concatenate(parts[4]))

        size, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column("vector"), kind)
            ids, asks, cells, r = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "asks", "cell", "r"))
            most = max(1, min(CHUNK_ROWS, CHUNK_BYTES // max(1, v.shape[1] * v.itemsize)))
            at = 0
            while at < len(ids):
                if held and (cells[at] != last or size >= most):
                    yield whole()
                    size = 0
                last = cells[at]
                end = min(int(np.searchsorted(cells, last, side="right")), at + most - size)
                held.append((ids[at:end], asks[at:end], v[at:end], last, r[at:end]))
                size, at = size + end - at, end
        if held:
            yield whole()

    return run


SCHEMA = pa.schema([("chunk", pa.int64()), ("cell", pa.int32()), ("n", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("reach", pa.float64()), ("middle", pa.list_(pa.float64())), ("radius", pa.float64()), ("theta", pa.float64()), ("ids", pa.binary()), ("asks", pa.binary()), ("thetas", pa.binary()), ("vectors", pa.binary())])


def _cells(pivots: np.ndarray, known: pd.DataFrame):
    """For each chunk that asks, the cells that may hold neighbours of it, the bound on their distance, and the distance of its middle to the cell's pivot."""
    cells, low, high = known["cell"].to_numpy(int), known["low"].to_numpy(float), known["high"].to_numpy(float)
    reach, places = known["reach"].to_numpy(float), pivots[known["cell"].to_numpy(int)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q, middle, radius, theta in zip(b["chunk"], b["middle"], b["radius"], b["theta"], strict=True):
                far = np.sqrt(((places - np.asarray(middle)) ** 2).sum(1))
                bound = min(theta, np.nanmin(far + reach, initial=np.inf) + radius) * (1 + 1e-9)
                near = np.maximum(far - radius - high, low - far - radius) <= bound + 1e-9 * far
                yield pd.DataFrame({"q": q, "cell": cells[near].astype("int32"), "bound": bound, "far": far[near], "q_radius": radius})

    return run


def plan(rows: DataFrame, k: int, row_id: str, vector: str) -> Plan:
    """The chunks and which of them are compared. Rows with a null id, a null vector or a component that is null or NaN take no part; vectors have one length."""
    kind = "f4" if rows.schema[vector].dataType.simpleString() == "array<float>" else "f8"
    plain = rows.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    plain = plain.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    copies = Window.partitionBy("vector")
    listed = plain.withColumn("nth", F.row_number().over(copies.orderBy("id"))).where(F.col("nth") <= k + 1)
    listed = written(listed.withColumn("rep", F.min("id").over(copies)), "neighbour-rows")
    n, width = listed.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    most = max(1, min(PIVOTS, PIVOT_BYTES // max(1, 8 * (width or 1)), -(-n // CHUNK_ROWS)))
    # a share of the rows by a hash of the id, twice as large as needed, so that no task sends many
    some = listed.where("nth = 1").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(min(1 << 30, int((2 * most + 64) / max(n, 1) * (1 << 30)) + 1)))
    found = some.orderBy(F.xxhash64("id"), "id").limit(most).select(F.col("vector").cast("array<double>").alias("v")).toPandas()
    pivots = np.array(found["v"].tolist(), float).reshape(len(found), -1) if len(found) else np.zeros((1, width or 0))
    assigned = listed.select("id", (F.col("nth") == 1).alias("asks"), "vector").mapInArrow(_assign(pivots, kind), f"id long, asks boolean, vector array<{'float' if kind == 'f4' else 'double'}>, cell int, r double")
    lined = assigned.repartitionByRange("cell", "r", "id").sortWithinPartitions("cell", "r", "id")
    chunks = written(lined.mapInArrow(_pack(k, kind), CHUNKS), "neighbour-chunks")
    notes = chunks.select("chunk", "cell", "n", "low", "high", "reach", "middle", "radius", "theta")
    known = notes.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("reach").alias("reach")).toPandas()  # a row for each pivot
    reached = notes.select("chunk", "middle", "radius", "theta").mapInPandas(_cells(pivots, known), "q long, cell int, bound double, far double, q_radius double")
    of = notes.select(F.col("chunk").alias("q"), F.col("middle").alias("q_middle"))
    near = F.greatest(F.col("far") - F.col("high"), F.col("low") - F.col("far")) - F.col("q_radius") <= F.col("bound") + 1e-9 * F.col("far")
    both = reached.join(notes, "cell").where(near).join(of, "q")
    apart = F.sqrt(F.aggregate(F.zip_with("middle", "q_middle", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    pairs = both.where(apart - F.col("radius") - F.col("q_radius") <= F.col("bound") + 1e-9 * apart).select("q", F.col("chunk").alias("d"), "bound")
    return Plan(plain, listed, chunks, written(pairs, "neighbour-pairs"), kind)


class _Rough:
    """Pairs of rows that may lie within given distances of each other, by a matrix product in single precision around the middle of the first rows.

    Rows are scaled to lengths of at most 1; of x and y, x.y - y.y / 2 is at least (x.x - distance^2) / 2 then. The most that rounding takes from it
    is let through, so no pair is lost. Where that can't be told (infinite or vanishing rows) or lets too many through, `pairs` gives None.
    """

    def __init__(self, q: np.ndarray):
        self.middle = q.mean(0)
        x = q - self.middle
        self.xx, self.long = (x * x).sum(1), float(np.sqrt((q * q).sum(1).max()))
        self.scale = self.power(self.xx)
        self.x = np.column_stack([x / self.scale, np.ones(len(x))]).astype("f4") if self.scale else None

    @staticmethod
    def power(squared: np.ndarray) -> float:
        """A power of two that no length exceeds, 0 if there is none that can be reckoned with."""
        most = float(np.sqrt(squared.max()))
        return float(2.0 ** np.ceil(np.log2(most) + 1e-9)) if 1e-100 < most < 1e100 else 0.0

    def meet(self, v: np.ndarray) -> None:
        y = v - self.middle
        yy = (y * y).sum(1)
        other = self.power(yy)
        self.s = max(self.scale, other) if self.scale and other else 0.0
        if self.s:
            self.y = np.column_stack([y / self.s, yy / (-2 * self.s**2)]).astype("f4").T
            self.slack = (v.shape[1] + 8) * 2.0**-23 + 2.0**-48 * max(self.long, float(np.sqrt((v * v).sum(1).max()))) / self.s

    def pairs(self, rows: slice, edge2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray] | None:
        if not self.s or not self.slack < 1:
            return None
        x = self.x[rows] * np.float32(self.scale / self.s)
        x[:, -1] = 1
        near = x @ self.y
        least = np.maximum((self.xx[rows] - edge2) / self.s**2 / 2 - self.slack, -4)
        if np.isinf(edge2).any() and near.shape[1] > k:  # without a bound from the chunk itself
            least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k] - 2 * self.slack)
        found = np.flatnonzero(near >= least.astype("f4")[:, None])
        return np.divmod(found, near.shape[1]) if len(found) <= 8 * k * len(x) else None


def _tile(k: int, kind: str):
    """The k nearest of each asking row of one chunk (role 0) among the rows of some chunks (role 1)."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        own = df[df["role"] == 0].iloc[0]
        names, asks = np.frombuffer(own["ids"], np.int64), np.frombuffer(own["asks"], bool)
        q = np.frombuffer(own["vectors"], kind).reshape(len(names), -1).astype(float)[asks]
        names = names[asks]
        edge2 = np.minimum(np.frombuffer(own["thetas"], float)[asks], own["bound"]) ** 2
        if not len(q):
            return pd.DataFrame({"rep": names, "neighbour": names, "distance": np.empty(0)})
        rough = _Rough(q)
        best_ids, best = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), np.inf)
        for ids, vectors in zip(df["ids"][df["role"] == 1], df["vectors"][df["role"] == 1], strict=True):
            ids = np.frombuffer(ids, np.int64)
            v = np.frombuffer(vectors, kind).reshape(len(ids), -1).astype(float)
            rough.meet(v)
            for at in range(0, len(q), AT_ONCE):
                rows = slice(at, at + AT_ONCE)
                edge = np.minimum(edge2[rows], best[rows, -1] ** 2)
                found = rough.pairs(rows, edge * (1 + 1e-9), k)
                if found is None:
                    d2, slack = squares(q[rows], v)
                    if np.isinf(edge).any() and len(ids) > k:
                        edge = np.minimum(edge, np.partition(d2, k - 1, axis=1)[:, k - 1] + slack)
                    found = np.nonzero(d2 <= edge[:, None] * (1 + 1e-9) + slack)
                i, j = found
                keep_nearest(best_ids, best, at, i, ids[j], np.sqrt(((q[at + i] - v[j]) ** 2).sum(1)))
        r, c = np.nonzero(np.isfinite(best))
        return pd.DataFrame({"rep": names[r], "neighbour": best_ids[r, c], "distance": best[r, c]})

    return run


def nearest_of_all(rows: DataFrame, k: int, row_id: str, vector: str, planned: Plan | None = None) -> DataFrame:
    """query, neighbour, distance, rank (from 1): the k nearest other rows of every row; ties go to the smaller id. ids are unique.

    Euclidean distance in double. What takes part: see `plan`.
    """
    p = planned or plan(rows, k, row_id, vector)
    parts = max(1, -(-(p.chunks.agg(F.sum("n")).first()[0] or 0) // (PART * CHUNK_ROWS)))  # by rows, since chunks may be small
    pairs = p.pairs.withColumn("part", F.pmod(F.xxhash64("d"), F.lit(parts)).cast("int"))
    given = pairs.join(p.chunks, pairs["d"] == p.chunks["chunk"]).select("q", "part", F.lit(1).alias("role"), "bound", "ids", F.lit(None).cast("binary").alias("asks"), F.lit(None).cast("binary").alias("thetas"), "vectors")
    asking = pairs.groupBy("q", "part").agg(F.min("bound").alias("bound"))
    asking = asking.join(p.chunks, asking["q"] == p.chunks["chunk"]).select("q", "part", F.lit(0).alias("role"), "bound", "ids", "asks", "thetas", "vectors")
    found = given.unionByName(asking).groupBy("q", "part").applyInPandas(_tile(k + 1, p.kind), "rep long, neighbour long, distance double")
    first = Window.partitionBy("rep").orderBy("distance", "neighbour")
    top = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    top = top.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))  # k + 1
    full = p.listed.where(F.col("nth") == k + 1).select("vector", "rep", F.col("id").alias("last"))
    members = p.listed.select("id", "rep")
    if not full.isEmpty():  # more copies than were listed
        members = members.unionByName(p.rows.join(full, "vector").where("id > last").select("id", "rep"))
    own = members.join(top, "rep").select(F.col("id").alias("query"), F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k).alias("near"))
    return own.select("query", F.posexplode("near").alias("r", "n")).select("query", "n.neighbour", "n.distance", (F.col("r") + 1).alias("rank"))
