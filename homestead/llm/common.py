"""Helpers shared by the training-text operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homestead.shared import shared_dir, written

__all__ = ["ascii_lower", "first_by_hash", "free_name", "plain_text", "released", "shared_dir", "short_batches", "small", "table", "written"]

#: A side of a join is broadcast only when it was measured and has no more rows and bytes than this.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


#: Rows of text and their bytes that go to a Python worker at once.
TEXTS_AT_ONCE, BYTES_AT_ONCE = "2000", "16m"


def short_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session sends rows to Python workers in batches that hold long texts within memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_AT_ONCE)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_AT_ONCE)
    return df


def first_by_hash(ids: DataFrame, id_col: str, rows: int) -> DataFrame:
    """At most `rows` of the distinct ids, those of the smallest hashes. A first cut by the hash leaves about twice as many, so that tasks don't each send that many to one."""
    n, lot = ids.count(), F.pmod(F.xxhash64(id_col), F.lit(1 << 30))
    few = ids.where(lot < min(1 << 30, int((2 * rows + 200) / max(n, 1) * (1 << 30)) + 1))
    return few.orderBy(lot, F.xxhash64(id_col), id_col).limit(rows)


def released() -> None:
    """Hands memory that a Python worker has freed back to the system, since workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(field: T.StructField, c: Column) -> Column:
    """About the bytes that a value takes."""
    t = field.dataType
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(t, T.ArrayType):
        inner = t.elementType
        each = 8 * (len(inner.fields) if isinstance(inner, T.StructType) else 1)
        if isinstance(inner, T.StringType):
            return F.coalesce(F.aggregate(c, F.lit(0), lambda n, x: n + F.octet_length(x) + 16), F.lit(0))
        return F.coalesce(F.size(c), F.lit(0)) * each + 16
    return F.lit(16)


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows and their measured bytes are within the limits, else as it is. df is a written table."""
    if not df.columns:
        return df
    rows, size = df.agg(F.count(F.lit(1)), F.sum(sum((_bytes(f, F.col(f"`{f.name}`")) for f in df.schema.fields[1:]), _bytes(df.schema.fields[0], F.col(f"`{df.columns[0]}`"))).cast("long"))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def plain_text(c: str | Column = "text") -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
