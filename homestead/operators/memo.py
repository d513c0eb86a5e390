"""Results kept as tables, used again while their version and arguments are the same."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def remembered(spark: SparkSession, folder: str, name: str, version: str, arguments: dict, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table of an earlier call with the same version and arguments, or that of compute(), which is then kept."""
    key = hashlib.sha256(json.dumps([name, version, arguments], sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder.rstrip('/')}/{name}-{key}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def merged(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of both; a key with two different values is an error."""
    both = old.select(key, value).unionByName(new.select(key, value)).groupBy(key)
    rows = both.agg(F.min(value).alias(value), F.max(value).alias("__high"))
    clash = F.assert_true(F.col(value).eqNullSafe(F.col("__high")), F.lit("two values for one key"))
    return rows.withColumn("__ok", clash).where("__ok IS NULL").drop("__high", "__ok")


def still_to_do(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(done, keys, "left_anti")


def checked_unique(df: DataFrame, key: str, expected: int | None = None) -> DataFrame:
    """df, after a check of its number of rows and of its key."""
    n, distinct = df.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    if n != distinct or expected is not None and n != expected:
        raise ValueError(f"{n} rows, {distinct} keys, {expected} expected")
    return df
