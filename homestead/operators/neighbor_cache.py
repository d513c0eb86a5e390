"""Neighbours kept in shards: a table whose estimates need no shuffle, and whose shards are replaced one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from homestead.shared import shared_dir, written


def shard_of(query: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(query), F.lit(shards)).cast("int")


def keep(neighbours: DataFrame, name: str, shards: int = 16, buckets: int = 64, path: str | None = None) -> DataFrame:
    """The table `name` of neighbours (query, rank and what else they have, such as the neighbour's value), in a folder for each shard.

    Rows of one query are in one bucket, in order of rank, in each shard. The folder is a new one in the shared folder, if none is named.
    """
    spark = neighbours.sparkSession
    rows = neighbours.withColumn("shard", shard_of(F.col("query"), shards)).repartition(buckets, "query")
    rows.write.format("parquet").partitionBy("shard").bucketBy(buckets, "query").sortBy("query", "rank").option("path", path or shared_dir(spark, name)).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def replace(spark: SparkSession, name: str, neighbours: DataFrame, shards: int = 16, buckets: int = 64) -> DataFrame:
    """The table after the shards that the new rows belong to were replaced by them; other shards are not touched."""
    columns = [c for c in spark.table(name).columns if c != "shard"]
    rows = written(neighbours.withColumn("shard", shard_of(F.col("query"), shards)), "neighbour-shards")
    for (shard,) in rows.select("shard").distinct().orderBy("shard").collect():  # as many as there are shards
        part = rows.where(F.col("shard") == shard).select(*columns).repartition(buckets, "query")
        spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (shard = {shard}) SELECT * FROM {{part}}", part=part)
    return spark.table(name)


def shards_complete(table: DataFrame, shards: int, k: int) -> DataFrame:
    """shard, queries, rows and whether each query of it has the ranks 1 to k once; a shard without rows is missing."""
    each = table.groupBy("query", "shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rank").alias("ranks"), F.max("rank").alias("most"))
    found = each.groupBy("shard").agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("rows"), F.min(((F.col("n") == k) & (F.col("ranks") == k) & (F.col("most") == k)).cast("int")).alias("whole"))
    expected = table.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    return expected.join(found, "shard", "left").select("shard", F.coalesce("queries", F.lit(0)).alias("queries"), F.coalesce("rows", F.lit(0)).alias("rows"), (F.coalesce("whole", F.lit(0)) == 1).alias("complete"))


def estimates(table: DataFrame, y: str, k: int) -> DataFrame:
    """query and the mean y of its k nearest (null with fewer): sums inside buckets, without a shuffle."""
    return table.where(F.col("rank") <= k).groupBy("query").agg(F.when(F.count(y) >= k, F.avg(y)).alias("estimate"))
