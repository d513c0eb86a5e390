"""Windowed statistics over a stream of events."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file."""
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str, late: str | None = "1 hour", slide: str | None = None) -> DataFrame:
    """window_start, event_type, n, mean_value; for streams and tables."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    out = rows.groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "mean_value")


def to_table(stats: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All windows of what is in the source now, in their last state, as a table.

    Without a watermark no event is late and every window comes out. Each batch writes the windows that it changed to a
    folder of its own, which a batch that is run again replaces; of a window the row of its last batch holds.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stats.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    spark, keys = stats.sparkSession, ["window_start", "event_type"]
    try:
        states = spark.read.parquet(path)
    except AnalysisException as error:  # no batch, as the source has no rows
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], stats.schema)
    last = states.groupBy(*keys).agg(F.max_by(F.struct("n", "mean_value"), "batch").alias("last"))
    return last.select(*keys, "last.n", "last.mean_value")
