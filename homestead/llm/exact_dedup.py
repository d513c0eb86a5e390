"""Exact deduplication with disk-backed streaming state.

Arrivals (id, row number, SHA-256 of the text, its length and the text itself) are kept in the shared folder, a folder for each
run. They go through a Structured Streaming aggregation keyed by digest. Its state lives in RocksDB on disk, is checkpointed
in the shared folder and never expires, so later arrivals meet all earlier ones. For each digest it
keeps the identifier of the row that stays and the locator (run and row number) of the content that came first. Digests that occur more
than once are hits: the full texts of the new rows and those that the locators name are read and compared byte for byte before anything is
dropped; texts that differ under one digest form groups of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homestead.llm.common import free_name, plain_text, shared_dir, small, table, written

#: State on disk in RocksDB; its files take the room they fill, and commits write changes, not snapshots; memory is bounded for each executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    # state of a stream that has ended leaves the executors' memory soon
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class ExactDeduplicator:
    """Keyed state over any number of arrivals; a folder of its own below the shared one, or `home`, where an earlier one's state is taken up.

    Of equal texts the row with the largest id stays, and of rows with equal text and id the one of
    the last run with the largest row number. A null text is the empty text, and empty texts are equal to each other. A
    null id is smaller than any other. Only the id and text columns are read.
    """

    def __init__(self, spark: SparkSession, home: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000):
        self.spark, self.home, self.id_col, self.text_col, self.digest = spark, home or shared_dir(spark, "dedup"), id_col, text_col, digest
        self.files_per_batch = files_per_batch

    def runs(self) -> list[int]:
        """The runs whose arrivals are complete."""
        top = self._path("arrivals")
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = files.listStatus(top) if files.exists(top) else []
        names = [s.getPath().getName() for s in found]
        return sorted(int(n.removeprefix("run=")) for n in names if n.startswith("run=") and self._exists(f"arrivals/{n}/_SUCCESS"))

    def add(self, docs: DataFrame, run: int | None = None) -> DataFrame:
        """Takes in docs and returns a row for each: run, uid (row number in the run), id, digest, n_bytes, keep_id, keep_run, keep_uid, group_size, kept.

        The decisions hold against all rows that were added so far. A call that was cut off is made good by another one with its
        number: arrivals of a run that are complete are not taken in twice.
        """
        done = self.runs()
        run = max(done, default=-1) + 1 if run is None else run
        text = plain_text(F.col(self.text_col))
        rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(self.id_col).alias("id"), self.digest(text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
        if run not in done:
            rows.write.mode("overwrite").parquet(f"{self.home}/arrivals/run={run}")
        self._advance(self._stored().schema)
        fresh, decisions = self._stored().where(F.col("run") == run), self._decisions()
        clashes = self._clashes(fresh, decisions, run)
        joined = fresh.drop("text").join(decisions.drop("first"), "digest")
        if not clashes.isEmpty():
            joined = joined.join(clashes, "digest", "left_anti").unionByName(self._by_text(clashes).where(F.col("run") == run))
        same = (F.col("run") == F.col("keep.run")) & (F.col("uid") == F.col("keep.uid"))
        return joined.select("run", "uid", "id", "digest", "n_bytes", F.col("keep.id").alias("keep_id"), F.col("keep.run").alias("keep_run"), F.col("keep.uid").alias("keep_uid"), "group_size", same.alias("kept"))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")

    def _exists(self, name: str) -> bool:
        path = self._path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _stored(self) -> DataFrame:
        """All arrivals: run, uid, id, digest, n_bytes, text."""
        return self.spark.read.option("basePath", f"{self.home}/arrivals").parquet(f"{self.home}/arrivals").withColumn("run", F.col("run").cast("int"))

    def _advance(self, schema: T.StructType) -> None:
        """Runs the stream over the arrivals that it has not seen yet. It does not read their texts."""
        spark, old = self.spark, {k: self.spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():
            spark.conf.set(k, v)
        try:
            stream = spark.readStream.schema(schema).option("basePath", f"{self.home}/arrivals").option("maxFilesPerTrigger", self.files_per_batch).parquet(f"{self.home}/arrivals/*")
            state = stream.groupBy("digest").agg(F.max(F.struct("id", "run", "uid")).alias("keep"), F.min(F.struct("run", "uid")).alias("first"), F.count(F.lit(1)).alias("group_size"))
            put = lambda rows, n: rows.write.mode("overwrite").parquet(f"{self.home}/decisions/batch={n}")
            query = state.writeStream.outputMode("update").option("checkpointLocation", f"{self.home}/state").foreachBatch(put).trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for k, v in old.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def _decisions(self) -> DataFrame:
        """The last decision of each digest."""
        schema = "digest binary, keep struct<id: bigint, run: int, uid: bigint>, first struct<run: int, uid: bigint>, group_size bigint"
        rows = self.spark.read.option("basePath", f"{self.home}/decisions").parquet(f"{self.home}/decisions") if self._exists("decisions") else self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
        if rows.select("batch").distinct().count() <= 1:
            return rows.drop("batch")
        last = rows.groupBy("digest").agg(F.max_by(F.struct("keep", "first", "group_size"), "batch").alias("last"))
        return written(last.select("digest", "last.keep", "last.first", "last.group_size"), "decisions")

    def _clashes(self, fresh: DataFrame, decisions: DataFrame, run: int) -> DataFrame:
        """Digests of different texts, found now or before: the new rows' texts are compared with the one that came first. Map-side combining makes one row of many copies."""
        hits = written(decisions.where("group_size > 1").join(fresh.select("digest").distinct(), "digest", "left_semi").select("digest", "first.run", "first.uid"), "hits")
        own = fresh.join(small(hits.select("digest")), "digest", "left_semi").select("digest", "text")
        runs = [r.run for r in hits.select("run").distinct().collect()]
        first = self._stored().where(F.col("run").isin(runs)).join(small(hits), ["digest", "run", "uid"], "left_semi").select("digest", "text")
        texts = own.unionByName(first).groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"))
        differ = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
        differ.write.mode("overwrite").parquet(f"{self.home}/clashes/run={run}")
        return self.spark.read.schema(differ.schema).parquet(f"{self.home}/clashes/run=*").distinct()

    def _by_text(self, clashes: DataFrame) -> DataFrame:
        """The rows of clashing digests, grouped by the text itself."""
        rows = written(self._stored().join(clashes, "digest", "left_semi"), "clashing")
        groups = rows.groupBy("digest", "text").agg(F.max(F.struct("id", "run", "uid")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        return rows.join(groups, ["digest", "text"]).select("digest", "run", "uid", "id", "n_bytes", "keep", "group_size")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: run, uid, id, digest, n_bytes, keep_id, keep_run, keep_uid, group_size, kept."""
    return ExactDeduplicator(docs.sparkSession, id_col=id_col, text_col=text_col, digest=digest).add(docs)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that an equal text with a larger id makes superfluous; same columns.

    Ids need not be unique: rows are met again by id and digest. Of rows with equal text and equal id one stays.
    """
    decisions = written(decide(docs, id_col, text_col), "decisions")
    gone = decisions.where("NOT kept AND NOT (id <=> keep_id)")
    repeats = decisions.where("NOT kept AND id <=> keep_id").isEmpty()
    key, ident = free_name(docs, "digest"), free_name(docs, "gone")
    gone = small(written(gone.select(F.col("digest").alias(key), F.col("id").alias(ident)).distinct(), "gone"))
    keyed = docs.withColumn(key, sha256(plain_text(F.col(text_col))))
    out = keyed.join(gone, (keyed[key] == gone[key]) & keyed[id_col].eqNullSafe(gone[ident]), "left_anti")
    return (out if repeats else out.dropDuplicates([key])).drop(key)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for every row of documents. Null texts are empty and equal to each other, a null id is smaller than any other; see `decide`. Other columns are not read."""
    rows = decide(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "n_bytes")


SQL = """
SELECT d.doc_id, max(d.doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       d.doc_id = max(d.doc_id) OVER w AS kept, sha256(coalesce(d.text, '')) AS text_sha256,
       CAST(octet_length(encode(coalesce(d.text, ''))) AS BIGINT) AS n_bytes
FROM documents d WINDOW w AS (PARTITION BY coalesce(d.text, ''))
"""
