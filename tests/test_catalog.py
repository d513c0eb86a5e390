"""Every query with SQL gives the SQL's rows, in DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from homestead import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return con


def plain(frame):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
            return None
        if isinstance(v, bool) or str(type(v)).endswith("bool'>"):
            return bool(v)
        return round(float(v), 9) + 0.0 if str(type(v).__name__).startswith(("int", "float")) else str(v).replace(" 00:00:00", "")

    return sorted((tuple(one(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", ["space_time_two_stage", "surface_distance_topk"])
def test_queries_beyond_a_block_give_the_same_rows(spark, tmp_path, monkeypatch, name):
    from homestead.operators import neighbors

    spark.range(0, 900).selectExpr("id AS s_suppkey", "CAST(id * 7 % 50 AS DOUBLE) AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    whole = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert whole["query"].nunique() == 9
    monkeypatch.setattr(neighbors, "MAX_QUERIES", 2)
    blocks = catalog.QUERIES[name](spark, str(tmp_path))
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") >= 5  # one for each block
    assert plain(blocks.toPandas()) == plain(whole)


def test_streamed_windows_of_many_unordered_files_equal_the_tables(spark, tmp_path):
    rows = spark.range(0, 240).selectExpr("id", "TIMESTAMP_NTZ'2024-01-01 00:30:00' + make_interval(0, 0, 0, 0, CAST(id * 37 % 240 AS INT)) AS ts", "CONCAT('t', id % 2) AS event_type", "CAST(id AS DOUBLE) AS value")
    rows.unionByName(rows.withColumn("value", rows.value + 10)).repartitionByRange(240, "id").write.parquet(f"{tmp_path}/events.parquet")
    assert sum(f.endswith(".parquet") for f in os.listdir(tmp_path / "events.parquet")) > 200
    streamed, whole = (catalog.QUERIES[name](spark, str(tmp_path)).toPandas() for name in ("hourly_windows_streamed", "hourly_windows"))
    assert len(whole) == 240
    assert plain(streamed) == plain(whole)
