"""Neighbours of all rows, their cache, latest earlier rows and searches of settings against plain loops."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from homestead.operators import joins, neighbor_cache, neighbor_join, neighbors, search


def plain_neighbours(ids, v, k):
    out = {}
    for i, q in zip(ids.tolist(), v, strict=True):
        d = np.sqrt(((v - q) ** 2).sum(1))
        order = [x for x in np.lexsort((ids, d)) if ids[x] != i][:k]
        out[i] = [(int(ids[x]), round(float(d[x]), 9)) for x in order]
    return out


@pytest.mark.parametrize("copies", [False, True])
def test_neighbours_of_all_rows(spark, monkeypatch, copies):
    """Clustered rows, so that few pairs of chunks are left; with copies a third of all rows are alike."""
    monkeypatch.setattr(neighbor_join, "CHUNK_ROWS", 60)
    rng = np.random.default_rng(4)
    ids = rng.permutation(1500).astype(np.int64)
    v = (rng.normal(0, 30, (15, 4))[rng.integers(0, 15, 1500)] + rng.normal(0, 1, (1500, 4))).round(0 if copies else 3)
    if copies:
        v[:500] = v[0]
    df = spark.createDataFrame(pd.DataFrame({"i": ids, "v": v.tolist()})).repartition(5)
    odd = spark.createDataFrame([(None, [1.0, 1.0, 1.0, 1.0]), (9001, None), (9002, [1.0, None, 1.0, 1.0]), (9003, [float("nan")] * 4)], df.schema)
    planned = neighbor_join.plan(df.unionByName(odd), 5, "i", "v")
    got: dict = {}
    for r in neighbor_join.nearest_of_all(df, 5, "i", "v", planned).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["neighbour"], round(r["distance"], 9)))
    assert got == plain_neighbours(ids, v, 5)
    sizes = planned.chunks.select("chunk", "n")
    compared = planned.pairs.join(sizes.select(F.col("chunk").alias("q"), F.col("n").alias("a")), "q").join(sizes.select(F.col("chunk").alias("d"), F.col("n").alias("b")), "d").agg(F.sum(F.col("a") * F.col("b"))).first()[0]
    assert compared < 0.25 * len(ids) ** 2
    assert sizes.agg(F.max("n")).first()[0] <= 60


@pytest.mark.parametrize("case", ["plain", "afar", "tiny", "huge", "infinite", "near copies"])
def test_chunks_are_compared_in_single_precision_without_loss(monkeypatch, case):
    """Vectors without clusters need no distances in double but those of pairs that pass; odd ones have them all, with the same neighbours."""
    rng = np.random.default_rng(6)
    v = rng.normal(0, 1, (900, 24))
    v = {"afar": v + 1e9, "tiny": v * 1e-150, "huge": v * 1e120, "near copies": v[:1] + v * 1e-7}.get(case, v)
    if case == "infinite":
        v[[3, 700], 2] = np.inf
    ids = rng.permutation(900).astype(np.int64)
    blobs = [{"role": role, "bound": np.inf, "ids": ids[at : at + 300].tobytes(), "asks": np.ones(300, bool).tobytes(), "thetas": np.full(300, np.inf).tobytes(), "vectors": v[at : at + 300].tobytes()} for role, at in ((0, 0), (1, 0), (1, 300), (1, 600))]
    whole = []
    monkeypatch.setattr(neighbor_join, "squares", lambda *a: whole.append(1) or neighbors.squares(*a))
    with np.errstate(all="ignore"):
        got = neighbor_join._tile(4, "f8")(pd.DataFrame(blobs)).groupby("rep")[["neighbour", "distance"]].agg(list)
        assert case != "plain" or not whole
        for i, q in zip(ids[:300].tolist(), v[:300], strict=True):
            d = np.sqrt(((v - q) ** 2).sum(1))
            order = [x for x in np.lexsort((ids, d)) if np.isfinite(d[x])][:4]
            assert not order and i not in got.index or [*got.loc[i, "neighbour"]] == ids[order].tolist() and [*got.loc[i, "distance"]] == d[order].tolist()


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "i long, v array<double>")
    assert [tuple(r) for r in neighbor_join.nearest_of_all(df, 3, "i", "v").orderBy("query").collect()] == [(1, 2, 5.0, 1), (2, 1, 5.0, 1)]
    assert neighbor_join.nearest_of_all(df.where("i = 1"), 3, "i", "v").count() == 0
    assert neighbor_join.nearest_of_all(df.limit(0), 3, "i", "v").count() == 0


def test_shards_are_replaced_and_estimates_need_no_shuffle(spark):
    rows = spark.range(200).select(F.col("id").alias("query"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rank")).withColumn("y", (F.col("query") * 10 + F.col("rank")).cast("double"))
    table = neighbor_cache.keep(rows, "kept_neighbours", 4, 8)
    try:
        new = rows.where(neighbor_cache.shard_of(F.col("query"), 4) == 2).withColumn("y", F.lit(0.0))
        table = neighbor_cache.replace(spark, "kept_neighbours", new, 4, 8)
        assert table.count() == 800
        estimates = neighbor_cache.estimates(table, "y", 3)
        assert "Exchange" not in estimates._jdf.queryExecution().executedPlan().toString()
        fresh = {r[0] for r in new.select("query").distinct().collect()}
        assert fresh and {r["query"]: r["estimate"] for r in estimates.collect()} == {q: 0.0 if q in fresh else q * 10 + 2.0 for q in range(200)}
        assert {(r["shard"], r["complete"]) for r in neighbor_cache.shards_complete(table, 4, 4).collect()} == {(s, True) for s in range(4)}
        assert [r["complete"] for r in neighbor_cache.shards_complete(table.where("shard <> 1"), 4, 4).orderBy("shard").collect()] == [True, False, True, True]
    finally:
        spark.sql("DROP TABLE kept_neighbours")


@pytest.mark.parametrize("strict", [True, False])
def test_latest_earlier_rows(spark, strict):
    """A hot key with a third of all rows, ties, nulls, rows asked twice and a tolerance."""
    lot = random.Random(8)
    day = lambda n: dt.date(2001, 1, 1) + dt.timedelta(days=n)
    given = [(lot.choice([1, 1, 1, *range(2, 9), None]), lot.choice([day(lot.randint(0, 400)), None] + [day(lot.randint(0, 400))] * 8), i, lot.choice([None, float(i)])) for i in range(900)]
    asked = [(i, lot.choice([1, 1, 1, *range(2, 12), None]), lot.choice([None] + [day(lot.randint(-10, 500))] * 8)) for i in range(600)]
    asked += asked[:5]
    left = spark.createDataFrame(asked, "n int, k int, at date").repartition(4)
    right = spark.createDataFrame(given, "k int, at date, i int, v double").repartition(3)
    got = joins.as_of(left, right, "k", "at", ["i", "v"], ["i"], F.expr("INTERVAL 30 DAY"), strict, slices=8)
    assert got.columns == ["n", "k", "at", "prior_i", "prior_v", "prior_at"]
    expected = []
    for n, k, at in asked:
        best = [(a, -i, v) for kk, a, i, v in given if kk == k is not None and a and at and (a < at if strict else a <= at)]
        a, i, v = max(best, key=lambda r: r[:2]) if best else (None, None, None)
        near = best and a >= at - dt.timedelta(days=30)
        expected.append((n, k, at, -i if near else None, v if near else None, a if near else None))
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got.collect()) == order(expected)
    assert joins.as_of(left, right.limit(0), "k", "at", ["i"]).where("prior_i IS NOT NULL").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__s" in plan  # windows are dealt by key and slice


def test_settings_are_tried_in_one_pass(spark):
    lot = random.Random(2)
    rows = [(q, i, lot.choice([None, float(lot.randint(1, 50))]), float(lot.randint(0, 9)), float(lot.randint(0, 4))) for q in range(6) for i in range(lot.choice([2, 12]))]
    df = spark.createDataFrame(rows, "query long, id long, y double, space2 double, time2 double")
    settings = spark.createDataFrame([(1, 0.0), (3, 0.5), (3, 2.0), (9, 1.0)], "k int, metres double")
    got = {(r["query"], r["k"], r["metres"]): (r["average"], r["kernel"]) for r in search.tried(df, settings).collect()}
    for (q, k, m), (average, kernel) in got.items():
        near = sorted((s + t * m * m, i, y) for qq, i, y, s, t in rows if qq == q and y is not None)[:k]
        if len(near) < k:
            assert average is None and kernel is None
            continue
        w = [max(0.0, 1 - d / near[-1][0]) if near[-1][0] else None for d, _, _ in near]
        total = sum(w) if w[0] is not None else 0
        assert average == pytest.approx(sum(y for *_, y in near) / k)
        assert kernel == (pytest.approx(sum(x * y for x, (_, _, y) in zip(w, near, strict=True)) / total) if total else None)
    assert len(got) == 4 * len({r[0] for r in rows if r[2] is not None})
    plan = search.searched(df, settings, df.groupBy("query").agg(F.max("y").alias("actual")))
    assert plan.columns == ["k", "metres", "model", "rmse", "within", "coverage"] and plan.count() == 8


def test_neighbours_carry_their_places(spark):
    rows = spark.createDataFrame([(i, 30 + i / 10, -118.0, 2000.0 + i % 3, float(i) if i % 2 else None) for i in range(30)], "id long, lat double, lon double, year double, y double")
    found = neighbors.space_time_candidates(rows.where("id = 4"), rows, 3)
    assert {(r["id"], r["y"]) for r in found.collect()} >= {(4, None), (3, 3.0), (5, 5.0)}
