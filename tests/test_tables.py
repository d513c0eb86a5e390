"""Dictionaries, completion, scans that count, files of several kinds of records, typed tables and fits against plain versions."""

from __future__ import annotations

import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from homestead import catalog
from homestead.operators import aggregates, comparison, completion, dictionary, neighbors, resampling
from homestead.sources import delimited, observed, typed_table


def test_dictionaries_are_kept_and_extended(spark):
    df = spark.createDataFrame([(1, "b", 10), (2, "a", None), (3, None, 30), (4, "b", 20)], "i int, c string, n int")
    known = dictionary.dictionary(df, ["c", "n"])
    assert {(r["column"], r["value"]): (r["code"], r["n"]) for r in known.collect()} == {("c", "a"): (1, 1), ("c", "b"): (2, 2), ("n", "10"): (1, 1), ("n", "20"): (2, 1), ("n", "30"): (3, 1)}
    later = spark.createDataFrame([(1, "a", 30), (2, "z", 10), (3, None, 7), (4, "aa", 7)], "i int, c string, n int")
    order = lambda d: [tuple(r) for r in d.orderBy("i").collect()]
    assert order(dictionary.coded(later, known, ["c", "n"]).select("i", "c_code", "n_code")) == [(1, 1, 3), (2, None, 1), (3, None, None), (4, None, None)]
    assert order(dictionary.coded(later, known, ["c", "n"], "zero").select("i", "c_code", "n_code")) == [(1, 1, 3), (2, 0, 1), (3, None, 0), (4, 0, 0)]
    more = dictionary.extended(known, later, ["c", "n"])
    assert order(dictionary.coded(later, more, ["c", "n"]).select("i", "c_code", "n_code")) == [(1, 1, 3), (2, 4, 1), (3, None, 4), (4, 3, 4)]
    coded = dictionary.coded(later, more, ["n"]).select("i", "n_code")
    assert order(dictionary.decoded(coded, more, "n", "n_code", "int").select("i", "n")) == [(1, 30), (2, 10), (3, 7), (4, 7)]
    assert dictionary.dictionary(df.limit(0), ["c"]).count() == 0


def test_values_are_joined_where_the_dictionary_is_large(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "SMALL_ROWS", 1)
    df = spark.createDataFrame([(i, f"v{i % 7}") for i in range(50)], "i int, c string")
    assert {r["c_code"] for r in dictionary.coded(df, dictionary.dictionary(df, ["c"]), ["c"]).collect()} == set(range(1, 8))


def test_cells_of_a_completion_are_not_sent_through_the_driver(spark, monkeypatch):
    """A few stored rows stand for many cells; by Spark's estimate of their size one side of each join would be sent to all tasks."""
    monkeypatch.setattr(dictionary, "SMALL_ROWS", 20)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    rows = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("m"), F.col("c_acctbal").alias("price"), F.lit(40.0).alias("estimate"))
    made = plan(completion.errors(rows, rows, "c_custkey", "m"))
    assert "SortMergeJoin" in made and "BroadcastHashJoin" not in made
    known = dictionary.dictionary(rows, ["c_custkey", "m"])
    assert "BroadcastHashJoin" not in plan(dictionary.coded(rows, known, ["c_custkey"])) and "BroadcastHashJoin" in plan(dictionary.coded(rows, known, ["m"]))
    # all joins of the query: by number of a dictionary or of the solver, none of a cell
    joins = re.findall(r"(?:BroadcastHashJoin|SortMergeJoin) \[([^]]*)\]", plan(catalog.QUERIES["completed_errors"](spark, "/root/testdata/sf0.001")))
    assert joins and not [j for j in joins if "parcel" in j and "month" in j]


def test_completion_finds_a_matrix_of_known_rank(spark):
    """Keys of ten digits; a third of the cells is not known; settings are compared on the same cells."""
    lot = random.Random(1)
    u, v = [[lot.uniform(1, 3), lot.uniform(-1, 1)] for _ in range(40)], [[lot.uniform(1, 3), lot.uniform(-1, 1)] for _ in range(15)]
    cells = [(9_000_000_000 + 7 * i, f"m{j}", u[i][0] * v[j][0] + u[i][1] * v[j][1], lot.random() < 0.67) for i in range(40) for j in range(15)]
    df = spark.createDataFrame(cells, "parcel long, month string, value double, known boolean")
    fitted = completion.complete_matrix(df.where("known"), "parcel", "month", "value", rank=2, ridge=1e-4, iterations=20)
    rows = fitted.transform(df).collect()
    assert len(rows) == 600 and statistics.mean(abs(r["prediction"] - r["value"]) for r in rows if not r["known"]) < 0.05
    found = {(r["rank"], r["cells"]): r["rmse"] for r in completion.completion_search(df.where("known"), "parcel", "month", "value", [1, 2], [1e-4], iterations=20).collect()}
    assert len({n for _, n in found}) == 1 and found[2, next(iter(found))[1]] < 0.5 * found[1, next(iter(found))[1]]
    assert fitted.transform(spark.createDataFrame([(5, "m1")], "parcel long, month string")).count() == 0
    twice = spark.createDataFrame([(1, "a", 5.0, 2), (1, "a", 3.0, 1), (1, "a", None, 0), (None, "a", 1.0, 0)], "r long, c string, v double, o int")
    assert [tuple(r) for r in completion.first_cells(twice, "r", "c", "v", "o").collect()] == [(1, "a", 3.0)]


def test_completion_does_not_depend_on_its_first_start(spark):
    """On these customers the first start of the solver ends far from the best fit."""
    assert catalog.QUERIES["completed_errors"](spark, "/root/testdata/sf0.1").where("close").count() == 180_000


def test_held_out_cells_that_no_learned_cells_determine_are_told_apart(spark):
    """One row has a single learned cell; at rank 2 nothing says what its others are."""
    k, m = F.col("k"), F.col("m")
    df = spark.range(1, 301).withColumnRenamed("id", "k").withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("v", ((1 + k % 7) * (10 + m) + (k % 5) * (m % 4) * 5).cast("double"))
    lot = completion.sampling.uniform(F.concat_ws(":", k.cast("string"), m.cast("string")), 1)
    one = df.where((lot < 0.2) & (k % 5 > 1)).groupBy("k").count().orderBy(F.desc("count"), "k").first()["k"]
    first = df.where(k == one).where(lot >= 0.2).agg(F.min("m")).first()[0]
    rows = completion.completion_search(df.where((k != one) | (lot < 0.2) | (m == first)), "k", "m", "v", [2], [1e-4], iterations=20).collect()
    assert rows[0]["cells"] == df.where(lot < 0.2).count() and rows[0]["rmse_determined"] < 0.1 and rows[0]["rmse_determined"] < rows[0]["rmse"]


def test_held_out_cells_whose_learned_cells_lie_in_one_direction_are_told_apart(spark):
    """One row has two learned cells, of months that are multiples of one another at rank 2: as good as a single one."""
    k, m = F.col("k"), F.col("m")
    df = spark.range(1, 301).withColumnRenamed("id", "k").withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("v", ((1 + k % 7) * (10 + m) + (k % 5) * (m % 4) * 5).cast("double"))
    lot = completion.sampling.uniform(F.concat_ws(":", k.cast("string"), m.cast("string")), 1)
    flat = m % 4 == 0
    learned = df.groupBy("k").agg(F.count_if(flat & (lot >= 0.2)).alias("n"), F.count_if(~flat & (lot < 0.2)).alias("open"), F.collect_set(F.when(flat & (lot < 0.2), m)).alias("flat_held"))
    one, n_open = learned.where((F.col("n") == 2) & (k % 5 > 1) & (F.size("flat_held") == 1)).orderBy(F.desc("open"), "k").select("k", "open").first()
    rows = completion.completion_search(df.where((k != one) | (lot < 0.2) | flat), "k", "m", "v", [1, 2], [1e-4], iterations=20).collect()
    held = df.where(lot < 0.2).count()
    found = {r["rank"]: r for r in rows}
    assert n_open > 0 and {r["cells"] for r in rows} == {held} and {r["determined"] for r in rows} == {held - n_open}  # the held-out multiple is determined
    assert found[2]["rmse_determined"] < 0.1 < found[2]["rmse"] and found[1]["rmse_determined"] > 1


def test_scans_count_and_write_rejects_beside_in_one_pass(spark, tmp_path):
    lines = ["1\t2.5\tx", "2\t\ty", "3\tz\tx", "4\t1", "", "5\t9.0\tx\t", "6\t50\tx", "7\t1\t"]
    (tmp_path / "in.txt").write_text("\n".join(lines) + "\n")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("scan", "scan")
    good, bad, counts = observed.checked_scan(spark, str(tmp_path / "in.txt"), "k long, p double, c string", {"cheap": F.coalesce(F.col("p"), F.lit(0)) < 10, "code": F.col("c").isNotNull()})
    assert len(jobs.getJobIdsForGroup("scan")) == 1
    spark.sparkContext.setJobGroup("other", "other")
    assert sorted(map(tuple, good.collect())) == [(1, 2.5, "x"), (2, None, "y")]
    assert {r["line"]: r["reason"] for r in bad.collect()} == {"3\tz\tx": "p", "4\t1": "fields", "": "fields", "5\t9.0\tx\t": "fields", "6\t50\tx": "cheap", "7\t1\t": "code"}
    assert counts["lines"] == 8 and counts["kept"] == 2 and counts["rejected"] == 6 and counts["rejected by fields"] == 3 and counts["rejected by k"] == 0
    assert observed.report(spark, {"scan": counts}).where("metric = 'rejected by cheap'").first()["value"] == 1


def test_groups_of_records_survive_any_split_of_their_files(spark, tmp_path):
    """Texts with tabs, line ends, backslashes and things that look like records; files are read in pieces of a few bytes."""
    lot = random.Random(4)
    odd = ["plain", "a\tb", "line\nA\t7", "back\\slash \\t", "", None, "\r\n", "B\tx", "ü\\", "\\N"]
    parents = [(i, lot.choice(odd)) for i in range(60)]
    b = [(lot.randint(0, 70), j, lot.choice(odd)) for j in range(200)]
    left, right = spark.createDataFrame(parents, "k int, name string"), spark.createDataFrame(b, "k int, j int, note string")
    observed.write_groups(left.repartition(3), {"B": right, "C": right.where("j < 0")}, "k", str(tmp_path / "g"))
    for size in ("64b", "1000b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = observed.read_groups(spark, str(tmp_path / "g"), "k int, name string", {"B": "j int, note string", "C": "j int, note string"})
            got = {r["k"]: (r["name"], sorted((x["j"], x["note"]) for x in r["B"]), r["C"]) for r in rows.collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == {k: (name, sorted((j, n) for kk, j, n in b if kk == k), []) for k, name in parents}, size
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_records_are_numbered_over_splits(spark, tmp_path):
    for i, n in enumerate((300, 0, 57)):
        (tmp_path / f"f{i}.txt").write_text("k\tv\n" + "".join(f"{i * 1000 + j}\t{'NA' if j % 9 == 0 else j / 2}\n" for j in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        rows = delimited.read_numbered(spark, [str(tmp_path / f"f{i}.txt") for i in range(3)], "k long, v double").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 357 and all(r["k"] == (r["file_number"] - 1) * 1000 + r["record_number"] - 1 for r in rows)
    assert all((r["v"] is None) == ((r["record_number"] - 1) % 9 == 0) and r["file_name"] == f"f{r['file_number'] - 1}.txt" for r in rows)


def test_typed_tables_are_split_and_filtered_in_the_source(spark, tmp_path):
    rows = [(f"name {i}\t{i}" if i % 3 else None, i / 4, float(i), "no") for i in range(500)]
    typed_table.write_typed_table(spark.createDataFrame(rows, "n string, x double, y double, z string").coalesce(2), str(tmp_path / "t"))
    df = typed_table.read_typed_table(spark, str(tmp_path / "t"), "tmvx", ["n", "x", "y", "z"], splitBytes="700")
    assert df.columns == ["n", "x", "y"] and df.rdd.getNumPartitions() > 8
    assert sorted(map(tuple, df.collect()), key=lambda r: r[2]) == [r[:3] for r in rows]
    some = df.where("x >= 100 AND y < 450 AND n IS NOT NULL")
    assert {r["y"] for r in some.collect()} == {i for i in range(400, 450) if i % 3}
    assert df.where(F.col("n") == "name 7\t7").count() == 1 and df.where("length(n) > 11").count() == sum(len(r[0]) > 11 for r in rows if r[0])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter \(", plan)
    with pytest.raises(Exception, match="does not fit"):
        typed_table.read_typed_table(spark, str(tmp_path / "t"), "tq", ["a", "b"]).count()


def test_resamples_of_one_small_file_are_dealt_over_tasks(spark):
    rows = spark.range(0, 100, 1, 1).select(F.col("id").alias("__k"), F.col("id").cast("double").alias("__v"))
    assert resampling._resampled(rows, 50).rdd.getNumPartitions() >= 4
    own = rows.select(resampling.poisson_weight(resampling.sampling.digits(F.col("__k"), 3)).alias("w"), resampling.sampling.uniform(F.col("__k"), 3).alias("u")).collect()
    cuts = [sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(8)]
    assert [r["w"] for r in own] == [sum(r["u"] >= c for c in cuts) for r in own]


def test_distribution_functions(spark):
    one = spark.createDataFrame([(z,) for z in (-9.0, -3.0, -0.5, 0.0, 1.0, 2.5, 7.5, 9.0)], "z double")
    for r in one.select("z", resampling.normal_cdf(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(statistics.NormalDist().cdf(r["z"]), abs=1e-12)
    for p in (0.001, 0.3, 0.5, 0.95):
        assert one.limit(1).select(resampling.normal_quantile(F.lit(p)).alias("z")).first()["z"] == pytest.approx(statistics.NormalDist().inv_cdf(p), abs=1e-9)
    x = spark.createDataFrame([(0.7, 0.1), (1.0, 2.0), (3.0, 2.5), (3.0, 40.0), (20.0, 31.0)], "a double, x double")
    for r in x.select("a", "x", resampling.log_gamma(F.col("a") + 1).alias("l"), resampling.gamma_cdf(F.col("x"), F.col("a")).alias("p")).collect():
        steps = 200_000
        area = sum(math.exp((r["a"] - 1) * math.log(r["x"] * (i + 0.5) / steps) - r["x"] * (i + 0.5) / steps) for i in range(steps)) * r["x"] / steps / math.gamma(r["a"])
        assert r["l"] == pytest.approx(math.lgamma(r["a"] + 1), abs=1e-10) and r["p"] == pytest.approx(area, abs=2e-3 if r["a"] < 1 else 1e-6)


def test_distribution_functions_of_many_rows(spark):
    df = spark.range(0, 400).select(((F.col("id") - 200) / 20).alias("z"), (F.col("id") / 4).alias("x"), F.lit(2.3).alias("a"))
    z, x, a = F.col("z"), F.col("x"), F.col("a")
    off = df.agg(F.max(F.abs(resampling.normal_cdf(z) - resampling.many_normal_cdf(z))), F.max(F.abs(resampling.gamma_cdf(x, a) - resampling.many_gamma_cdf(x, a)))).first()
    assert max(off) < 1e-12


def test_empirical_distributions(spark):
    df = spark.createDataFrame([(x,) for x in (2.0, 1.0, 2.0, 5.0, None, float("nan"))], "x double")
    assert [tuple(r) for r in resampling.empirical(df, "x").orderBy("value").collect()] == [(1.0, 1, 0.0, 0.25), (2.0, 2, 0.25, 0.75), (5.0, 1, 0.75, 1.0)]
    lot = random.Random(6)
    fits = spark.createDataFrame([(lot.lognormvariate(3, 0.5),) for _ in range(3000)], "x double")
    far = {r["distribution"]: r["distance"] for r in resampling.fit_distances(fits, "x").collect()}
    assert far["lognormal"] < 0.03 < far["weibull"]


def test_estimates_compared(spark):
    actual = spark.createDataFrame([(1, "2001-07-04", 1.0), (2, "2001-02-01", 1.0), (3, "2001-02-01", 1.0), (4, "2001-02-01", 1.0), (5, "1999-02-01", 1.0), (6, "2001-02-01", None)], "k int, d string, p double").withColumn("d", F.col("d").cast("date"))
    first = spark.createDataFrame([(1, "2001-08-15", 1.05), (2, "2001-02-15", 1.5), (3, "2001-02-15", 1.2)], "k int, day string, estimate double").withColumn("day", F.col("day").cast("date"))
    second = spark.createDataFrame([(1, "2001-08-15", 1.5), (2, "2001-02-15", 1.1)], "k int, day string, estimate double").withColumn("day", F.col("day").cast("date"))
    grid = F.make_date(F.year("d"), F.quarter("d") * 3 - 1, F.lit(15))
    r = comparison.compared(actual, first, second, "k", "day", "p", F.year("d") > 2000, grid).first()
    assert tuple(r)[:9] == (5, 1, 0, 1, 1, 2, 1, 1, 0)
    assert r["first_rmse"] == pytest.approx(math.sqrt((0.05**2 + 0.5**2) / 2)) and (r["first_within"], r["second_within"]) == (0.5, 0.0)


def test_kernel_averages_that_always_answer_and_bare_columns(spark):
    near = spark.createDataFrame([(1, 1, 0.0, 4.0), (1, 2, 0.0, 8.0), (1, 3, 0.0, 9.0), (2, 1, 2.0, 4.0), (2, 2, 2.0, 8.0), (2, 3, 2.0, 9.0), (3, 1, 1.0, 4.0)], "query int, rank int, distance double, y double")
    got = {r["query"]: r["estimate"] for r in neighbors.kernel_average_always(near, "y", 3).collect()}
    assert got == {1: 7.0, 2: 6.0, 3: None}  # a width of 0 gives all the same weight; vanishing weights go to the first two
    assert tuple(aggregates.with_bare(near, [F.count(F.lit(1)).alias("n")], ["rank", "y"], ["query", "rank"]).first()) == (1, 4.0, 7)
    assert aggregates.with_bare(near.limit(0), [F.count(F.lit(1)).alias("n")], ["y"], ["rank"]).count() == 0


def test_quantiles_beside_other_aggregates(spark):
    df = spark.createDataFrame([(i % 3 if i % 10 else None, float(i * 37 % 101)) for i in range(300)] + [(7, None)], "g int, x double")
    shares = {"low": 0.1, "mid": 0.5}
    ways = [aggregates.with_quantiles(df, ["g"], "x", shares, F.count("x").alias("n"), gathered=g, at_most=a) for g, a in ((1000, 301), (1000, None), (5, None))]
    rows = [sorted(map(tuple, w.select("g", "low", "mid", "n").collect()), key=repr) for w in ways]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 5
