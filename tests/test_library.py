"""Library functions on small inputs with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from homestead.functions import dates, kernels, keys, numbers, vectors
from homestead.functions.codes import CodeTable
from homestead.operators import aggregates, frame, joins, memo, models, neighbors, validation, validity
from homestead.plans import observations
from homestead.sources import delimited


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_keys(spark):
    rows = spark.createDataFrame([("123", "1-23"), ("4-56", None), (None, "7-89"), ("12x", "1-23"), ("x56", None)], "u string, f string").coalesce(1)
    assert column(rows, keys.digits_key(F.col("u"), F.col("f"))) == [123, 456, 789, 123, None]
    rows = spark.createDataFrame([("111", "1-23"), ("2-2x", "2-22"), (None, "3-33"), (None, None)], "u string, f string").coalesce(1)
    assert column(rows, keys.number_key(F.col("u"), F.col("f"))) == [111, 222, 333, None]
    rows = spark.createDataFrame([("12-3", "123x"), ("12 3", "123x"), ("1-  __ 2-3", "123x")], "u string, f string").coalesce(1)
    assert column(rows, keys.padded_key(F.col("u"), F.col("f"))) == ["0000000123"] * 3


def test_dates(spark):
    rows = spark.createDataFrame([("20110830x", "20110915"), ("2011-08-30", "20110915"), ("20001200", None)], "s string, r string").coalesce(1)
    assert column(rows, dates.choose_day(F.col("s"), F.col("r"))) == [dt.date(2011, 9, 15), dt.date(2011, 8, 30), dt.date(2000, 12, 1)]
    days = spark.createDataFrame([(dt.date(1900, 1, 1),), (dt.date(1900, 3, 1),), (dt.date(1900, 12, 31),)], "d date").coalesce(1)
    assert column(days, dates.days_since_1900(F.col("d"))) == [0, 59, 364]
    one = spark.createDataFrame([(dt.date(2009, 1, 16), dt.date(2009, 12, 10))], "a date, b date")
    assert one.select(dates.quarter_index(F.col("a"), 1984), dates.month_index(F.col("b"), 1984), dates.mid_quarter(F.col("a")), dates.nearest_mid_quarter(F.col("b"))).first()[:] == (101, 312, dt.date(2009, 2, 15), dt.date(2009, 11, 15))


def test_scores_and_kernels(spark):
    rows = spark.createDataFrame([(float(x),) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "x double").coalesce(1)
    z = column(numbers.z_scores(rows, ["x"]), "x_z")
    assert (z[0], z[-1]) == (-1.5, 2.0)
    three = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double").coalesce(1)
    assert column(numbers.z_scores(three, ["x"], population=False), "x_z") == [-1, 0, 1]
    near = spark.createDataFrame([(1, float(d), d, 1.0) for d in (1, 2, 3, 4)], "query int, distance double, rank int, y double").coalesce(1)
    w = column(near, kernels.epanechnikov(F.col("distance"), 3.0))
    assert [round(x, 3) for x in w] == [0.667, 0.417, 0, 0]
    assert column(near, kernels.epanechnikov(F.col("distance"), 0.0)) == [None] * 4
    assert neighbors.knn_average(near, "y", 5).first().estimate is None and neighbors.kernel_average(near, "y", 3).first().estimate == 1


def test_surface_distance(spark):
    rows = spark.createDataFrame([(30.0, -150.0, 2010.0), (31.0, -150.0, 2010.0), (30.0, -151.0, 2010.0), (30.0, -150.0, 2011.0)], "lat double, lon double, year double").coalesce(1)
    got = column(rows, numbers.surface_distance(F.col("lat"), F.col("lon"), F.col("year"), F.lit(30.0), F.lit(-150.0), F.lit(2010.0), 1000.0))
    assert all(abs(a - b) < 1 for a, b in zip(got, (0, 110861, 96486, 1000), strict=True))


def test_errors(spark):
    rows = spark.createDataFrame([(10.0, 11.0), (20.0, 21.0), (30.0, 31.0), (40.0, None)], "a double, e double")
    assert rows.agg(aggregates.rmse(F.col("a"), F.col("e"))).first()[0] == 1
    rows = spark.createDataFrame([(1.0, 1.05), (2.0, 20.0), (3.0, None)], "a double, e double")
    assert rows.agg(aggregates.within(F.col("a"), F.col("e"))).first()[0] == 0.5


def test_merges(spark):
    x = spark.createDataFrame([(i, f"x{i}") for i in range(1, 6)], "id int, value string")
    y = spark.createDataFrame(list(zip((1, 3, 6, 7, 8), (f"y{i}" for i in range(1, 6)), strict=True)), "id int, value string")
    out = joins.merge(x, y, "id", "id")
    assert out.columns == ["x id", "x value", "y id", "y value"] and sorted(map(tuple, out.collect())) == [(1, "x1", 1, "y1"), (3, "x3", 3, "y2")]
    a = spark.createDataFrame([(1.0, "first", 1), (1.0, "second", 2), (float("nan"), "n", 3)], "k double, v string, o int")
    b = spark.createDataFrame([(1.0, "early", 1), (1.0, "late", 2), (float("nan"), "n", 3)], "k double, w string, p int")
    assert [(r.v, r.w, r.key) for r in joins.merge_first_last(a, b, "k", "k", F.col("o"), F.col("p"), "key").collect()] == [("first", "late", 1.0)]


def test_nearest_day_takes_the_earlier_of_two(spark):
    days = spark.createDataFrame([(dt.date(2001, 1, 3),), (dt.date(1990, 1, 1),), (dt.date(2020, 1, 1),)], "d date")
    marks = spark.createDataFrame([(dt.date(2001, 1, 1),), (dt.date(2001, 1, 5),), (dt.date(2003, 1, 1),)], "m date")
    got = {r.d: r.nearest for r in joins.nearest_day(days, "d", marks, "m").collect()}
    assert got == {dt.date(2001, 1, 3): dt.date(2001, 1, 1), dt.date(1990, 1, 1): dt.date(2001, 1, 1), dt.date(2020, 1, 1): dt.date(2003, 1, 1)}


def test_frames(spark):
    rows = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "i int, c string")
    assert {(r.i, r.code) for r in frame.first_seen_codes(rows, "c", ["i"]).collect()} == {(1, 1), (2, 2), (3, None), (4, 1)}
    assert sorted(column(frame.drop_all_duplicates(rows, ["c"]), "i")) == [2]
    assert sorted(column(frame.every_nth(rows, ["i"], 2, 2), "i")) == [2, 4]
    good, rest = frame.split_rows(rows, F.col("c") == "b")
    assert good.count() + rest.count() == 4 and rest.count() == 2
    assert frame.kinds(rows) == {"i": "number", "c": "string"} and frame.equal_frames(rows, rows)
    with pytest.raises(ValueError, match="no such"):
        frame.drop_columns(rows, ["zz"], must_exist=True)
    a, b = frame.bernoulli_split(rows, 0.3, 1)
    assert a.count() + b.count() == 4


def test_validity(spark):
    rows = spark.createDataFrame([("2001-02-03", "3"), ("x", "3"), ("2001-02-03", "9"), (None, "9")], "d string, n string")
    rules = validity.field_rules({"d": "date", "n": "long in [1, 5]"})
    assert sorted(str(r.reason) for r in validity.with_reason(rows, rules).collect()) == ["None", "d: date", "d: date", "n: long in [1, 5]"]
    assert validity.valid(rows, rules).count() == 1
    kept, rejected = observations.with_rejects(rows, rules)
    assert (kept.count(), rejected.count()) == (1, 3)


def test_vectors_and_codes(spark):
    one = spark.createDataFrame([([1.0, 2.0, 2.0], [3.0, 0.0, 1.0], "b", None)], "a array<double>, b array<double>, c string, n string")
    a, b = F.col("a"), F.col("b")
    got = one.select(vectors.dot(a, b), vectors.euclidean(a, a), vectors.p_distance(a, b, 1), vectors.argmax(a), vectors.with_bias(a), vectors.kronecker(F.slice(a, 1, 2), F.slice(b, 1, 2)), vectors.without(a, F.lit(2))).first()
    assert got[:] == (5.0, 0.0, 5.0, 2, [1.0, 1.0, 2.0, 2.0], [3.0, 0.0, 6.0, 0.0], [1.0, 2.0])
    table = CodeTable({"x": ("a", "b"), "y": ("c",)})
    assert one.select(table.has(F.col("c"), "x"), table.has(F.col("n"), "x"), table.name(F.col("c"))).first()[:] == (True, False, "x")


def test_models(spark):
    rows = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(20)], "x double, y double")
    assert models.least_squares(rows, "y", ["x"]).coefficients[0] == pytest.approx(2)
    assert models.forward_stepwise(rows.withColumn("z", F.lit(1.0) * F.col("x") % 3), "y", ["z", "x"])[0][0] == "x"
    near = spark.createDataFrame([(1, i + 1, float(i + 1), 2.0 * v[0] + v[1], v, [0.5, 0.5]) for i, v in enumerate([[0.0, 1.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0], [2.0, 1.0]])], "query int, rank int, distance double, y double, x array<double>, at array<double>")
    assert neighbors.local_linear(near, "y", "x", "at", 5, 1e-9).first().estimate == pytest.approx(1.5, abs=1e-3)
    low = models.bootstrap_difference(spark.createDataFrame([("a", 1.0), ("b", 0.0)] * 50, "g string, v double"), "g", "a", "b", "v", 50).first()
    assert low.difference == low.low == low.high == 1


def test_validation_and_memo(spark, tmp_path):
    assert validation.grid(spark, k=[1, 2], l=[0.5]).count() == 2
    calls = []
    compute = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert memo.remembered(spark, str(tmp_path), "r", "1", {"k": 2}, compute).count() == 3
    assert len(calls) == 1
    old, new = spark.createDataFrame([(1, 5)], "k int, v int"), spark.createDataFrame([(1, 6)], "k int, v int")
    with pytest.raises(Exception, match="two values"):
        memo.merged(old, new, "k", "v").collect()
    with pytest.raises(ValueError, match="keys"):
        memo.checked_unique(old.union(old), "k")


def test_delimited_files(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('a,b,c\n1,"x, ""y""",NA\n2.5,,z\n')
    (tmp_path / "unnamed.csv").write_text('a,b,\n1,"x, ""y""",NA\n2.5,,z\n')
    typed = delimited.read_delimited(spark, str(path), "a double, b string, c string")
    assert sorted(map(str, typed.collect())) == sorted(["Row(a=1.0, b='x, \"y\"', c=None)", "Row(a=2.5, b=None, c='z')"])
    inferred = delimited.read_inferred(spark, str(tmp_path / "unnamed.csv"))
    assert inferred.columns == ["a", "b", "V 3"] and dict(inferred.dtypes)["a"] == "double"
    with pytest.raises(Exception, match="(?i)cast"):
        delimited.read_delimited(spark, str(path), "a double, b double, c string").collect()
    assert delimited.read_delimited(spark, str(path), "a double, b double, c string", strict=False).where("b IS NULL").count() == 2
    delimited.write_delimited(spark.createDataFrame([(1.0, None), (float("nan"), "q")], "a double, b string").coalesce(1), str(tmp_path / "out"))
    back = delimited.read_delimited(spark, str(tmp_path / "out"), "a double, b string").collect()
    assert sorted(map(str, back)) == ["Row(a=1.0, b=None)", "Row(a=None, b='q')"]


def test_pairs_captures_and_headers(spark, tmp_path):
    (tmp_path / "p.txt").write_text("k1\tv1\tx\nk2\tv2\n")
    assert sorted(map(tuple, delimited.read_pairs(spark, str(tmp_path / "p.txt")).collect())) == [("k1", "v1\tx"), ("k2", "v2")]
    assert delimited.read_captures(spark, str(tmp_path / "p.txt"), r"k(\d)\tv(\d)$", ["a", "b"]).collect()[0][:] == ("2", "2")
    (tmp_path / "h.txt").write_text("one\ttwo\n")
    assert delimited.read_with_header_file(spark, str(tmp_path / "p.txt"), str(tmp_path / "h.txt")).columns == ["one", "two"]
    (tmp_path / "c.csv").write_text("some title\nid,n\n1,2\n3,4\n")
    assert sorted(map(tuple, delimited.read_after_lines(spark, str(tmp_path / "c.csv"), 2, 2).collect())) == [("1", "2"), ("3", "4")]
