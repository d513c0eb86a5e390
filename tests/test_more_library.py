"""Positions at scale, splits and draws, codes, resampling, imputation and small matrices."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from homestead import shared
from homestead.functions import codes, vectors
from homestead.operators import aggregates, frame, imputation, models, resampling, sampling, validation, validity
from homestead.sources import delimited


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("partitions", ["8", "64", "211"])
def test_ordinals_of_many_rows_are_exact_when_written(spark, tmp_path, adaptive, partitions):
    n = 300_000
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        rows = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        frame.global_ordinal(rows, ["k"]).write.parquet(f"{tmp_path}/placed")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    placed = spark.read.parquet(f"{tmp_path}/placed")
    assert placed.count() == n and placed.where("ordinal = k + 1").count() == n


def test_running_totals_and_quantiles_are_exact(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit(2).alias("v"))
    assert frame.running_total(rows, ["k"], "v").where("total = 2 * (k + 1)").count() == 1000
    values = np.random.default_rng(1).integers(0, 500, 777) / 4
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    got = frame.quantiles(df, "x", {"a": 0.5, "b": 0.99, "c": 0.0, "d": 1.0}).first()
    assert [got.a, got.b, got.c, got.d] == pytest.approx([np.quantile(values, q) for q in (0.5, 0.99, 0, 1)])
    assert frame.quantiles(df.where("x < 0"), "x", {"a": 0.5}).first().a is None
    freq = aggregates.frequencies(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string"), "c").collect()
    assert {(r.value, r.n, r.cumulative) for r in freq} == {(None, 1, 0.25), ("a", 1, 0.5), ("b", 2, 1.0)}
    assert validity.positive_not_huge(df, "x", 0.5).count() == int(((values > 0) & (values <= np.quantile(values, 0.5))).sum())
    assert validation.strata(df.where("x IS NOT NULL"), "x").where("stratum = 'rich'").count() == int((values > 2 * np.median(values)).sum())


def test_splits_do_not_depend_on_partitions(spark):
    rows = spark.range(2000)
    a = {(r.id, r.part) for r in sampling.labelled(rows.repartition(7), "id", {"x": 0.3, "y": 0.7}, 5).collect()}
    assert a == {(r.id, r.part) for r in sampling.labelled(rows.coalesce(1), "id", {"x": 0.3, "y": 0.7}, 5).collect()}
    assert 500 < sum(p == "x" for _, p in a) < 700
    parts = sampling.exact_parts(rows.limit(11), "id", {"x": 0.3, "y": 0.2, "z": 0.5}).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"x": 3, "y": 2, "z": 6}
    assert sorted(r.place for r in sampling.permuted(rows, "id").collect()) == list(range(1, 2001))
    assert sampling.sample_rows(rows, "id", 10).count() == 10 and sampling.sample_rows(rows.limit(4), "id", 10).count() == 4
    again = sampling.sample_again(rows.limit(5), "id", 300).collect()
    assert len(again) == 300 and {r.id for r in again} == set(range(5))
    assert sampling.sample_again(rows.limit(0), "id", 3).count() == 0


def test_draws_have_their_moments(spark):
    u, v = sampling.uniform(F.col("id"), 1), sampling.uniform(F.col("id"), 2)
    got = spark.range(20_000).agg(F.avg(u), F.avg(sampling.gaussian(u, v, 3.0, 2.0)), F.stddev(sampling.gaussian(u, v, 3.0, 2.0)), F.avg(sampling.exponential(u, 4.0)), F.avg(sampling.geometric(u, 0.25)), F.avg(sampling.bernoulli(u, 0.4)), F.min(sampling.whole(u, 2, 5)), F.max(sampling.whole(u, 2, 5)), F.percentile(sampling.cauchy(u, 1.0), 0.5), F.percentile(sampling.log_normal(u, v, 1.0), 0.5)).first()
    assert list(got) == pytest.approx([0.5, 3, 2, 0.25, 4, 0.4, 2, 5, 1, np.e], rel=0.05)


def test_code_books(spark, tmp_path):
    rows = spark.createDataFrame([("G", 650, 12), ("CD", 665, 51), (None, 666, None), ("??", None, 26)], "deed string, use long, kind long").coalesce(1)
    assert [r.name for r in codes.named(rows, "deed", codes.DEEDS, "name").collect()] == ["grant.deed", "correction.deed", "unknown code", "unknown code"]
    got = rows.select(codes.any_school(F.col("use")), codes.any_residential(F.col("kind")), codes.PROPERTIES.has(F.col("kind"), "any.industrial"), codes.PROPERTIES.has(F.col("kind"), "retail.or.service")).collect()
    assert [tuple(r) for r in got] == [(True, True, False, False), (True, False, True, False), (False, False, False, False), (False, False, False, True)]
    (tmp_path / "uses.tsv").write_text("650\tschool\n163\tsingle family\n651\tschool\n")
    uses = codes.read_codes(spark, str(tmp_path / "uses.tsv"), ranges={"any.school": codes.SCHOOLS})
    assert [r[0] for r in rows.select(uses.has(F.col("use"), "any.school")).collect()] == [True, True, False, False]
    assert [r[0] for r in rows.select(uses.name(F.col("use"))).collect()] == ["school", None, None, None]


def test_field_tables_and_sale_rules(spark):
    rows = spark.createDataFrame([("20000300", "Y", "3"), ("2000-03-05", "", "003"), ("19780101", "N", "1"), ("20000305", "Q", "1")], "day string, flag string, kind string")
    got = validity.recoded(rows, {"day": ("date fixed in [1979,2009]", "date fix"), "flag": ("Y N space empty", "Y N space empty indicator"), "kind": ("string", "new construction indicator")})
    assert sorted(tuple(r) for r in got.collect()) == [("20000301", "1", "1"), ("20000305", "0", "1")]
    sales = spark.createDataFrame([(1e5, "G", None, 1), (9e7, "G", None, 1), (1e5, "Q", None, 1), (1e5, "T", "M", 1), (1e5, "T", None, 2)], "p double, d string, m string, n long")
    rules = validity.sale_rules({"price": "p", "deed": "d", "multi_flag": "m", "multi_count": "n"})
    assert sorted(str(r.reason) for r in validity.with_reason(sales, rules).collect()) == ["None", "deed", "multi_flag", "multi_flag", "price"]


def test_resampling(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], float(i % 2) * 5 + i % 7) for i in range(400)] + [(999, "a", None)], "k long, g string, v double")
    far = resampling.difference_significance(rows, "k", "g", "a", "b", "v", 200).first()
    assert far.observed == pytest.approx(-5, abs=0.1) and far.probability == 0
    near = resampling.difference_significance(rows.withColumn("v", F.col("k") % 7), "k", "g", "a", "b", "v", 200).first()
    assert near.probability > 0.1
    mean = resampling.mean_interval(rows, "k", "v", 400).first()
    assert mean.low < mean.mean < mean.high and mean.high - mean.low == pytest.approx(2 * 1.645 * 3.2 / 20, rel=0.25)


def test_distribution_fits(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(float(x),) for x in rng.lognormal(2, 0.5, 4000)], "x double")
    fits = {r.distribution: (r["first"], r.second) for r in resampling.fitted_distributions(rows, "x").collect()}
    assert fits["lognormal"] == pytest.approx((2, 0.5), rel=0.05)
    rows = spark.createDataFrame([(float(x),) for x in rng.gamma(3, 1 / 2, 4000)], "x double")
    assert next((r["first"], r.second) for r in resampling.fitted_distributions(rows, "x").collect() if r.distribution == "gamma") == pytest.approx((3, 2), rel=0.1)


def test_local_imputation(spark):
    x, y = np.array([[0.0, 0], [0, 1], [1, 0], [1, 1]]), np.array([1, 1, 2, 3])
    for at, want in zip(x, y, strict=True):
        assert np.array([1, 2, 3])[np.argmax(imputation.logistic_at(x, y, np.ones(4), at, np.array([1, 2, 3]), ridge=0.001))] == want
    rows = spark.createDataFrame([(1, [0.1, 0.0], [0.0, 0.0], 7, 1.0), (1, [0.0, 0.1], [0.0, 0.0], 7, 1.0), (1, [5.0, 5.0], [0.0, 0.0], 8, 1.0), (1, [5.0, 5.2], [0.0, 0.0], 8, 1.0), (2, None, [1.0, 1.0], 3, 1.0), (3, [1.0, 1.0], [1.0, 1.0], 4, 0.0), (3, [2.0, 1.0], [1.0, 1.0], 5, 2.0)], "query long, x array<double>, at array<double>, y long, w double")
    for fit in (imputation.naive_bayes_at, imputation.logistic_at):
        assert {r.query: r.predicted for r in imputation.impute(rows, "x", "at", "y", "w", fit).collect()} == {1: 7, 2: None, 3: 5}


def test_small_and_sparse_matrices(spark):
    one = spark.createDataFrame([([[4.0, 2.0], [2.0, 3.0]], [1.0, 2.0], {"b": 1, "a": 2}, {"b": 3}, "/x/y.tar.gz"), ([[1.0, 2.0], [2.0, 1.0]], [0.0, 0.0], {}, {"c": 1}, "name")], "m array<array<double>>, v array<double>, p map<string,int>, q map<string,int>, f string").coalesce(1)
    got = one.select(vectors.times_vector(F.col("m"), F.col("v")), vectors.times_matrix(F.col("m"), F.col("m")), vectors.cholesky_solved(F.col("m"), F.col("v")), vectors.all_zero(F.col("v")), vectors.has_nan(F.col("v")), vectors.sorted_keys(F.col("p")), vectors.merged_maps(F.col("p"), F.col("q")), *vectors.path_parts(F.col("f"))).collect()
    assert got[0][0] == [8, 8] and got[0][1] == [[20, 14], [14, 13]]
    assert got[0][2].solution == pytest.approx(np.linalg.solve([[4, 2], [2, 3]], [1, 2])) and got[0][2].logdet == pytest.approx(np.log(8)) and got[1][2].solution is None
    assert [g[3:] for g in got] == [(False, False, ["a", "b"], {"a": 2, "b": 3}, "/x", "y.tar", "gz"), (True, False, [], {"c": 1}, "", "name", "")]
    a = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (1, 1, 3.0)], "i int, j int, v double")
    assert {tuple(r) for r in vectors.sparse_product(a, a).collect()} == {(0, 0, 4.0), (0, 1, 5.0), (1, 1, 9.0)}


def test_index_models_and_made_up_sales(spark, tmp_path):
    index = spark.createDataFrame([(2008, m, 100.0 + m) for m in range(1, 13)], "year int, month int, level double")
    now = models.extrapolated_index(index, 2008, 4)
    assert now.first().level == pytest.approx(113)
    sales = spark.createDataFrame([(1, dt.date(2008, 2, 3), 1, 10.2), (1, dt.date(2008, 1, 3), 2, 5.0), (2, dt.date(2007, 1, 1), 3, 1.0)], "apn long, day date, id long, price double")
    got = {r.apn: r.estimate for r in models.index_model(spark.createDataFrame([(1,), (2,), (3,)], "apn long"), sales, index, "apn", "day", ["id"], "price", now).collect()}
    assert got[1] == pytest.approx(10.2 * 113 / 102) and got[2] is None and got[3] is None
    (tmp_path / "index.csv").write_text("".join(f"title {i}\n" for i in range(6)) + "Date,Level\nJan 2008,101\nFeb-2008,102.5\nMar 2008,\n")
    assert sorted(tuple(r) for r in delimited.read_month_index(spark, str(tmp_path / "index.csv")).collect()) == [(2008, 1, 101.0), (2008, 2, 102.5)]
    made = models.synthetic_sales(spark, 100, 20, "2003-01-01", {"intercept": 10.0, "land": 2.0, "latitude": 1.0, "has_pool": 500.0}, spread=0.01)
    fit = models.least_squares(made, "true_value", ["land", "latitude", "has_pool"])
    assert list(fit.coefficients) == pytest.approx([2, 1, 500], rel=1e-4) and made.where("recorded = date_add(day, 14)").count() == 2000
    shape, model = models.by_formula(made.withColumn("c", F.when(F.col("has_pool") == 1, "yes").otherwise("no")), "true_value ~ land + c")
    assert model.coefficients[0] == pytest.approx(2, rel=1e-3)


def test_lines_that_equal_skipped_ones_stay(spark, tmp_path):
    (tmp_path / "c.csv").write_text("1,2\nid,n\n1,2\n3,4\n1,2\nid,n\n")
    assert sorted(map(tuple, delimited.read_after_lines(spark, str(tmp_path / "c.csv"), 2, 2).collect())) == [("1", "2"), ("1", "2"), ("3", "4"), ("id", "n")]


def test_shared_folder_is_asked_for_off_one_machine():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: "spark://host:7077" if key == "spark.master" else default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session, "x")


def test_tables_hypotheses_and_replaced_columns(spark):
    name = "made_by_test"
    assert delimited.create_table_as(spark.range(3), name).count() == 3
    spark.sql(f"DROP TABLE {name}")
    losses = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("b", 0.7)], "model string, loss double")
    assert validation.is_best(losses, "model", "loss", "b").first()[1:] == (True, "b") and not validation.is_best(losses, "model", "loss", "a").first().passed
    assert frame.replaced(losses, {"loss": F.col("loss") * 2}).agg(F.max("loss")).first()[0] == 2
    with pytest.raises(ValueError, match="no such"):
        frame.replaced(losses, {"day": F.lit(1)})
    places = spark.createDataFrame([(2,), (2,), (9,)], "p long")
    assert [r.model for r in frame.rows_at(losses, ["loss"], places, "p").collect()] == ["b", "b"]


def test_nearest_of_many_rows_and_ties(spark, monkeypatch):
    from homestead.operators import neighbors

    rng = np.random.default_rng(2)
    points = rng.integers(0, 6, (3000, 2))
    rows = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(points.tolist())] + [(9999, None)], "id long, v array<double>")
    got = neighbors.nearest(rows.where("id % 500 = 0 OR id = 9999"), rows, 7, "id", "id", "v").collect()
    for q in range(0, 3000, 500):
        far = np.sqrt(((points - points[q]) ** 2).sum(1)).astype(float)
        far[q] = np.inf
        assert [r.neighbour for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)] == np.lexsort((np.arange(3000), far))[:7].tolist()
    assert len(got) == 42


def test_group_quantiles_are_the_same_gathered_and_ranked(spark):
    rng = np.random.default_rng(5)
    rows = [(None if g == 3 else g, "ab"[g % 2], None if g == 4 else float(x)) for g in range(5) for x in rng.integers(0, 40, 50 + g)]
    df = spark.createDataFrame(rows, "g int, h string, x double").repartition(5)
    shares = {"low": 0.25, "mid": 0.5, "high": 0.99}
    gathered, ranked = ({(r.g, r.h): (r.low, r.mid, r.high) for r in aggregates.group_quantiles(df, ["g", "h"], "x", shares, most).collect()} for most in (10**6, 1))
    assert gathered.keys() == ranked.keys() and gathered[(4, "a")] == ranked[(4, "a")] == (None,) * 3
    for k, v in gathered.items():
        assert v == (None,) * 3 or ranked[k] == pytest.approx(v)
