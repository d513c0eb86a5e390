"""Models and their validation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from homestead.catalog.chance import low_rank
from homestead.catalog.registry import Tables, query
from homestead.catalog.vectors import NEAR, near
from homestead.operators import aggregates, completion, dictionary, frame, models, neighbors, validation


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag")
def ols_simple(t: Tables):
    return models.line(t.lineitem, "l_extendedprice", "l_quantity", ["l_returnflag"]).select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 5) AS slope FROM lineitem GROUP BY l_returnflag")
def ols_through_origin(t: Tables):
    return models.through_origin(t.lineitem, "l_extendedprice", "l_quantity", ["l_returnflag"]).withColumn("slope", F.round("slope", 5))


@query("""WITH m AS (SELECT year(o_orderdate) AS y, median(o_totalprice) AS i FROM orders GROUP BY 1)
SELECT o_orderkey, round(lag(o_totalprice) OVER w * i / lag(i) OVER w, 2) AS estimate FROM orders JOIN m ON year(o_orderdate) = y WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def index_scaled_price(t: Tables):
    index = aggregates.group_quantiles(t.orders.select(F.year("o_orderdate").alias("y"), "o_totalprice"), ["y"], "o_totalprice", {"i": 0.5}, at_most=t.orders.count())
    rows = t.orders.withColumn("y", F.year("o_orderdate")).join(index, "y")
    return models.index_scaled(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", "i").select("o_orderkey", F.round("estimate", 2).alias("estimate"))


@query("""SELECT l_returnflag, round(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS prior, round(avg(l_quantity), 5) AS quantity_mean, round(stddev_pop(l_quantity), 5) AS quantity_std,
round(avg(l_discount), 6) AS discount_mean, round(stddev_pop(l_discount), 6) AS discount_std FROM lineitem GROUP BY l_returnflag""")
def gaussian_nb_params(t: Tables):
    p = models.naive_bayes_params(t.lineitem, "l_returnflag", ["l_quantity", "l_discount"])
    return p.select("l_returnflag", F.round("prior", 6).alias("prior"), F.round("l_quantity_mean", 5).alias("quantity_mean"), F.round("l_quantity_std", 5).alias("quantity_std"), F.round("l_discount_mean", 6).alias("discount_mean"), F.round("l_discount_std", 6).alias("discount_std"))


@query("""WITH p AS (SELECT p_size % 3 AS class, count(*) / (SELECT count(*) FROM part)::DOUBLE AS prior, avg(p_retailprice) AS m1, stddev_pop(p_retailprice) AS s1, avg(p_size) AS m2, stddev_pop(p_size) AS s2 FROM part GROUP BY 1),
s AS (SELECT p_partkey, class, ln(prior) - ln(s1) - pow((p_retailprice - m1) / s1, 2) / 2 - ln(s2) - pow((p_size - m2) / s2, 2) / 2 AS s FROM part, p)
SELECT p_partkey, arg_min(class, (-s, class)) AS predicted FROM s GROUP BY p_partkey""")
def gaussian_nb_predict(t: Tables):
    rows = t.part.withColumn("class", F.col("p_size") % 3)
    params = models.naive_bayes_params(rows, "class", ["p_retailprice", "p_size"])
    return models.naive_bayes_predict(rows.drop("class"), params, "p_partkey", "class", ["p_retailprice", "p_size"])


@query()
def llr_predict(t: Tables):
    """Local linear regression of the label on all dimensions, for the stated queries."""
    rows = t.embeddings.withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    found = neighbors.nearest(rows.where("vec_id % 100 = 0"), rows, 30, "vec_id", "vec_id", "x", ["label", "x"])
    asked = rows.select(F.col("vec_id").alias("query"), F.col("x").alias("at"))
    return neighbors.local_linear(found.join(asked, "query"), "label", "x", "at", 30).withColumn("estimate", F.round("estimate", 6))


@query()
def multinomial_logit(t: Tables):
    """Coefficients of a softmax regression of the part's size class on price."""
    rows = t.part.select((F.col("p_size") % 3).cast("double").alias("class"), (F.col("p_retailprice") / 1000).alias("price"), (F.col("p_size") / 50).alias("size"))
    fitted = models.multinomial_logit(rows, "class", ["price", "size"], ridge=0.01).transform(models.assembled(rows, ["price", "size"]))
    return fitted.groupBy("class", "prediction").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.element_at(vector_to_array("probability"), 1)), 4).alias("mean_first"))


@query()
def als_complete(t: Tables):
    """Price by nation and month, completed at low rank: residuals of the known cells."""
    cells = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("row"), F.month("o_orderdate").alias("column")).agg((F.avg("o_totalprice") / 1e5).alias("value"))
    fitted = completion.complete_matrix(cells, "row", "column", "value", rank=3, ridge=0.05)
    return fitted.transform(cells).select("row", "column", F.round("value", 4).alias("value"), F.round("prediction", 4).alias("prediction"))


@query("SELECT 7000000000 + c_custkey AS parcel, CAST(m AS INTEGER) AS month, true AS close FROM customer, range(1, 13) r(m)")
def completed_errors(t: Tables):
    """Errors of a constant estimate, known for seven cells in ten, completed at rank 3: every corrected estimate is close to the price."""
    rows = low_rank(t)
    estimates = rows.withColumn("estimate", F.lit(40.0))
    cells = completion.errors(rows.where("known"), estimates, "parcel", "month")
    fitted = completion.complete_matrix(cells, "parcel", "month", "error", rank=3, ridge=1e-4, iterations=20)
    out = completion.corrected(estimates, fitted)
    return out.select("parcel", "month", (F.abs(F.col("corrected") - F.col("price")) < 2).alias("close"))


@query("""WITH d AS (SELECT 'b' AS c, p_brand AS v, row_number() OVER (ORDER BY p_brand) AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 50 <> 0)
UNION ALL SELECT 't', p_type, row_number() OVER (ORDER BY p_type) FROM (SELECT DISTINCT p_type FROM part WHERE p_partkey % 50 <> 0) UNION ALL SELECT 'n', p_name, row_number() OVER (ORDER BY p_name) FROM (SELECT DISTINCT p_name FROM part WHERE p_partkey % 50 <> 0))
SELECT p_partkey, coalesce(b.code, 0) AS brand_code, coalesce(t.code, 0) AS type_code, coalesce(n.code, 0) AS name_code FROM part LEFT JOIN d b ON b.c = 'b' AND b.v = p_brand LEFT JOIN d t ON t.c = 't' AND t.v = p_type LEFT JOIN d n ON n.c = 'n' AND n.v = p_name""")
def coded_columns(t: Tables):
    """Three text columns coded by a dictionary learned from a part of the rows; values it hasn't are 0."""
    rows = t.part.select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_name").alias("name"))
    known = dictionary.dictionary(rows.where("p_partkey % 50 <> 0"), ["brand", "type", "name"])
    return dictionary.coded(rows, known, ["brand", "type", "name"], "zero").select("p_partkey", "brand_code", "type_code", "name_code")


@query("""WITH m AS (SELECT avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_tax) AS c, avg(l_extendedprice) AS y, covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_tax) AS ac,
covar_pop(l_discount, l_discount) AS bb, covar_pop(l_discount, l_tax) AS bc, covar_pop(l_tax, l_tax) AS cc, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS by_, covar_pop(l_tax, l_extendedprice) AS cy FROM lineitem),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m),
s AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det AS q, (aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det AS r,
(aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det AS t FROM d)
SELECT 'l_quantity' AS term, round(q, 3) AS value FROM s UNION ALL SELECT 'l_discount', round(r, 3) FROM s UNION ALL SELECT 'l_tax', round(t, 3) FROM s UNION ALL SELECT 'intercept', round(y - q * a - r * b - t * c, 3) FROM s""")
def ols_multiple(t: Tables):
    """Least squares of price on quantity, discount and tax: coefficients."""
    m = models.least_squares(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    names = ["l_quantity", "l_discount", "l_tax", "intercept"]
    return t.spark.createDataFrame([(n, round(float(v), 3)) for n, v in zip(names, [*m.coefficients, m.intercept], strict=True)], "term string, value double")


@query()
def forest_and_tree(t: Tables):
    """Training errors of a regression tree and of a forest."""
    rows = t.part.select(F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 10).cast("double").alias("digit"))
    x = models.assembled(rows, ["size", "digit"])
    return t.spark.createDataFrame([(n, round(models.model_rmse(m, x, "y"), 2)) for n, m in (("tree", models.regression_tree(rows, "y", ["size", "digit"])), ("forest", models.random_forest(rows, "y", ["size", "digit"])))], "model string, rmse double")


@query("SELECT o_orderkey, CAST(o_orderkey % 5 AS BIGINT) AS fold FROM orders")
def kfold_assign_mod(t: Tables):
    return t.orders.select("o_orderkey", frame.fold_of(F.col("o_orderkey"), 5).alias("fold"))


@query(f"""WITH {NEAR}, e AS (SELECT query, rank AS k, avg(label) OVER (PARTITION BY query ORDER BY rank) AS estimate FROM near),
l AS (SELECT k, pow(estimate - label, 2) AS loss FROM e JOIN embeddings ON vec_id = query)
SELECT arg_min(k, (m, k)) AS k, round(min(m), 5) AS mean_loss FROM (SELECT k, avg(loss) AS m FROM l GROUP BY k)""")
def cv_best_k(t: Tables):
    estimates = neighbors.prefix_averages(near(t), "label").select("query", F.col("rank").alias("k"), "estimate")
    actual = t.embeddings.select(F.col("vec_id").alias("query"), "label")
    losses = estimates.join(actual, "query").withColumn("loss", F.pow(F.col("estimate") - F.col("label"), 2))
    return validation.best(losses, "k", "loss").withColumn("mean_loss", F.round("mean_loss", 5))


@query("""WITH f AS (SELECT o_orderkey, o_totalprice AS actual, CAST(o_orderkey % 4 AS INTEGER) AS fold, o_orderpriority AS p FROM orders),
m AS (SELECT a.fold AS fold, b.p AS p, avg(b.actual) AS by_priority FROM (SELECT DISTINCT fold FROM f) a JOIN f b ON a.fold <> b.fold GROUP BY 1, 2),
g AS (SELECT a.fold AS fold, avg(b.actual) AS overall FROM (SELECT DISTINCT fold FROM f) a JOIN f b ON a.fold <> b.fold GROUP BY 1),
e AS (SELECT 'mean' AS model, f.fold, actual, overall AS estimate FROM f JOIN g USING (fold) UNION ALL SELECT 'by priority', f.fold, actual, by_priority FROM f LEFT JOIN m USING (fold, p))
SELECT model, fold, round(sqrt(avg(pow(actual - estimate, 2))), 2) AS rmse, round(avg((abs((actual - estimate) / actual) <= 0.1)::INT), 6) AS within, avg((estimate IS NOT NULL)::INT) AS coverage FROM e GROUP BY 1, 2""")
def cross_validation(t: Tables):
    rows = t.orders.select(F.col("o_totalprice").alias("actual"), (F.col("o_orderkey") % 4).cast("int").alias("fold"), "o_orderpriority")
    overall = lambda train, test: test.join(train.groupBy("fold").agg(F.avg("actual").alias("estimate")), "fold")
    by = lambda train, test: test.join(train.groupBy("fold", "o_orderpriority").agg(F.avg("actual").alias("estimate")), ["fold", "o_orderpriority"], "left")
    out = validation.cross_validate(rows, "fold", 4, {"mean": overall, "by priority": by})
    return out.withColumns({"rmse": F.round("rmse", 2), "within": F.round("within", 6)})


@query("SELECT CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(avg(o_totalprice), 3) AS mean FROM orders GROUP BY 1")
def time_window_split(t: Tables):
    part = F.when(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp"), "train").otherwise("test")
    return t.orders.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 3).alias("mean"))


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS visit, avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS estimate, o_totalprice FROM orders)
SELECT CAST(visit AS INTEGER) AS visit, round(sqrt(avg(pow(o_totalprice - estimate, 2))), 2) AS rmse, count(*) AS n FROM r GROUP BY 1""")
def running_mean_model(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = t.orders.withColumns({"visit": F.row_number().over(w), "estimate": F.avg("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    return rows.groupBy("visit").agg(F.round(F.sqrt(F.avg(F.pow(F.col("o_totalprice") - F.col("estimate"), 2))), 2).alias("rmse"), F.count(F.lit(1)).alias("n"))
