"""Regression and classification."""

from __future__ import annotations

from pyspark.ml import classification, evaluation, feature, regression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homestead.operators import joins, sampling
from homestead.operators.resampling import bootstrap_difference  # noqa: F401


def line(df: DataFrame, y: str, x: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """slope, intercept and r2 of y on x, for each group if any."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def through_origin(df: DataFrame, y: str, x: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pairs.groupBy(*by).agg(F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))).alias("slope"))


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return feature.VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def least_squares(df: DataFrame, y: str, features: list[str]):
    """Ordinary least squares by the normal equations."""
    return regression.LinearRegression(solver="normal", labelCol=y).fit(assembled(df, features))


def forward_stepwise(df: DataFrame, y: str, features: list[str]) -> list[tuple[str, float]]:
    """Features in the order in which each lowers the residual error most, with the error after each."""
    chosen: list[tuple[str, float]] = []
    while rest := [f for f in features if f not in [c for c, _ in chosen]]:
        errors = {f: least_squares(df, y, [c for c, _ in chosen] + [f]).summary.rootMeanSquaredError for f in rest}
        best = min(errors, key=errors.get)
        chosen.append((best, errors[best]))
    return chosen


def regression_tree(df: DataFrame, y: str, features: list[str], depth: int = 5, seed: int = 1):
    return regression.DecisionTreeRegressor(labelCol=y, maxDepth=depth, seed=seed).fit(assembled(df, features))


def random_forest(df: DataFrame, y: str, features: list[str], trees: int = 20, depth: int = 5, seed: int = 1):
    return regression.RandomForestRegressor(labelCol=y, numTrees=trees, maxDepth=depth, seed=seed).fit(assembled(df, features))


def multinomial_logit(df: DataFrame, y: str, features: list[str], weight: str | None = None, ridge: float = 0.0):
    """Softmax regression; rows may be weighted."""
    model = classification.LogisticRegression(family="multinomial", labelCol=y, regParam=ridge, maxIter=200, tol=1e-10, standardization=False)
    return (model.setWeightCol(weight) if weight else model).fit(assembled(df, features))


def naive_bayes_params(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """label, prior, and mean and population deviation of each feature; one pass."""
    whole = df.agg(F.count(F.lit(1)).alias("__n"))
    stats = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"), *(x for f in features for x in (F.avg(f).alias(f"{f}_mean"), F.stddev_pop(f).alias(f"{f}_std"))))
    return stats.crossJoin(F.broadcast(whole)).withColumn("prior", F.col("__c") / F.col("__n")).drop("__c", "__n")


def naive_bayes_predict(df: DataFrame, params: DataFrame, key: str, label: str, features: list[str]) -> DataFrame:
    """key and predicted, the class with the largest log prior plus log densities (of equal ones the smaller), for each row.

    A feature without spread counts only as equal or not. Classes are few: all go to each row as one array, so rows neither multiply nor move.
    """
    if (n := params.count()) > 10_000:
        raise ValueError(f"{n} classes")
    classes = params.agg(F.collect_list(F.struct(F.col(label).alias("__l"), *(c for c in params.columns if c != label))).alias("__classes"))

    def log_density(c: Column, f: str) -> Column:
        m, s = c[f"{f}_mean"], c[f"{f}_std"]
        return F.when(s > 0, -F.log(s) - F.pow(F.try_divide(F.col(f) - m, s), 2) / 2).when(F.col(f) == m, 0.0).otherwise(-1e300)

    def loss(c: Column) -> Column:
        return F.struct((-sum((log_density(c, f) for f in features), F.log(c["prior"]))).alias("s"), c["__l"].alias("l"))

    return df.crossJoin(F.broadcast(classes)).select(key, F.array_min(F.transform("__classes", loss))["l"].alias("predicted"))


def model_rmse(model, df: DataFrame, y: str) -> float:
    return evaluation.RegressionEvaluator(labelCol=y, metricName="rmse").evaluate(model.transform(df))


def index_scaled(df: DataFrame, key: str, order: list[str], price: str, index: str) -> DataFrame:
    """The row before's price, times the ratio of the index now to then."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("estimate", F.try_divide(F.lag(price).over(w) * F.col(index), F.lag(index).over(w)))


def extrapolated_index(index: DataFrame, year: int, months: int, ahead: int = 13) -> DataFrame:
    """One row, `level`: the index (year, month, level) at month `ahead` of the year, by the line through its last `months` months."""
    last = index.where((F.col("year") == year) & (F.col("month") > 12 - months) & (F.col("month") <= 12))
    return last.agg((F.regr_intercept("level", "month") + F.regr_slope("level", "month") * ahead).alias("level"))


def index_model(queries: DataFrame, sales: DataFrame, index: DataFrame, key: str, day: str, order: list[str], price: str, now: DataFrame) -> DataFrame:
    """queries with the price of the key's last sale times index now (one row, `level`) to then; null without a sale or an index of its month."""
    w = Window.partitionBy(key).orderBy(F.col(day).desc(), *order)
    last = sales.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(F.col(key), F.year(day).alias("year"), F.month(day).alias("month"), F.col(price).alias("__price"))
    then = last.join(index.select("year", "month", F.col("level").alias("__then")), ["year", "month"], "left")
    priced = then.crossJoin(F.broadcast(now.select(F.col("level").alias("__now")))).select(key, F.try_divide(F.col("__price") * F.col("__now"), F.col("__then")).alias("estimate"))
    return queries.join(priced, key, "left")


def index_model_as_of(queries: DataFrame, sales: DataFrame, index: DataFrame, key: str, at: str, order: list[str], price: str) -> DataFrame:
    """queries with prior_<price>, prior_<at> and estimate: the price of the key's last sale before the query's time, times the index of the query's month to that of the sale's.

    Null without an earlier sale, or where the index (year, month, level) lacks a month. Of sales at one time the first in `order` counts.
    """
    rows = joins.as_of(queries, sales, key, at, [price], order)
    for name, day in (("__now", at), ("__then", f"prior_{at}")):
        months = index.select(F.col("year").alias("__y"), F.col("month").alias("__m"), F.col("level").alias(name))
        rows = rows.join(months, (F.year(day) == F.col("__y")) & (F.month(day) == F.col("__m")), "left").drop("__y", "__m")
    return rows.withColumn("estimate", F.try_divide(F.col(f"prior_{price}") * F.col("__now"), F.col("__then"))).drop("__now", "__then")


def by_formula(df: DataFrame, formula: str):
    """Least squares by a formula like "y ~ a + b"; text columns become indicators of their values but the rarest. Returns the fitted formula and model."""
    shape = feature.RFormula(formula=formula, handleInvalid="skip").fit(df)
    return shape, regression.LinearRegression(solver="normal").fit(shape.transform(df))


def synthetic_sales(spark, days: int, per_day: int, first: str, coefficients: dict[str, float], inflation: float = 0.0, bias: float = 1.0, spread: float = 0.1, seed: int = 1) -> DataFrame:
    """Made-up sales: day, recorded (two weeks on), land, latitude, has_pool, true_value and price.

    The true value is linear in the features (intercept, land, latitude, has_pool) and grows with the years; the price is bias times it with normal noise of
    spread times it. All from hashes of row and seed.
    """
    lot = lambda n: sampling.uniform(F.concat_ws(":", "id", F.lit(n)), seed)
    rows = spark.range(days * per_day).select("id", F.date_add(F.lit(first).cast("date"), (F.col("id") % days).cast("int")).alias("day"), (F.col("id") % days).alias("__at"))
    rows = rows.select("*", (1000 + 9000 * lot("land")).alias("land"), (33 + 2 * lot("latitude")).alias("latitude"), (lot("pool") < 0.2).cast("int").alias("has_pool"))
    linear = coefficients["intercept"] + sum((coefficients[f] * F.col(f) for f in ("latitude", "has_pool")), coefficients["land"] * F.col("land"))
    rows = rows.withColumn("true_value", linear * F.pow(F.lit(1 + inflation), F.col("__at") / 365))
    return rows.select("id", "day", F.date_add("day", 14).alias("recorded"), "land", "latitude", "has_pool", "true_value", (F.col("true_value") * (bias + spread * sampling.gaussian(lot("u"), lot("v")))).alias("price"))
