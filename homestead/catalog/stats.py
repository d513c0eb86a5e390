"""Grouped statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from homestead.catalog.registry import Tables, query
from homestead.operators import aggregates as agg
from homestead.operators import validation

MEDIANS = """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, round(median(o_totalprice), 4) AS median_price
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 0 GROUP BY 1, 2"""


@query(MEDIANS)
def median_by_year_month(t: Tables):
    rows = t.orders.where("o_totalprice > 0").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_totalprice")
    return agg.group_quantiles(rows, ["year", "month"], "o_totalprice", {"median_price": 0.5}, at_most=t.orders.count()).withColumn("median_price", F.round("median_price", 4))


@query("SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS year, round(median(o_totalprice), 4) AS median_price, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def median_by_key_year(t: Tables):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("n_name", F.year("o_orderdate").alias("year"), "o_totalprice")
    out = agg.with_quantiles(rows, ["n_name", "year"], "o_totalprice", {"median_price": 0.5}, F.count(F.lit(1)).alias("n"), at_most=t.orders.count())
    return out.withColumn("median_price", F.round("median_price", 4))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_by_code(t: Tables):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05")
def count_where(t: Tables):
    return t.lineitem.where("l_quantity > 25 AND l_discount < 0.05").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_type, min(p_retailprice) AS low, round(avg(p_retailprice), 4) AS mean, max(p_retailprice) AS high FROM part GROUP BY p_type")
def min_avg_max(t: Tables):
    return t.part.groupBy("p_type").agg(F.min("p_retailprice").alias("low"), F.round(F.avg("p_retailprice"), 4).alias("mean"), F.max("p_retailprice").alias("high"))


def excess():
    return F.col("l_extendedprice") - F.col("l_quantity") * F.col("p_retailprice")


@query("""SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, round(avg(l_extendedprice - l_quantity * p_retailprice), 3) AS mean, round(stddev_samp(l_extendedprice - l_quantity * p_retailprice), 3) AS sd,
round(median(l_extendedprice - l_quantity * p_retailprice), 3) AS median, round(avg((abs((l_extendedprice - l_quantity * p_retailprice) / l_extendedprice) <= 0.1)::INT), 6) AS within
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def excess_stats_by_year(t: Tables):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("excess", excess())
    share = F.avg((F.abs(F.col("excess") / F.col("l_extendedprice")) <= 0.1).cast("int"))
    rows = rows.select(F.year("l_shipdate").alias("year"), "excess", "l_extendedprice")
    others = [F.count(F.lit(1)).alias("n"), F.round(F.avg("excess"), 3).alias("mean"), F.round(F.stddev_samp("excess"), 3).alias("sd"), F.round(share, 6).alias("within")]
    out = agg.with_quantiles(rows, ["year"], "excess", {"median": 0.5}, *others, at_most=t.lineitem.count())
    return out.select("year", "n", "mean", "sd", F.round("median", 3).alias("median"), "within")


@query("""SELECT c_nationkey, round(median((o_totalprice - c_acctbal) / c_acctbal), 5) AS median_relative, CAST(len(list_distinct(list(c_mktsegment))) AS INTEGER) AS n_segments
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1""")
def relative_excess_by_place(t: Tables):
    rows = t.orders.join(t.customer.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("c_nationkey", ((F.col("o_totalprice") - F.col("c_acctbal")) / F.col("c_acctbal")).alias("relative"), "c_mktsegment")
    out = agg.with_quantiles(rows, ["c_nationkey"], "relative", {"median_relative": 0.5}, F.count_distinct("c_mktsegment").cast("int").alias("n_segments"), at_most=t.orders.count())
    return out.withColumn("median_relative", F.round("median_relative", 5))


@query("""SELECT x AS "limit", round(avg((abs((l_extendedprice - l_quantity * p_retailprice) / l_extendedprice) <= x)::INT), 6) AS fraction
FROM lineitem JOIN part ON l_partkey = p_partkey, (SELECT unnest([0.0::DOUBLE, 0.1, 0.2, 0.3, 0.4, 0.5]) AS x) GROUP BY x""")
def cdf_within_x(t: Tables):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return agg.cumulative_within(rows, excess() / F.col("l_extendedprice"), [0.0, 0.1, 0.2, 0.3, 0.4, 0.5]).withColumn("fraction", F.round("fraction", 6))


@query("""WITH g AS (SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month FROM range(1995, 1997) a(y), range(1, 13) b(m)),
e AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, o_totalprice - 150000 AS d FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT year, month, count(d) AS n, round(count(*) FILTER (d < 0) / nullif(count(d), 0)::DOUBLE, 6) AS negative, round(count(*) FILTER (d = 0) / nullif(count(d), 0)::DOUBLE, 6) AS zero,
round(count(*) FILTER (d > 0) / nullif(count(d), 0)::DOUBLE, 6) AS positive FROM g LEFT JOIN e USING (year, month) GROUP BY year, month""")
def sign_fraction_dense_grid(t: Tables):
    rows = t.orders.where("o_orderpriority = '1-URGENT'").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), (F.col("o_totalprice") - 150000).alias("d"))
    out = agg.dense_periods(rows.groupBy("year", "month").agg(*agg.sign_fractions(F.col("d"))), [1995, 1996])
    return out.select("year", "month", F.coalesce("n", F.lit(0)).alias("n"), *(F.round(c, 6).alias(c) for c in ("negative", "zero", "positive")))


@query("SELECT l_suppkey, bool_or(l_returnflag = 'R') AS any_returned, bool_or(l_quantity >= 50) AS any_bulk, bool_or(l_discount = 0) AS any_full_price FROM lineitem GROUP BY l_suppkey")
def bool_or_by_location(t: Tables):
    return agg.flags_by(t.lineitem, "l_suppkey", {"any_returned": F.col("l_returnflag") == "R", "any_bulk": F.col("l_quantity") >= 50, "any_full_price": F.col("l_discount") == 0})


@query("SELECT p_size AS value, count(*) AS n, round(sum(count(*)) OVER (ORDER BY p_size) / (SELECT count(*) FROM part), 6) AS cumulative FROM part GROUP BY p_size")
def freq_cumulative_percentile(t: Tables):
    return agg.frequencies(t.part, "p_size").withColumn("cumulative", F.round("cumulative", 6))


@query("SELECT quality, count(*) FILTER (toxic = 0) AS \"0\", count(*) FILTER (toxic = 1) AS \"1\" FROM labels GROUP BY quality")
def confusion_pivot(t: Tables):
    return agg.confusion(t.labels, "quality", "toxic", [0, 1])


@query("SELECT round(1 - avg((quality = toxic)::INT), 8) AS error_rate FROM labels")
def error_rate(t: Tables):
    return t.labels.agg(F.round(agg.error_rate(F.col("quality"), F.col("toxic")), 8).alias("error_rate"))


@query("SELECT l_returnflag, round(sqrt(avg(pow(l_extendedprice - l_quantity * p_retailprice, 2))), 3) AS rmse FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag")
def rmse(t: Tables):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_returnflag").agg(F.round(agg.rmse(F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice")), 3).alias("rmse"))


@query("""SELECT l_returnflag, round(avg((abs((l_extendedprice - l_quantity * p_retailprice) / l_extendedprice) <= 0.1)::INT), 6) AS within10,
round(avg((abs((l_extendedprice - l_quantity * p_retailprice) / l_extendedprice) < 0.05)::INT), 6) AS below5 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag""")
def within10(t: Tables):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    a, e = F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice")
    return rows.groupBy("l_returnflag").agg(F.round(agg.within(a, e), 6).alias("within10"), F.round(agg.within(a, e, 0.05, False), 6).alias("below5"))


@query("SELECT source, round(avg((quality IS NOT NULL)::INT), 6) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def coverage(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.round(agg.coverage(F.col("quality")), 6).alias("coverage"))


@query("SELECT p_brand, arg_min(p_partkey, (p_retailprice, p_partkey)) AS cheapest, arg_max(p_partkey, (p_retailprice, p_partkey)) AS dearest FROM part GROUP BY p_brand")
def argmin_key(t: Tables):
    by = F.struct("p_retailprice", "p_partkey")
    return t.part.groupBy("p_brand").agg(F.min_by("p_partkey", by).alias("cheapest"), F.max_by("p_partkey", by).alias("dearest"))


def monthly(t: Tables):
    """Median prices by month."""
    rows = t.orders.select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_totalprice")
    return agg.group_quantiles(rows, ["year", "month"], "o_totalprice", {"price": 0.5}, at_most=t.orders.count())


@query("""WITH m AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, median(o_totalprice) AS price FROM orders GROUP BY 1, 2)
SELECT year, month, round(price, 3) AS price, round(price / lag(price) OVER (ORDER BY year, month), 6) AS ratio FROM m""")
def lag_ratio(t: Tables):
    months = monthly(t)
    return agg.declines(months, ["year", "month"], "price").select("year", "month", F.round("price", 3).alias("price"), F.round("ratio", 6).alias("ratio"))


@query("""WITH m AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, median(o_totalprice) AS price FROM orders GROUP BY 1, 2),
r AS (SELECT price / lag(price) OVER (ORDER BY y, m) AS ratio FROM m) SELECT count(*) AS n, count(*) FILTER (ratio < 1) AS declines FROM r""")
def decline_count(t: Tables):
    months = monthly(t)
    return agg.declines(months, ["year", "month"], "price").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ratio") < 1).alias("declines"))


@query("""WITH m AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, median(o_totalprice) AS price FROM orders GROUP BY 1)
SELECT year, round(price / (SELECT price FROM m WHERE year = 1995), 6) AS "index" FROM m""")
def index_to_base_year(t: Tables):
    years = agg.group_quantiles(t.orders.select(F.year("o_orderdate").alias("year"), "o_totalprice"), ["year"], "o_totalprice", {"price": 0.5}, at_most=t.orders.count())
    return agg.index_to_base(years, "price", F.col("year") == 1995).select("year", F.round("index", 6).alias("index"))


@query("""SELECT CAST(month(o_orderdate) AS INTEGER) AS month, CAST(sign(o_totalprice - 150000) AS INTEGER) AS side, round(avg((o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT), 6) AS share FROM orders GROUP BY 1, 2""")
def share_given_sign(t: Tables):
    return t.orders.groupBy(F.month("o_orderdate").alias("month"), F.signum(F.col("o_totalprice") - 150000).cast("int").alias("side")).agg(F.round(F.avg(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")), 6).alias("share"))


@query("SELECT n, count(*) AS n_customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n")
def orders_per_customer_histogram(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("n_customers"))


@query("SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean, round(stddev_pop(c_acctbal), 4) AS sd_population, round(stddev_samp(c_acctbal), 4) AS sd_sample FROM customer GROUP BY 1")
def mean_and_deviations(t: Tables):
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.stddev_pop("c_acctbal"), 4).alias("sd_population"), F.round(F.stddev_samp("c_acctbal"), 4).alias("sd_sample"))


@query("SELECT l_linestatus, l_returnflag, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY 1, 2")
def sum_by_key(t: Tables):
    return t.lineitem.groupBy("l_linestatus", "l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 2 * m THEN 'rich' WHEN c_acctbal < 0.5 * m THEN 'poor' ELSE 'middle' END AS stratum FROM customer, (SELECT median(c_acctbal) AS m FROM customer)""")
def stratify_median(t: Tables):
    return validation.strata(t.customer, "c_acctbal").select("c_custkey", "stratum")


HOURLY = """SELECT event_type, to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP AS window_start, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY 1, 2"""


@query(HOURLY)
def hourly_windows(t: Tables):
    from homestead.streaming.events import windowed

    return windowed(t.events, "1 hour").select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "mean_value")


@query(HOURLY)
def hourly_windows_streamed(t: Tables):
    """The same windows from a stream over all files of the table, without a watermark."""
    from homestead.shared import shared_dir
    from homestead.streaming.events import event_stream, to_table, windowed

    base = shared_dir(t.spark, "stream")
    windows = to_table(windowed(event_stream(t.spark, f"{t.folder}/events.parquet"), "1 hour", late=None), f"{base}/out", f"{base}/state")
    return windows.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "mean_value")
