"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from homestead.catalog.registry import Tables, query
from homestead.operators import joins, memo
from homestead.plans import observations as plans


@query("SELECT o_orderkey, c_custkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def merge_inner(t: Tables):
    return joins.merge(t.orders, t.customer, "o_custkey", "c_custkey").select("o_orderkey", "c_custkey", "c_mktsegment", "o_totalprice")


@query('SELECT a.c_custkey AS "x key", b.o_custkey AS "y key", a.c_acctbal AS "x value", b.o_totalprice AS "y value" FROM customer a JOIN orders b ON a.c_custkey = b.o_custkey')
def merge_collision_names(t: Tables):
    x = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return joins.merge(x, t.orders.select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value")), "key", "key")


@query("""SELECT f.price AS first_price, l.price AS last_supplier_price, k AS nation FROM
(SELECT c_nationkey AS k, arg_min(c_acctbal, c_custkey) AS price FROM customer GROUP BY 1) f JOIN
(SELECT s_nationkey AS k, arg_max(s_acctbal, s_suppkey) AS price FROM supplier GROUP BY 1) l USING (k)""")
def merge_first_last(t: Tables):
    x, y = t.customer.select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("first_price")), t.supplier.select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("last_supplier_price"))
    return joins.merge_first_last(x, y, "c_nationkey", "s_nationkey", F.col("c_custkey"), F.col("s_suppkey"), "nation").select("first_price", "last_supplier_price", "nation")


@query("SELECT o_orderkey, c_custkey, n_name, r_name, round(o_totalprice / c_acctbal, 6) AS ratio FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0")
def join4_observations(t: Tables):
    sales = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    rows = plans.observations(sales, t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), t.nation.withColumnRenamed("n_regionkey", "r_regionkey"), t.region, "c_custkey", "n_nationkey", "r_regionkey")
    return rows.where("c_acctbal > 0").select("o_orderkey", "c_custkey", "n_name", "r_name", F.round(F.col("o_totalprice") / F.col("c_acctbal"), 6).alias("ratio"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def natural_join(t: Tables):
    return t.nation.withColumnRenamed("n_regionkey", "r_regionkey").join(t.region, "r_regionkey").select("n_nationkey", "n_name", "r_name")


@query("""SELECT c_custkey, coalesce(n, 0) AS n_orders, total, coalesce(s, 0) AS n_suppliers FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey
LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey""")
def cogroup_counts(t: Tables):
    orders = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    near = t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("s"))
    rows = t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(near, F.col("c_nationkey") == F.col("s_nationkey"), "left")
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "total", F.coalesce("s", F.lit(0)).alias("n_suppliers"))


@query("""SELECT c_custkey, len(l) AS n_orders, l[1] AS first_order, l[len(l)] AS last_order FROM
(SELECT c_custkey, list_sort(list(o_orderkey)) AS l FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)""")
def nested_children(t: Tables):
    rows = joins.children(t.customer.select("c_custkey"), {"orders": t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")}, "c_custkey")
    return rows.where(F.size("orders") > 0).select("c_custkey", F.size("orders").cast("long").alias("n_orders"), F.col("orders")[0]["o_orderkey"].alias("first_order"), F.element_at("orders", -1)["o_orderkey"].alias("last_order"))


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)")
def lookup_left(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality")


@query("""SELECT a, b, c, count(*) AS n_keys FROM (SELECT key, max(a) AS a, max(b) AS b, max(c) AS c FROM (
SELECT c_custkey AS key, 1 AS a, 0 AS b, 0 AS c FROM customer UNION ALL SELECT o_custkey, 0, 1, 0 FROM orders UNION ALL SELECT s_suppkey, 0, 0, 1 FROM supplier) GROUP BY key) GROUP BY a, b, c""")
def presence_4way(t: Tables):
    frames = {"a": t.customer.select(F.col("c_custkey").alias("key")), "b": t.orders.select(F.col("o_custkey").alias("key")), "c": t.supplier.select(F.col("s_suppkey").alias("key"))}
    return joins.presence(frames, ["key"])


@query("SELECT count(*) AS n FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))")
def semi_common(t: Tables):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey").distinct().agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_missing(t: Tables):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""WITH marks AS (SELECT DISTINCT CAST(make_date(y, m, 15) AS DATE) AS mark FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders), (VALUES (2), (5), (8), (11)) v(m)),
days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)
SELECT day, arg_min(mark, (abs(date_diff('day', mark, day)), mark)) AS nearest FROM days, marks GROUP BY day""")
def nearest_date(t: Tables):
    years = t.orders.select(F.year("o_orderdate").alias("y")).distinct()
    marks = years.select(F.explode(F.array(*(F.make_date("y", F.lit(m), F.lit(15)) for m in (2, 5, 8, 11)))).alias("mark"))
    days = t.lineitem.select(F.to_date("l_shipdate").alias("day")).distinct()
    return joins.nearest_day(days, "day", marks, "mark").select("day", "nearest")


@query("SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prior_o_totalprice FROM orders")
def prior_row(t: Tables):
    return joins.previous_row(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_totalprice"]).select("o_orderkey", "prior_o_totalprice")


@query("""SELECT c_custkey, prior_o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey AS prior_o_orderkey FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') WHERE r = 1) ON o_custkey = c_custkey""")
def prior_latest_row(t: Tables):
    early = t.orders.where("o_orderdate < timestamp'1998-01-01'").withColumnRenamed("o_custkey", "c_custkey")
    return joins.latest_before(t.customer, early, "c_custkey", "o_orderdate", ["o_orderkey"], ["o_orderkey"]).select("c_custkey", "prior_o_orderkey")


@query("SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def lookup_by_code(t: Tables):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("SELECT c_custkey, day FROM customer, (SELECT CAST(make_date(y, m, 15) AS DATE) AS day FROM (VALUES (1996), (1997)) a(y), (VALUES (2), (5), (8), (11)) b(m))")
def estimate_grid(t: Tables):
    return plans.estimation_grid(t.customer, "c_custkey", [1996, 1997])


@query("""SELECT c_custkey, day FROM customer, (SELECT CAST(make_date(y, m, 15) AS DATE) AS day FROM (VALUES (1996), (1997)) a(y), (VALUES (2), (5), (8), (11)) b(m))
WHERE (c_custkey, year(day), quarter(day)) NOT IN (SELECT (o_custkey, year(o_orderdate), quarter(o_orderdate)) FROM orders)""")
def incremental_anti_join(t: Tables):
    grid = plans.estimation_grid(t.customer, "c_custkey", [1996, 1997]).withColumns({"y": F.year("day"), "q": F.quarter("day")})
    done = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"))
    return memo.still_to_do(grid, done, ["c_custkey", "y", "q"]).select("c_custkey", "day")


@query("SELECT key, min(value) AS value FROM (SELECT c_custkey AS key, c_nationkey AS value FROM customer UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0) GROUP BY key")
def cache_merge(t: Tables):
    old = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("value"), "c_acctbal")
    return memo.merged(old, old.where("c_acctbal > 0"), "key", "value")
