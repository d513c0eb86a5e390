"""Neighbours of all rows and their cache, latest earlier rows, settings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from homestead.catalog.chance import lot
from homestead.catalog.registry import Tables, query
from homestead.catalog.vectors import BOTH, NEAR, near, places
from homestead.functions import dates
from homestead.operators import aggregates, comparison, joins, models, neighbor_cache, neighbor_join, neighbors, search, validation
from homestead.shared import shared_dir, written
from homestead.sources import delimited, typed_table

ALL = NEAR.replace("a.vec_id % 100 = 0 AND ", "")
EVERY_TENTH = BOTH.replace("% 100 = 0", "% 10 = 0")


@query(f"WITH {ALL} SELECT query, neighbour, round(distance, 5) AS distance, rank FROM near")
def all_pairs_neighbours(t: Tables):
    """The ten nearest rows of every row."""
    return neighbor_join.nearest_of_all(t.embeddings, 10, "vec_id", "embedding").withColumn("distance", F.round("distance", 5))


@query(f"WITH {ALL} SELECT query, round(avg(label), 6) AS estimate FROM near WHERE rank <= 5 GROUP BY query")
def cache_reestimate(t: Tables):
    """Neighbours of every row kept in shards with their labels, one shard of them stale and then replaced; estimates from the table."""
    name = f"neighbours_{uuid.uuid4().hex[:12]}"
    labels = t.embeddings.select(F.col("vec_id").alias("neighbour"), "label")
    found = written(neighbor_join.nearest_of_all(t.embeddings, 10, "vec_id", "embedding").join(labels, "neighbour"), "neighbours")
    stale = neighbor_cache.shard_of(F.col("query"), 8) == 3
    neighbor_cache.keep(found.withColumn("label", F.when(stale, F.col("label") + 100).otherwise(F.col("label"))), name, 8, 16)
    table = neighbor_cache.replace(t.spark, name, found.where(stale), 8, 16)
    return neighbor_cache.estimates(table, "label", 5).withColumn("estimate", F.round("estimate", 6))


@query("""WITH given AS (SELECT o_custkey, o_orderdate, arg_min(o_totalprice, o_orderkey) AS price, min(o_orderkey) AS o FROM orders GROUP BY 1, 2)
SELECT o_orderkey, CASE WHEN age THEN o END AS prior_o_orderkey, CASE WHEN age THEN price END AS prior_o_totalprice, CASE WHEN age THEN d END AS prior_o_orderdate
FROM (SELECT a.o_orderkey, g.o, g.price, g.o_orderdate AS d, g.o_orderdate >= a.o_orderdate - INTERVAL 200 DAY AS age FROM orders a ASOF LEFT JOIN given g ON a.o_custkey = g.o_custkey AND a.o_orderdate > g.o_orderdate)""")
def prior_sale_as_of(t: Tables):
    """The customer's last order before each order, if it is at most 200 days old; of one time the smallest number."""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    out = joins.as_of(rows, rows, "o_custkey", "o_orderdate", ["o_orderkey", "o_totalprice"], ["o_orderkey"], F.expr("INTERVAL 200 DAY"))
    return out.select("o_orderkey", "prior_o_orderkey", "prior_o_totalprice", "prior_o_orderdate")


@query("""WITH i AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, avg(o_totalprice) AS level FROM orders GROUP BY 1, 2),
given AS (SELECT o_custkey, o_orderdate, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1, 2)
SELECT o_orderkey, round(price * now.level / past.level, 2) AS estimate FROM (SELECT a.*, g.price, g.o_orderdate AS d FROM orders a ASOF LEFT JOIN given g ON a.o_custkey = g.o_custkey AND a.o_orderdate > g.o_orderdate) s
LEFT JOIN i now ON now.y = year(s.o_orderdate) AND now.m = month(s.o_orderdate) LEFT JOIN i past ON past.y = year(d) AND past.m = month(d)""")
def index_model_as_of(t: Tables):
    """Each order's price from the customer's last order before it and the index of both months."""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    index = rows.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("level"))
    out = models.index_model_as_of(rows.drop("o_totalprice"), rows, index, "o_custkey", "o_orderdate", ["o_orderkey"], "o_totalprice")
    return out.select("o_orderkey", F.round("estimate", 2).alias("estimate"))


def settings(t: Tables):
    """Numbers of neighbours and metres a year, from the regions."""
    return search.combined(t.region.select((2 + 3 * F.col("r_regionkey")).cast("int").alias("k")), t.nation.select((2000.0 * (1 + F.col("n_regionkey"))).alias("metres")))


SETTINGS = "SELECT DISTINCT CAST(2 + 3 * r_regionkey AS INTEGER) AS k, 2000.0::DOUBLE * (1 + n_regionkey) AS metres FROM region, nation"


@query(f"""WITH {EVERY_TENTH}, s AS ({SETTINGS}),
r AS (SELECT query, k, metres, y, space2 + time2 * metres * metres AS d2, row_number() OVER (PARTITION BY query, k, metres ORDER BY space2 + time2 * metres * metres, id) AS r FROM c, s WHERE (rs <= 20 OR rt <= 20) AND y IS NOT NULL AND id <> query),
w AS (SELECT *, greatest(0, 1 - d2 / nullif(max(d2) OVER (PARTITION BY query, k, metres), 0)) AS w FROM r WHERE r <= k),
e AS (SELECT query, k, metres, CASE WHEN count(*) = k THEN avg(y) END AS average, CASE WHEN count(*) = k THEN sum(y * w) / nullif(sum(w), 0) END AS kernel FROM w GROUP BY 1, 2, 3),
m AS (SELECT query, k, metres, 'average' AS model, average AS estimate FROM e UNION ALL SELECT query, k, metres, 'kernel', kernel FROM e)
SELECT k, metres, model, round(sqrt(avg(pow(y - estimate, 2))), 4) AS rmse, round(avg((abs((y - estimate) / y) <= 0.1)::INT), 6) AS within, avg((estimate IS NOT NULL)::INT) AS coverage FROM m JOIN p ON p.id = query AND p.y IS NOT NULL GROUP BY k, metres, model""")
def hp_search_one_pass(t: Tables):
    """Errors of both kinds of estimate for every setting, from candidates that are found once."""
    rows = places(t)
    asked = rows.where("id % 10 = 0")
    candidates = neighbors.space_time_candidates(asked, rows, 20)
    out = search.searched(candidates, settings(t), asked.select(F.col("id").alias("query"), F.col("y").alias("actual")))
    return out.withColumns({"rmse": F.round("rmse", 4), "within": F.round("within", 6)})


@query(f"{SETTINGS}")
def hp_grid(t: Tables):
    """All combinations of two kinds of settings that come from tables."""
    return settings(t)


@query(f"""SELECT s_suppkey, round(2 + {lot("s_suppkey || ':k'", 11)} * 118, 8) AS k, round(exp(ln(1) + {lot("s_suppkey || ':metres'", 11)} * (ln(10000) - ln(1))), 6) AS metres FROM supplier""")
def random_hp_sets(t: Tables):
    """Random settings for each supplier."""
    sets = validation.random_settings(t.supplier, "s_suppkey", {"k": ("uniform", 2, 120), "metres": ("geometric", 1, 10000)}, 11)
    return sets.select("s_suppkey", F.round("k", 8).alias("k"), F.round("metres", 6).alias("metres"))


@query(f"""WITH {NEAR}, w AS (SELECT query, rank, label, greatest(0, 0.75 * (1 - pow(distance / CASE WHEN max(distance) OVER q = 0 THEN 1e-10 ELSE max(distance) OVER q END, 2))) AS w FROM near WINDOW q AS (PARTITION BY query)),
v AS (SELECT query, label, CASE WHEN max(w) OVER (PARTITION BY query) > 0 THEN w WHEN rank < 10 THEN 1 / 9.0 ELSE 0 END AS w FROM w)
SELECT query, round(sum(w * label) / sum(w), 5) AS estimate FROM v GROUP BY query""")
def kernel_epan_always(t: Tables):
    return neighbors.kernel_average_always(near(t), "label", 10).withColumn("estimate", F.round("estimate", 5))


@query("SELECT arg_max(o_orderpriority, o_orderkey) AS o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_totalprice > 1000")
def bare_column_count(t: Tables):
    """A code of the last row beside the number of rows."""
    rows = t.orders.where("o_totalprice > 1000")
    return aggregates.with_bare(rows, [F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean")], ["o_orderpriority"], ["o_orderkey"])


@query("""WITH a AS (SELECT o_custkey, make_date(CAST(year(o_orderdate) AS BIGINT), CAST(quarter(o_orderdate) * 3 - 1 AS BIGINT), 15) AS day, ln(o_totalprice) AS a, year(o_orderdate) BETWEEN 1993 AND 1997 AS asked FROM orders),
g AS (SELECT DISTINCT o_custkey, day FROM a), b AS (SELECT a.*, CASE WHEN a.o_custkey % 5 <> 0 THEN ln(100000 + 10 * a.o_custkey) END AS f, CASE WHEN a.o_custkey % 7 <> 0 THEN ln(120000 + month(day) * 1000) END AS s FROM a)
SELECT count(*) AS actual, count(*) FILTER (NOT asked) AS not_asked_for, count(*) FILTER (asked AND f IS NULL AND s IS NOT NULL) AS not_in_first, count(*) FILTER (asked AND f IS NOT NULL AND s IS NULL) AS not_in_second,
count(*) FILTER (asked AND f IS NULL AND s IS NULL) AS in_neither, count(*) FILTER (asked AND f IS NOT NULL AND s IS NOT NULL) AS compared,
count(*) FILTER (asked AND abs(a - f) < abs(a - s)) AS first_closer, count(*) FILTER (asked AND abs(a - f) > abs(a - s)) AS second_closer, count(*) FILTER (asked AND abs(a - f) = abs(a - s)) AS equal,
round(sqrt(avg(pow(a - f, 2)) FILTER (asked AND f + s IS NOT NULL)), 6) AS first_rmse, round(sqrt(avg(pow(a - s, 2)) FILTER (asked AND f + s IS NOT NULL)), 6) AS second_rmse,
round(avg((abs(exp(a) - exp(f)) / exp(a) < 0.1)::INT) FILTER (asked AND f + s IS NOT NULL), 6) AS first_within, round(avg((abs(exp(a) - exp(s)) / exp(a) < 0.1)::INT) FILTER (asked AND f + s IS NOT NULL), 6) AS second_within FROM b""")
def estimates_compared(t: Tables):
    """Two estimates of each customer's orders, on the grid of mid-quarter days, and which is closer."""
    rows = t.orders.select("o_custkey", "o_orderdate", F.log("o_totalprice").alias("price"))
    grid = rows.select("o_custkey", dates.mid_quarter(F.col("o_orderdate").cast("date")).alias("day")).distinct()
    k = F.col("o_custkey")
    first = grid.where(k % 5 != 0).withColumn("estimate", F.log(100000 + 10 * k))
    second = grid.where(k % 7 != 0).withColumn("estimate", F.log(120000 + F.month("day") * 1000))
    out = comparison.compared(rows, first, second, "o_custkey", "day", "price", F.year("o_orderdate").between(1993, 1997), dates.mid_quarter(F.col("o_orderdate").cast("date")))
    return out.select(*(F.round(c, 6).alias(c) if c.endswith(("rmse", "within")) else F.col(c) for c in out.columns))


@query("""SELECT o_orderkey, o_totalprice, o_orderpriority, CAST(o_orderkey % 8 + 1 AS INTEGER) AS file_number, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) AS record_number
FROM orders QUALIFY o_orderpriority <> '5-LOW'""")
def numbered_records(t: Tables):
    """Orders written as eight tab files and read with the number of their file and record; then one priority is left out."""
    path = shared_dir(t.spark, "files")
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority", (F.col("o_orderkey") % 8).alias("file"))
    rows.repartition(8, "file").sortWithinPartitions("file", "o_orderkey").write.partitionBy("file").csv(path, sep="\t", header=True)
    read = delimited.read_numbered(t.spark, [f"{path}/file={i}" for i in range(8)], "o_orderkey long, o_totalprice double, o_orderpriority string")
    return read.where("o_orderpriority <> '5-LOW'").drop("file_name")


@query("SELECT c_name, c_acctbal, CAST(c_custkey AS DOUBLE) AS c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def typed_table_round_trip(t: Tables):
    """Customers as records of a typed table, of which one column is not read and two are compared in the source."""
    path = shared_dir(t.spark, "typed")
    typed_table.write_typed_table(t.customer.select("c_name", "c_acctbal", "c_custkey", "c_mktsegment", "c_nationkey"), path)
    rows = typed_table.read_typed_table(t.spark, path, "tmmtx", ["c_name", "c_acctbal", "c_custkey", "c_mktsegment", "c_nationkey"])
    return rows.where("c_acctbal > 0 AND c_mktsegment = 'BUILDING'").select("c_name", "c_acctbal", "c_custkey")
