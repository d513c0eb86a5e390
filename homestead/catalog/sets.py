"""Projection, validity, distinctness, sets, ranks and positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from homestead.catalog.registry import Tables, query
from homestead.operators import frame, validity


@query("SELECT o_orderkey, o_totalprice FROM orders")
def project_cols(t: Tables):
    return frame.only_columns(t.orders, ["o_orderkey", "o_totalprice"])


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop_cols(t: Tables):
    return frame.drop_columns(t.customer, ["c_name", "c_acctbal", "not_there"])


def rules() -> dict:
    return {
        "price positive": F.col("o_totalprice") > 0,
        "price not huge": F.col("o_totalprice") <= 300000,
        "status final": F.col("o_orderstatus").isin("F", "O"),
        "priority known": F.col("o_orderpriority") != "5-LOW",
        "after 1993": F.year("o_orderdate") > 1993,
    }


@query("SELECT * FROM orders WHERE o_totalprice > 0 AND o_totalprice <= 300000 AND o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW' AND year(o_orderdate) > 1993")
def filter_validity_all(t: Tables):
    return validity.valid(t.orders, rules())


@query("""SELECT 'price positive' AS rule, count(*) FILTER (NOT coalesce(o_totalprice > 0, false)) AS excluded FROM orders
UNION ALL SELECT 'price not huge', count(*) FILTER (NOT coalesce(o_totalprice <= 300000, false)) FROM orders
UNION ALL SELECT 'status final', count(*) FILTER (NOT coalesce(o_orderstatus IN ('F', 'O'), false)) FROM orders
UNION ALL SELECT 'priority known', count(*) FILTER (NOT coalesce(o_orderpriority <> '5-LOW', false)) FROM orders
UNION ALL SELECT 'after 1993', count(*) FILTER (NOT coalesce(year(o_orderdate) > 1993, false)) FROM orders""")
def validity_exclusion_counts(t: Tables):
    return validity.exclusions(t.orders, rules())


@query("""SELECT o_orderkey, CASE WHEN NOT coalesce(o_totalprice > 0, false) THEN 'price positive' WHEN NOT coalesce(o_totalprice <= 300000, false) THEN 'price not huge'
WHEN NOT coalesce(o_orderstatus IN ('F', 'O'), false) THEN 'status final' WHEN NOT coalesce(o_orderpriority <> '5-LOW', false) THEN 'priority known'
WHEN NOT coalesce(year(o_orderdate) > 1993, false) THEN 'after 1993' END AS reason FROM orders""")
def reject_reason(t: Tables):
    return validity.with_reason(t.orders, rules()).select("o_orderkey", "reason")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 AND o_totalprice <= (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)")
def positive_not_huge(t: Tables):
    return validity.positive_not_huge(t.orders, "o_totalprice").select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL")
def na_drop_subset(t: Tables):
    return t.labels.na.drop(subset=["doc_id", "quality"]).select("doc_id", "quality")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def head_n(t: Tables):
    return frame.head(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], 10)


@query("SELECT (coalesce(c_acctbal > 0, false)) AS kept, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def split_rows_pred(t: Tables):
    good, rest = frame.split_rows(t.customer, F.col("c_acctbal") > 0)
    return good.withColumn("kept", F.lit(True)).union(rest.withColumn("kept", F.lit(False))).groupBy("kept").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("""SELECT 'p_brand' AS column_name, count(DISTINCT p_brand) + coalesce(max((p_brand IS NULL)::INT), 0) AS n_distinct FROM part HAVING n_distinct > 1
UNION ALL SELECT 'p_type', count(DISTINCT p_type) + coalesce(max((p_type IS NULL)::INT), 0) AS n FROM part HAVING n > 1
UNION ALL SELECT 'p_size', count(DISTINCT p_size) + coalesce(max((p_size IS NULL)::INT), 0) AS n FROM part HAVING n > 1""")
def informative_columns(t: Tables):
    return frame.informative_columns(t.part.select("p_brand", "p_type", "p_size").withColumn("constant", F.lit(1)))


@query("""SELECT 'quality' AS column_name, count(quality) AS present, count(*) - count(quality) AS missing FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'toxic', count(toxic), count(*) - count(toxic) FROM documents LEFT JOIN labels USING (doc_id)""")
def missing_present_counts(t: Tables):
    return frame.missing_counts(t.documents.join(t.labels, "doc_id", "left"), ["quality", "toxic"])


@query("SELECT DISTINCT event_type, user_id FROM events")
def distinct_rows(t: Tables):
    return t.events.select("event_type", "user_id").distinct()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, CAST(o_orderdate AS DATE)) IN (SELECT (o_custkey, CAST(o_orderdate AS DATE)) FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE) HAVING count(*) = 1)")
def drop_all_dups(t: Tables):
    return frame.drop_all_duplicates(t.orders.withColumn("day", F.to_date("o_orderdate")), ["o_custkey", "day"]).select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def keep_first_dup(t: Tables):
    return frame.keep_first(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("SELECT key, count(*) AS n FROM (SELECT c_nationkey AS key FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY key")
def union_all(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("key")).unionByName(t.supplier.select(F.col("s_nationkey").alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey AS key FROM lineitem UNION SELECT s_suppkey FROM supplier")
def set_union(t: Tables):
    return t.lineitem.select(F.col("l_suppkey").alias("key")).union(t.supplier.select("s_suppkey")).distinct()


@query("SELECT p_partkey AS key FROM part EXCEPT SELECT l_partkey FROM lineitem")
def set_difference(t: Tables):
    return t.part.select(F.col("p_partkey").alias("key")).join(t.lineitem.select(F.col("l_partkey").alias("key")), "key", "left_anti").distinct()


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicated_keys(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""SELECT c_nationkey, c_custkey, c_acctbal, rank FROM (SELECT c_nationkey, c_custkey, c_acctbal, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer) WHERE rank <= 3""")
def topk_per_group(t: Tables):
    w = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return t.customer.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("c_nationkey", "c_custkey", "c_acctbal", "rank")


@query("SELECT p_brand, dense_rank() OVER (ORDER BY first) AS code FROM (SELECT p_brand, min(p_partkey) AS first FROM part GROUP BY p_brand)")
def first_seen_codes(t: Tables):
    return frame.first_seen_codes(t.part.select("p_brand", "p_partkey"), "p_brand", ["p_partkey"]).select("p_brand", "code").distinct()


@query("SELECT o_orderkey, CAST(o_orderkey % 5 AS BIGINT) AS fold, CAST(row_number() OVER (PARTITION BY o_orderkey % 5 ORDER BY o_orderkey) AS INTEGER) AS ordinal FROM orders")
def fold_ordinal(t: Tables):
    return frame.ordinal(t.orders.select("o_orderkey", frame.fold_of(F.col("o_orderkey"), 5).alias("fold")), ["o_orderkey"], ["fold"])


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r >= 3 AND (r - 3) % 7 = 0")
def slice_mod(t: Tables):
    return frame.every_nth(t.orders.select("o_orderkey"), ["o_orderkey"], 7, 3)


@query("SELECT r_name, n_name FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation WHERE n_nationkey < 5) USING (i)")
def paste_columns(t: Tables):
    nations = t.nation.where("n_nationkey < 5").select("n_nationkey", "n_name")
    return frame.beside(t.region, nations, ["r_regionkey"], ["n_nationkey"]).select("r_name", "n_name")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal <> 0 AND s_suppkey <> 0")
def zero_reject(t: Tables):
    return t.supplier.where("s_acctbal <> 0 AND s_suppkey <> 0").select("s_suppkey", "s_acctbal")


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_orders FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_custkey")
def history_semi_join(t: Tables):
    wanted = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(wanted, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
