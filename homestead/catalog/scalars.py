"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from homestead.catalog.registry import Tables, query
from homestead.functions import dates, keys, numbers
from homestead.functions.codes import CodeTable


def spelled(t: Tables):
    """Order keys in a plain and a formatted spelling, some of them broken."""
    k = F.col("o_orderkey")
    plain = F.when(k % 5 == 0, None).when(k % 5 == 1, F.concat(k.cast("string"), F.lit("x"))).otherwise(k.cast("string"))
    return t.orders.select(k, plain.alias("plain"), F.when(k % 7 == 0, None).otherwise(F.concat_ws("-", F.lit("1"), k.cast("string"))).alias("formatted"))


SPELLED = """(SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN o_orderkey || 'x' ELSE o_orderkey::VARCHAR END AS plain,
CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE '1-' || o_orderkey END AS formatted FROM orders)"""


@query(f"SELECT o_orderkey, CAST(CASE WHEN regexp_full_match(replace(plain, '-', ''), '[0-9]+') THEN replace(plain, '-', '') WHEN regexp_full_match(replace(formatted, '-', ''), '[0-9]+') THEN replace(formatted, '-', '') END AS BIGINT) AS key FROM {SPELLED}")
def best_key_digits(t: Tables):
    return spelled(t).select("o_orderkey", keys.digits_key(F.col("plain"), F.col("formatted")).alias("key"))


@query(f"SELECT o_orderkey, coalesce(TRY_CAST(plain AS DOUBLE), TRY_CAST(replace(formatted, '-', '') AS DOUBLE)) AS key FROM {SPELLED}")
def best_key_number(t: Tables):
    return spelled(t).select("o_orderkey", keys.number_key(F.col("plain"), F.col("formatted")).alias("key"))


@query(f"SELECT o_orderkey, CASE WHEN regexp_full_match(plain, '[0-9]{{1,10}}') THEN lpad(plain, 10, '0') WHEN formatted IS NOT NULL THEN lpad(replace(formatted, '-', ''), 10, '0') END AS key FROM {SPELLED}")
def best_key_padded(t: Tables):
    return spelled(t).select("o_orderkey", keys.padded_key(F.col("plain"), F.col("formatted")).alias("key"))


@query("SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 10, '0') || strftime(o_orderdate, '%Y%m%d') AS packed, o_orderkey AS key, CAST(o_orderdate AS DATE) AS day FROM orders")
def pack_key_date(t: Tables):
    packed = t.orders.select("o_orderkey", keys.pack_key_date(F.col("o_orderkey"), F.col("o_orderdate")).alias("packed"))
    key, day = keys.unpack_key_date(F.col("packed"))
    return packed.select("o_orderkey", "packed", key.alias("key"), day.alias("day"))


def dated(t: Tables):
    """Order days as text: every third with day 00, every seventh empty."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    return t.orders.select(k, F.when(k % 7 == 0, "").when(k % 3 == 0, F.concat(F.substring(day, 1, 6), F.lit("00"))).otherwise(day).alias("sale"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("recorded"))


DATED = """(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y%m') || '00' ELSE strftime(o_orderdate, '%Y%m%d') END AS sale, strftime(o_orderdate, '%Y-%m-%d') AS recorded FROM orders)"""
FIXED = "CAST(try_strptime(CASE WHEN sale LIKE '%00' AND length(sale) = 8 THEN left(sale, 6) || '{}' ELSE sale END, '%Y%m%d') AS DATE)"


@query(f"SELECT o_orderkey, coalesce({FIXED.format('01')}, CAST(recorded AS DATE)) AS day FROM {DATED}")
def date_choice(t: Tables):
    return dated(t).select("o_orderkey", dates.choose_day(F.col("sale"), F.col("recorded")).alias("day"))


@query(f"SELECT o_orderkey, {FIXED.format('01')} AS day01, {FIXED.format('15')} AS day15 FROM {DATED}")
def fix_day_zero(t: Tables):
    return dated(t).select("o_orderkey", dates.parse_day(F.col("sale")).alias("day01"), dates.parse_day(F.col("sale"), "15").alias("day15"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS sale, CAST(l_shipdate AS DATE) AS recorded FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, coalesce(sale, recorded - CAST(floor((SELECT avg(date_diff('day', sale, recorded)) FROM d)) AS INTEGER)) AS day FROM d""")
def sale_day_impute(t: Tables):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 4 != 0, F.to_date("o_orderdate")).alias("sale"), F.to_date("l_shipdate").alias("recorded"))
    lag = rows.agg(F.floor(F.avg(F.datediff("recorded", "sale"))).cast("int").alias("lag"))
    return rows.crossJoin(F.broadcast(lag)).select("l_orderkey", "l_linenumber", F.coalesce("sale", F.date_sub("recorded", F.col("lag"))).alias("day"))


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1900-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders")
def days_1900(t: Tables):
    return t.orders.select("o_orderkey", dates.days_since_1900(F.to_date("o_orderdate")).alias("days"))


@query("""SELECT o_orderkey, CAST(make_date(year(o_orderdate), quarter(o_orderdate) * 3 - 1, 15) AS DATE) AS mid_quarter, CAST(make_date(year(o_orderdate), month(o_orderdate), 15) AS DATE) AS mid_month,
CAST((year(o_orderdate) - 1984) * 4 + quarter(o_orderdate) AS INTEGER) AS quarter_index, CAST((year(o_orderdate) - 1984) * 12 + month(o_orderdate) AS INTEGER) AS month_index FROM orders""")
def mid_quarter(t: Tables):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", dates.mid_quarter(d).alias("mid_quarter"), dates.mid_month(d).alias("mid_month"), dates.quarter_index(d, 1984).alias("quarter_index"), dates.month_index(d, 1984).alias("month_index"))


@query("""WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem), m AS (SELECT day, CAST(make_date(year(day) + o, q, 15) AS DATE) AS mid FROM d, (VALUES (-1), (0), (1)) a(o), (VALUES (2), (5), (8), (11)) b(q))
SELECT day, arg_min(mid, (abs(date_diff('day', mid, day)), mid)) AS mid FROM m GROUP BY day""")
def nearest_mid_quarter(t: Tables):
    return t.lineitem.select(F.to_date("l_shipdate").alias("day")).distinct().select("day", dates.nearest_mid_quarter(F.col("day")).alias("mid"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day, year(o_orderdate) BETWEEN 1990 AND 1999 AS nineties FROM orders")
def split_date(t: Tables):
    y, m, d = dates.split_day(F.col("o_orderdate"))
    return t.orders.select("o_orderkey", y.alias("year"), m.alias("month"), d.alias("day"), dates.in_decade(F.col("o_orderdate"), 1990).alias("nineties"))


EVENTS = CodeTable({"browse": ("view", "click"), "buy": ("purchase", "add_to_cart"), "failure": ("error",)})


@query("""SELECT event_type, event_type IN ('view', 'click') AS is_browse, event_type IN ('view', 'click', 'error') AS browse_or_failure,
CASE WHEN event_type IN ('view', 'click') THEN 'browse' WHEN event_type IN ('purchase', 'add_to_cart') THEN 'buy' WHEN event_type = 'error' THEN 'failure' END AS kind, count(*) AS n FROM events GROUP BY ALL""")
def code_table(t: Tables):
    c = F.col("event_type")
    return t.events.groupBy(c, EVENTS.has(c, "browse").alias("is_browse"), EVENTS.any_of(c, "browse", "failure").alias("browse_or_failure"), EVENTS.name(c).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size IN (1, 2, 3) THEN 4 ELSE p_size END AS size FROM part")
def sequential_substitute(t: Tables):
    return t.part.select("p_partkey", numbers.substitute(F.col("p_size"), [(1, 2), (2, 3), (3, 4)]).alias("size"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS is_{s.lower()}" for s in SEGMENTS) + " FROM customer")
def one_hot(t: Tables):
    return t.customer.select("c_custkey", *(c.alias(f"is_{s.lower()}") for c, s in zip(numbers.one_hot(F.col("c_mktsegment"), SEGMENTS), SEGMENTS, strict=True)))


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') THEN c_mktsegment END AS segment FROM customer")
def one_hot_inverse(t: Tables):
    hot = t.customer.select("c_custkey", *(c.alias(s) for c, s in zip(numbers.one_hot(F.col("c_mktsegment"), SEGMENTS), SEGMENTS, strict=True)))
    return hot.select("c_custkey", numbers.one_hot_inverse({s: F.col(s) for s in SEGMENTS}).alias("segment"))


@query("SELECT doc_id, coalesce(quality, 0) AS quality, (quality IS NOT NULL)::INT AS has_quality FROM documents LEFT JOIN labels USING (doc_id)")
def has_flag(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.col("quality").isNotNull().cast("int").alias("has_quality"))


@query("SELECT p_partkey, round((ln(p_retailprice + 1) - m) / s, 5) AS z FROM part, (SELECT avg(ln(p_retailprice + 1)) AS m, stddev_samp(ln(p_retailprice + 1)) AS s FROM part)")
def log1p_center(t: Tables):
    return numbers.z_scores(t.part.withColumn("l", F.log1p("p_retailprice")), ["l"], population=False).select("p_partkey", F.round("l_z", 5).alias("z"))


@query("SELECT p_partkey, round((p_retailprice - m) / s, 5) AS z FROM part, (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part)")
def zscore_pop(t: Tables):
    return numbers.z_scores(t.part, ["p_retailprice"]).select("p_partkey", F.round("p_retailprice_z", 5).alias("z"))


@query("SELECT p_partkey, round((p_size - m) / s, 5) AS z FROM part, (SELECT avg(p_size) AS m, stddev_samp(p_size) AS s FROM part WHERE p_partkey % 5 <> 0)")
def zscore_samp_by_training(t: Tables):
    return numbers.z_scores(t.part, ["p_size"], population=False, fit_on=t.part.where("p_partkey % 5 <> 0")).select("p_partkey", F.round("p_size_z", 5).alias("z"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / nullif(l_quantity + l_tax, 0), 6) AS share FROM lineitem")
def fraction_value(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(numbers.fraction_of(F.col("l_quantity"), F.col("l_tax")), 6).alias("share"))


@query("""SELECT c_nationkey, round((a * 2.5 + b * 7 + c * 12) / nullif(a + b + c, 0), 6) AS mean FROM (SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS a, count(*) FILTER (c_mktsegment = 'FURNITURE') AS b,
count(*) FILTER (c_mktsegment = 'MACHINERY') AS c FROM customer GROUP BY 1)""")
def weighted_midpoint_avg(t: Tables):
    counts = t.customer.groupBy("c_nationkey").agg(*(F.count_if(F.col("c_mktsegment") == s).alias(n) for n, s in (("a", "BUILDING"), ("b", "FURNITURE"), ("c", "MACHINERY"))))
    return counts.select("c_nationkey", F.round(numbers.weighted_midpoint([F.col("a"), F.col("b"), F.col("c")], [2.5, 7.0, 12.0]), 6).alias("mean"))


@query("""SELECT s_suppkey, round(pi() * 6378137.0 * (1 - 0.00669437999014) / 180 / pow(1 - 0.00669437999014 * pow(sin(radians(lat)), 2), 1.5), 3) AS lat_metres,
round(pi() * 6378137.0 / 180 * cos(radians(lat)) / sqrt(1 - 0.00669437999014 * pow(sin(radians(lat)), 2)), 3) AS lon_metres FROM (SELECT s_suppkey, s_suppkey % 90 AS lat FROM supplier)""")
def degree_metres(t: Tables):
    lat = (F.col("s_suppkey") % 90).cast("double")
    return t.supplier.select("s_suppkey", F.round(numbers.metres_per_latitude(lat), 3).alias("lat_metres"), F.round(numbers.metres_per_longitude(lat), 3).alias("lon_metres"))


@query("SELECT c_custkey, floor(c_acctbal * 10 + 0.5) / 10 AS rounded, round(1 / (1 + exp(-c_acctbal / 1000)), 8) AS squashed FROM customer")
def round_and_sigmoid(t: Tables):
    return t.customer.select("c_custkey", numbers.round_half_up(F.col("c_acctbal"), 1).alias("rounded"), F.round(numbers.sigmoid(F.col("c_acctbal") / 1000), 8).alias("squashed"))


@query("SELECT c_custkey, c_nationkey % 4 AS tract, concat_ws('|', c_name, c_mktsegment) AS row, sha256(concat_ws('|', c_name, c_mktsegment)) AS digest, split_part(c_name, '#', 2) AS tail, TRY_CAST(split_part(c_name, '#', 2) AS BIGINT) AS number FROM customer")
def strings(t: Tables):
    row = F.concat_ws("|", "c_name", "c_mktsegment")
    return t.customer.select("c_custkey", (F.col("c_nationkey") % 4).alias("tract"), row.alias("row"), F.sha2(row, 256).alias("digest"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("tail"), F.split_part("c_name", F.lit("#"), F.lit(2)).try_cast("long").alias("number"))
