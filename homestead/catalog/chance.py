"""Splits, samples, codes, rules, matrices, indices and round trips through files."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from homestead.catalog.registry import Tables, query
from homestead.catalog.vectors import NEAR, near
from homestead.functions import codes, dates, vectors
from homestead.operators import aggregates, completion, frame, imputation, models, resampling, sampling, validation, validity
from homestead.shared import shared_dir
from homestead.sources import delimited, observed


def lot(key: str, seed: int) -> str:
    """The SQL of sampling.uniform."""
    return f"(('0x' || left(md5('{seed}:' || CAST({key} AS VARCHAR)), 13))::BIGINT / 4503599627370496::DOUBLE)"


@query(f"SELECT o_orderkey, CASE WHEN {lot('o_orderkey', 3)} < 0.2 THEN 'test' WHEN {lot('o_orderkey', 3)} < 0.8 THEN 'train' ELSE 'validate' END AS part FROM orders")
def split_three_ways(t: Tables):
    return sampling.labelled(t.orders.select("o_orderkey"), "o_orderkey", {"test": 0.2, "train": 0.6, "validate": 0.2}, 3)


@query(f"SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {lot('o_orderkey', 4)}, o_orderkey) <= floor(0.3 * (SELECT count(*) FROM orders) + 0.5) THEN 'train' ELSE 'test' END AS part FROM orders")
def split_exact(t: Tables):
    return sampling.exact_parts(t.orders.select("o_orderkey"), "o_orderkey", {"train": 0.3, "test": 0.7}, 4)


@query(f"SELECT p_partkey, row_number() OVER (ORDER BY {lot('p_partkey', 5)}, p_partkey) AS place FROM part")
def permutation(t: Tables):
    return sampling.permuted(t.part.select("p_partkey"), "p_partkey", 5)


@query(f"SELECT c_custkey FROM customer ORDER BY {lot('c_custkey', 6)}, c_custkey LIMIT 20")
def sample_without_replacement(t: Tables):
    return sampling.sample_rows(t.customer.select("c_custkey"), "c_custkey", 20, 6)


@query(f"""SELECT draw, c_custkey FROM (SELECT draw, CAST(floor({lot('draw', 7)} * (SELECT count(*) FROM customer)) + 1 AS BIGINT) AS place FROM range(1, 101) r(draw))
JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS place FROM customer) USING (place)""")
def sample_with_replacement(t: Tables):
    return sampling.sample_again(t.customer.select("c_custkey"), "c_custkey", 100, 7)


@query(f"""SELECT c_custkey, CAST(floor(u * 6) + 1 AS BIGINT) AS whole, CAST(u < 0.3 AS INTEGER) AS success, CAST(floor(ln(1 - u) / ln(1 - 0.2)) + 1 AS BIGINT) AS trials, round(-ln(1 - u) / 2, 8) AS waiting,
round(tan(pi() * (u - 0.5)), 4) AS cauchy, round(10 + 2 * sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v), 8) AS normal FROM (SELECT c_custkey, {lot('c_custkey', 8)} AS u, {lot('c_custkey', 9)} AS v FROM customer)""")
def random_draws(t: Tables):
    u, v = sampling.uniform(F.col("c_custkey"), 8), sampling.uniform(F.col("c_custkey"), 9)
    return t.customer.select("c_custkey", sampling.whole(u, 1, 6).alias("whole"), sampling.bernoulli(u, 0.3).alias("success"), sampling.geometric(u, 0.2).alias("trials"), F.round(sampling.exponential(u, 2.0), 8).alias("waiting"), F.round(sampling.cauchy(u), 4).alias("cauchy"), F.round(sampling.gaussian(u, v, 10.0, 2.0), 8).alias("normal"))


def coded(t: Tables):
    """Orders with made-up codes of a deed, a transaction, a sale and a property."""
    k = F.col("o_orderkey")
    deed = F.element_at(F.array(*(F.lit(x) for x in ("G", "T", "C", "CD", "QQ"))), (k % 5 + 1).cast("int"))
    return t.orders.select("o_orderkey", "o_totalprice", deed.alias("deed"), (k % 10).alias("transaction"), F.when(k % 4 != 0, F.substring(F.lit("FLPRUV"), (k % 6 + 1).cast("int"), F.lit(1))).alias("sale"), (k % 7 * 10 + k % 3).alias("property"))


CODED = "(SELECT o_orderkey, o_totalprice, ['G', 'T', 'C', 'CD', 'QQ'][o_orderkey % 5 + 1] AS deed, o_orderkey % 10 AS transaction, CASE WHEN o_orderkey % 4 <> 0 THEN substr('FLPRUV', o_orderkey % 6 + 1, 1) END AS sale, o_orderkey % 7 * 10 + o_orderkey % 3 AS property FROM orders)"


@query(f"""SELECT o_orderkey, CASE deed WHEN 'G' THEN 'grant.deed' WHEN 'T' THEN 'deed.of.trust' WHEN 'C' THEN 'construction.loan' WHEN 'CD' THEN 'correction.deed' ELSE 'unknown code' END AS deed_name,
coalesce(sale IN ('L', 'P'), false) AS partial, property IN (50, 51, 52) AS industrial, property IN (10, 11, 12, 22) AS residential FROM {CODED}""")
def code_names(t: Tables):
    rows = codes.named(coded(t), "deed", codes.DEEDS, "deed_name")
    return rows.select("o_orderkey", "deed_name", codes.SALES.has(F.col("sale"), "sale.price.partial").alias("partial"), codes.PROPERTIES.has(F.col("property"), "any.industrial").alias("industrial"), codes.any_residential(F.col("property")).alias("residential"))


@query(f"""SELECT o_orderkey, CASE WHEN NOT (o_totalprice > 0 AND o_totalprice <= 85e6) THEN 'price' WHEN deed NOT IN ('G', 'T') THEN 'deed' WHEN transaction NOT IN (1, 3) THEN 'transaction'
WHEN NOT coalesce(sale = 'F', false) THEN 'sale_code' END AS reason FROM {CODED}""")
def sale_rule_reasons(t: Tables):
    rules = validity.sale_rules({"price": "o_totalprice", "deed": "deed", "transaction": "transaction", "sale_code": "sale"})
    return validity.with_reason(coded(t), rules).select("o_orderkey", "reason")


@query("""WITH f AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN '' WHEN l_orderkey % 7 = 0 THEN l_orderkey || 'x' WHEN l_orderkey % 11 = 0 THEN '200013' || lpad((l_orderkey % 29)::VARCHAR, 2, '0') ELSE CAST(l_partkey AS VARCHAR) END AS s FROM lineitem)
SELECT 'long' AS filter, count(*) FILTER (TRY_CAST(s AS BIGINT) IS NOT NULL) AS passing FROM f UNION ALL SELECT 'long or empty', count(*) FILTER (s = '' OR TRY_CAST(s AS BIGINT) IS NOT NULL) FROM f
UNION ALL SELECT 'long > 1775', count(*) FILTER (TRY_CAST(s AS BIGINT) > 1775) FROM f UNION ALL SELECT 'long in [1, 5]', count(*) FILTER (TRY_CAST(s AS BIGINT) BETWEEN 1 AND 5) FROM f
UNION ALL SELECT 'long in [100, 400]', count(*) FILTER (TRY_CAST(s AS BIGINT) BETWEEN 100 AND 400) FROM f UNION ALL SELECT 'string not empty', count(*) FILTER (s <> '') FROM f
UNION ALL SELECT 'Y N space empty', count(*) FILTER (s IN ('Y', 'N', ' ', '')) FROM f UNION ALL SELECT 'date', 0 FROM (SELECT 1)""")
def field_filter_counts(t: Tables):
    k = F.col("l_orderkey")
    text = F.when(k % 5 == 0, "").when(k % 7 == 0, F.concat(k.cast("string"), F.lit("x"))).when(k % 11 == 0, F.concat(F.lit("200013"), F.lpad((k % 29).cast("string"), 2, "0"))).otherwise(F.col("l_partkey").cast("string"))
    names = ("long", "long or empty", "long > 1775", "long in [1, 5]", "long in [100, 400]", "string not empty", "Y N space empty", "date")
    wide = t.lineitem.select(text.alias("s")).agg(*(F.count_if(F.coalesce(validity.FIELD_FILTERS[n](F.col("s")), F.lit(False))).alias(n) for n in names))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("filter"), F.col(f"`{n}`").alias("passing")) for n in names))).alias("r")).select("r.*")


@query("""SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, round(median(o_totalprice), 4) AS median_price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""")
def median_by_key_year_month(t: Tables):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("n_name", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_totalprice")
    return aggregates.group_quantiles(rows, ["n_name", "year", "month"], "o_totalprice", {"median_price": 0.5}, at_most=t.orders.count()).withColumn("median_price", F.round("median_price", 4))


@query("""WITH i AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, avg(o_totalprice) AS level FROM orders GROUP BY 1, 2),
now AS (SELECT regr_intercept(level, m) + 13 * regr_slope(level, m) AS level FROM i WHERE y = 1997 AND m > 6),
last AS (SELECT o_custkey, o_totalprice, year(o_orderdate) AS y, month(o_orderdate) AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders)
SELECT c_custkey, round(o_totalprice * now.level / i.level, 2) AS estimate FROM customer LEFT JOIN last ON o_custkey = c_custkey AND r = 1 LEFT JOIN i USING (y, m), now""")
def index_model_estimates(t: Tables):
    index = t.orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("level"))
    now = models.extrapolated_index(index, 1997, 6)
    sales = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return models.index_model(t.customer.select("c_custkey"), sales, index, "c_custkey", "o_orderdate", ["o_orderkey"], "o_totalprice", now).withColumn("estimate", F.round("estimate", 2))


@query("""WITH a AS (SELECT l_suppkey AS i, l_linenumber AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT l_linenumber AS i, CAST(l_tax * 100 AS INTEGER) AS j, sum(l_discount) AS v FROM lineitem GROUP BY 1, 2)
SELECT a.i AS i, b.j AS j, round(sum(a.v * b.v), 2) AS v FROM a JOIN b ON a.j = b.i GROUP BY 1, 2""")
def matrix_product(t: Tables):
    a = t.lineitem.groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j")).agg(F.sum("l_quantity").alias("v"))
    b = t.lineitem.groupBy(F.col("l_linenumber").alias("i"), F.round(F.col("l_tax") * 100).cast("int").alias("j")).agg(F.sum("l_discount").alias("v"))
    return vectors.sparse_product(a, b).withColumn("v", F.round("v", 2))


@query("""SELECT vec_id, round(v[1] * v[1] + v[2] * v[2], 5) AS first, round(v[2] * v[1] + v[3] * v[2], 5) AS second, len(list_filter(v, lambda x: isnan(x))) > 0 AS nan, len(list_filter(v, lambda x: x <> 0)) = 0 AS zero
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")
def small_matrices(t: Tables):
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = F.array(F.array(v[0], v[1]), F.array(v[1], v[2]))
    product = vectors.times_vector(rows, F.slice(v, 1, 2))
    return t.embeddings.select("vec_id", F.round(product[0], 5).alias("first"), F.round(product[1], 5).alias("second"), vectors.has_nan(v).alias("nan"), vectors.all_zero(v).alias("zero"))


@query("""WITH s AS (SELECT avg(o_totalprice) AS m, avg(ln(o_totalprice)) AS ml, stddev_pop(ln(o_totalprice)) AS sl FROM orders WHERE o_totalprice > 0), g AS (SELECT *, ln(m) - ml AS gap FROM s),
k AS (SELECT *, (3 - gap + sqrt(pow(gap - 3, 2) + 24 * gap)) / (12 * gap) AS shape, pi() / sqrt(6) / sl AS steep FROM g)
SELECT 'lognormal' AS distribution, round(ml, 6) AS first, round(sl, 6) AS second FROM k UNION ALL SELECT 'gamma', round(shape, 6), round(shape / m, 9) FROM k UNION ALL SELECT 'weibull', round(steep, 6), round(exp(ml + 0.5772156649015329 / steep), 3) FROM k""")
def distribution_fits(t: Tables):
    fits = resampling.fitted_distributions(t.orders, "o_totalprice")
    digits = F.when(F.col("distribution") == "gamma", F.round("second", 9)).when(F.col("distribution") == "weibull", F.round("second", 3)).otherwise(F.round("second", 6))
    return fits.select("distribution", F.round("first", 6).alias("first"), digits.alias("second"))


LOT = "(('0x' || left(md5('1:' || k || ':' || r), 13))::BIGINT / 4503599627370496::DOUBLE)"
_CUTS = [sum(0.36787944117144233 / math.factorial(j) for j in range(i + 1)) for i in range(8)]
WEIGHT = "(" + " + ".join(f"(u >= {c!r})::INT" for c in _CUTS) + ")"
TWO = "(SELECT c_custkey AS k, c_mktsegment = 'BUILDING' AS a, c_acctbal AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))"


@query(f"""WITH rows AS {TWO}, w AS (SELECT r, a, v, u, {WEIGHT} AS w FROM (SELECT r, a, v, {LOT} AS u FROM rows, range(1, 201) s(r))),
d AS (SELECT r, sum(v * w) FILTER (a) / sum(w) FILTER (a) - sum(v * w) FILTER (NOT a) / sum(w) FILTER (NOT a) AS d FROM w GROUP BY r)
SELECT round(avg(d), 4) AS difference, round(quantile_cont(d, 0.025), 4) AS low, round(quantile_cont(d, 0.975), 4) AS high FROM d""")
def bootstrap_ci(t: Tables):
    """Difference of mean balances between two segments, with its interval."""
    out = resampling.bootstrap_difference(t.customer, "c_mktsegment", "BUILDING", "MACHINERY", "c_acctbal", 200, key="c_custkey")
    return out.select(*(F.round(c, 4).alias(c) for c in out.columns))


@query(f"""WITH rows AS {TWO}, o AS (SELECT avg(v) FILTER (a) - avg(v) FILTER (NOT a) AS observed, avg(a::INT) AS share FROM rows),
d AS (SELECT r, observed, avg(v) FILTER (u < share) - avg(v) FILTER (u >= share) AS d FROM (SELECT r, v, {LOT} AS u FROM rows, range(1, 201) s(r)), o GROUP BY r, observed)
SELECT round(observed, 4) AS observed, round(avg((CASE WHEN observed < 0 THEN d <= observed ELSE d >= observed END)::INT), 6) AS probability FROM d GROUP BY observed""")
def mean_difference_significance(t: Tables):
    """How often rows dealt anew to two segments differ as much in mean balance."""
    out = resampling.difference_significance(t.customer, "c_custkey", "c_mktsegment", "BUILDING", "MACHINERY", "c_acctbal", 200)
    return out.select(F.round("observed", 4).alias("observed"), F.round("probability", 6).alias("probability"))


def normal(z: str) -> str:
    """The SQL of resampling.normal_cdf."""
    return f"(CASE WHEN {z} > 8 THEN 1.0 WHEN {z} < -8 THEN 0.0 ELSE 0.5 + exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_reduce([{{'n': 0, 't': CAST({z} AS DOUBLE), 's': CAST({z} AS DOUBLE)}}] || list_transform(range(1, 201), lambda n: {{'n': n, 't': 0.0::DOUBLE, 's': 0.0::DOUBLE}}), lambda s, n: {{'n': n.n, 't': s.t * {z} * {z} / (2 * n.n + 1), 's': s.s + s.t * {z} * {z} / (2 * n.n + 1)}}).s END)"


def quantile(p: str) -> str:
    """The SQL of resampling.normal_quantile."""
    e = lambda c: f"list_transform([{c}], lambda m: {normal('m')})[1]"
    return f"list_transform([list_reduce([{{'a': -8.0::DOUBLE, 'b': 8.0::DOUBLE}}] || list_transform(range(60), lambda n: {{'a': 0.0::DOUBLE, 'b': 0.0::DOUBLE}}), lambda q, n: CASE WHEN {e('(q.a + q.b) / 2')} < {p} THEN {{'a': (q.a + q.b) / 2, 'b': q.b}} ELSE {{'a': q.a, 'b': (q.a + q.b) / 2}} END)], lambda q: (q.a + q.b) / 2)[1]"


@query(f"""WITH w AS (SELECT r, v, {WEIGHT} AS w FROM (SELECT r, v, {LOT} AS u FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal IS NOT NULL), range(1, 201) s(r))),
m AS (SELECT r, sum(v * w) / sum(w) AS m FROM w GROUP BY r), o AS (SELECT avg(c_acctbal) AS mean FROM customer),
k AS (SELECT mean, avg((m < mean)::INT) AS below, list_sort(list(m)) AS ms FROM m, o GROUP BY mean), q AS (SELECT *, {quantile('below')} AS z0, {quantile('0.95')} AS z FROM k),
e AS (SELECT *, 2 * z0 - z AS zl, 2 * z0 + z AS zh FROM q), c AS (SELECT *, {normal('zl')} AS sl, {normal('zh')} AS sh FROM e)
SELECT round(mean, 4) AS mean, round(ms[1 + least(len(ms) - 1, floor(sl * len(ms)))::BIGINT], 4) AS low, round(ms[1 + least(len(ms) - 1, floor(sh * len(ms)))::BIGINT], 4) AS high FROM c""")
def mean_bias_corrected(t: Tables):
    """The mean balance and its bias-corrected interval."""
    out = resampling.mean_interval(t.customer, "c_custkey", "c_acctbal", 200)
    return out.select(*(F.round(c, 4).alias(c) for c in out.columns))


@query(f"""WITH v AS (SELECT o_totalprice AS x FROM orders WHERE o_totalprice > 0), s AS (SELECT avg(x) AS m, avg(ln(x)) AS ml, stddev_pop(ln(x)) AS sl FROM v), g AS (SELECT *, ln(m) - ml AS gap FROM s),
k AS (SELECT *, (3 - gap + sqrt(pow(gap - 3, 2) + 24 * gap)) / (12 * gap) AS shape, 1.2825498301618641 / sl AS steep FROM g),
c AS (SELECT x, count(*) AS n FROM v GROUP BY x), e AS (SELECT x, (sum(n) OVER (ORDER BY x) - n) / sum(n) OVER () AS below, sum(n) OVER (ORDER BY x) / sum(n) OVER () AS upto FROM c),
p AS (SELECT e.*, (ln(x) - ml) / sl AS z, x * shape / m AS y, shape, 1 - exp(-pow(x / exp(ml + 0.5772156649015329 / steep), steep)) AS weibull FROM e, k),
f AS (SELECT below, upto, weibull, {normal('z')} AS lognormal, CASE WHEN y > shape + 8 * sqrt(shape) + 40 THEN 1.0 ELSE exp(shape * ln(y) - y - lgamma(shape + 1)) *
list_reduce([{{'n': 0, 't': 1.0::DOUBLE, 's': 1.0::DOUBLE}}] || list_transform(range(1, 201), lambda n: {{'n': n, 't': 0.0::DOUBLE, 's': 0.0::DOUBLE}}), lambda s, n: {{'n': n.n, 't': s.t * y / (shape + n.n), 's': s.s + s.t * y / (shape + n.n)}}).s END AS gamma FROM p)
SELECT 'lognormal' AS distribution, round(max(greatest(abs(lognormal - below), abs(lognormal - upto))), 6) AS distance FROM f UNION ALL SELECT 'gamma', round(max(greatest(abs(gamma - below), abs(gamma - upto))), 6) FROM f
UNION ALL SELECT 'weibull', round(max(greatest(abs(weibull - below), abs(weibull - upto))), 6) FROM f""")
def fit_distance(t: Tables):
    """How far each fitted distribution of prices is from the empirical one at most."""
    return resampling.fit_distances(t.orders, "o_totalprice").withColumn("distance", F.round("distance", 6))


def weighted_near(t: Tables):
    """The ten neighbours of each stated query with their whole vectors, labels and equal weights."""
    rows = t.embeddings.select("vec_id", F.col("embedding").alias("x"))
    found = near(t).select("query", "neighbour", "label")
    found = found.join(rows.withColumnRenamed("vec_id", "neighbour"), "neighbour")
    return found.join(rows.select(F.col("vec_id").alias("query"), F.col("x").alias("at")), "query").withColumn("w", F.lit(1.0))


@query(f"""WITH {NEAR}, x AS (SELECT query, near.label, unnest(range(1, len(e.embedding) + 1)) AS i, unnest(CAST(e.embedding AS DOUBLE[])) AS x, unnest(CAST(q.embedding AS DOUBLE[])) AS place FROM near JOIN embeddings e ON e.vec_id = neighbour JOIN embeddings q ON q.vec_id = query),
d AS (SELECT query, label, i, count(*) AS n, avg(x) AS m, stddev_pop(x) AS s, any_value(place) AS place FROM x GROUP BY 1, 2, 3),
o AS (SELECT query, label, ln(any_value(n)) + sum(CASE WHEN s > 0 THEN -ln(s) - pow((place - m) / s, 2) / 2 WHEN place = m THEN 0.0 ELSE -1e6 END) AS z FROM d GROUP BY 1, 2)
SELECT query, CAST(arg_min(label, (-z, label)) AS BIGINT) AS predicted, round(1 / sum(exp(z - top)), 6) AS probability FROM (SELECT *, max(z) OVER (PARTITION BY query) AS top FROM o) GROUP BY query""")
def impute_naive_bayes(t: Tables):
    """The label of each stated query from its neighbours, by local naive Bayes."""
    return imputation.impute(weighted_near(t), "x", "at", "label", "w").withColumn("probability", F.round("probability", 6))


@query()
def impute_logistic(t: Tables):
    """The label of each stated query from its neighbours, by local logistic regression."""
    return imputation.impute(weighted_near(t), "x", "at", "label", "w", imputation.logistic_at).withColumn("probability", F.round("probability", 6))


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS c_acctbal FROM customer")
def delimited_round_trip(t: Tables):
    """Customers written as delimited text with missing values and read again by type."""
    path = shared_dir(t.spark, "delimited")
    delimited.write_delimited(t.customer.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("c_acctbal")), path)
    return delimited.read_delimited(t.spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("SELECT n_nationkey, n_name FROM nation")
def pairs_round_trip(t: Tables):
    path = shared_dir(t.spark, "pairs")
    delimited.write_pairs(t.nation, path, "n_nationkey", "n_name")
    return delimited.read_pairs(t.spark, path).select(F.col("key").cast("int").alias("n_nationkey"), F.col("value").alias("n_name"))


@query("SELECT s_suppkey, s_acctbal, s_nationkey FROM supplier")
def columns_round_trip(t: Tables):
    """Suppliers in a column store by nation, of which two columns and the nation are read."""
    path = shared_dir(t.spark, "columns")
    delimited.write_partitioned(t.supplier, path, ["s_nationkey"])
    return delimited.read_columns(t.spark, path, ["s_suppkey", "s_acctbal", "s_nationkey"])


@query("SELECT CAST(p_partkey AS VARCHAR) AS a, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS b, p_partkey % 4 = 0 AS rejected FROM part")
def checked_records(t: Tables):
    """Records of two fields and, beside them, those whose number of fields is another."""
    path = shared_dir(t.spark, "records")
    t.part.select(F.when(F.col("p_partkey") % 4 == 0, F.col("p_partkey").cast("string")).otherwise(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_brand")).alias("value")).write.text(path)
    good, bad = delimited.read_checked(t.spark, path, ["a", "b"])
    return good.withColumn("rejected", F.lit(False)).unionByName(bad.select(F.col("line").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(True).alias("rejected")))


@query("SELECT o_orderkey, day(o_orderdate) = 15 AND month(o_orderdate) IN (2, 5, 8, 11) AS mid, make_date(CAST(year(o_orderdate) AS BIGINT), CAST(quarter(o_orderdate) * 3 - 1 AS BIGINT), 15) AS quarter_day, make_date(CAST(year(o_orderdate) AS BIGINT), CAST(month(o_orderdate) AS BIGINT), 15) AS month_day FROM orders")
def date_indices_and_back(t: Tables):
    day = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", dates.is_mid_quarter(day).alias("mid"), dates.quarter_of(dates.quarter_index(day, 1984), 1984).alias("quarter_day"), dates.month_of(dates.month_index(day, 1984), 1984).alias("month_day"))


@query("SELECT place, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders) WHERE place % 97 = 5")
def rows_by_ordinal(t: Tables):
    places = t.spark.range(5, t.orders.count() + 1, 97).select(F.col("id").alias("place"))
    return frame.rows_at(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], places, "place").select("place", "o_orderkey")


@query("SELECT doc_id, (quality IS NOT NULL)::INT AS has_quality, (quality IS NULL)::INT AS has_not_quality, (toxic IS NOT NULL)::INT AS has_toxic, (toxic IS NULL)::INT AS has_not_toxic FROM documents LEFT JOIN labels USING (doc_id)")
def has_indicators(t: Tables):
    return frame.has_indicators(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), ["quality", "toxic"], ["doc_id"])


def low_rank(t: Tables):
    """A matrix of rank 2 over parcels (numbers of ten digits) and months, of which a part of the cells is known."""
    k, m = F.col("c_custkey"), F.col("m")
    value = (1 + k % 7) * (10 + m) + (k % 5) * (m % 4)
    cells = t.customer.select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("m"))
    return cells.select((7_000_000_000 + k).alias("parcel"), m.alias("month"), value.cast("double").alias("price"), ((k * 31 + m * 17) % 10 < 7).alias("known"))


KNOWN_CELLS = "(SELECT 7000000000 + c_custkey AS parcel, m AS month FROM customer, range(1, 13) r(m) WHERE (c_custkey * 31 + m * 17) % 10 < 7)"


@query(f"""WITH h AS (SELECT *, {lot("parcel || ':' || month", 1)} < 0.2 AS held FROM {KNOWN_CELLS}), t AS (SELECT * FROM h WHERE NOT held),
n AS (SELECT count(*) AS cells FROM h WHERE held AND parcel IN (SELECT parcel FROM t) AND month IN (SELECT month FROM t))
SELECT CAST(rank AS INTEGER) AS rank, 0.0001::DOUBLE AS ridge, cells, rank > 1 AS close FROM n, (VALUES (1), (2)) r(rank)""")
def completion_ranks(t: Tables):
    """Completions of a matrix of rank 2: over the same held-out cells that of rank 2 is close, that of rank 1 is not."""
    cells = low_rank(t).where("known").select("parcel", "month", "price")
    out = completion.completion_search(cells, "parcel", "month", "price", [1, 2], [1e-4], iterations=20)
    return out.select("rank", "ridge", "cells", (F.col("rmse_determined") < 0.1).alias("close"))


@query("""WITH r AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'fields' WHEN o_orderkey % 13 = 0 THEN 'price' WHEN o_totalprice > 400000 THEN 'not huge' WHEN o_orderpriority = '5-LOW' THEN 'urgent' END AS reason FROM orders),
m AS (SELECT 0 AS place, 'lines' AS metric, count(*) AS value FROM r UNION ALL SELECT 1, 'kept', count(*) FILTER (reason IS NULL) FROM r UNION ALL SELECT 2, 'rejected', count(*) FILTER (reason IS NOT NULL) FROM r
UNION ALL SELECT 3 + i, 'rejected by ' || n, (SELECT count(*) FROM r WHERE reason = n) FROM (VALUES (0, 'fields'), (1, 'key'), (2, 'price'), (3, 'priority'), (4, 'not huge'), (5, 'urgent')) v(i, n)
UNION ALL SELECT 9, 'kept rows', count(*) FILTER (reason IS NULL) FROM r UNION ALL SELECT 10, 'reject rows', count(*) FILTER (reason IS NOT NULL) FROM r)
SELECT 'orders' AS section, CAST(place AS INTEGER) AS place, metric, value FROM m""")
def scan_report(t: Tables):
    """What a scan of order lines kept and rejected, counted while it ran, and the rows of both tables that it wrote."""
    path = shared_dir(t.spark, "lines")
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    k = F.col("o_orderkey")
    t.orders.select(F.when(k % 11 == 0, F.concat_ws("\t", key, price)).otherwise(F.concat_ws("\t", key, F.when(k % 13 == 0, "?").otherwise(price), "o_orderpriority")).alias("value")).write.text(path)
    rules = {"not huge": F.col("price") <= 400000, "urgent": F.col("priority") != "5-LOW"}
    good, bad, counts = observed.checked_scan(t.spark, path, "key long, price double, priority string", rules)
    return observed.report(t.spark, {"orders": counts | {"kept rows": good.count(), "reject rows": bad.count()}})


@query("""SELECT c_custkey, c_name, c_acctbal, coalesce(n, 0) AS n_orders, round(coalesce(total, 0), 2) AS total, first_order, coalesce(s, 0) AS n_suppliers FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total, min(o_orderkey) AS first_order FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = c_custkey""")
def record_types_round_trip(t: Tables):
    """Customers with their orders and the suppliers of the nation of that number, written as files of three kinds of records and read again."""
    path = shared_dir(t.spark, "groups")
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    near = t.supplier.select(F.col("s_nationkey").cast("long").alias("c_custkey"), "s_suppkey")
    observed.write_groups(t.customer.select("c_custkey", "c_name", "c_acctbal"), {"B": orders, "C": near}, "c_custkey", path)
    rows = observed.read_groups(t.spark, path, "c_custkey long, c_name string, c_acctbal double", {"B": "o_orderkey long, o_totalprice double", "C": "s_suppkey long"})
    total = F.aggregate("B", F.lit(0.0), lambda s, x: s + x["o_totalprice"])
    return rows.select("c_custkey", "c_name", "c_acctbal", F.size("B").cast("long").alias("n_orders"), F.round(total, 2).alias("total"), F.get("B", F.lit(0))["o_orderkey"].alias("first_order"), F.size("C").cast("long").alias("n_suppliers"))
