"""Vectors, neighbours and kernels. Queries of searches are the rows whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from homestead.catalog.registry import Tables, query
from homestead.functions import numbers, vectors
from homestead.operators import neighbors

D2 = "list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
NEAR = f"""near AS (SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, b.label AS label, sqrt({D2}) AS distance,
CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt({D2}), b.vec_id) AS INTEGER) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 10)"""


def near(t: Tables, k: int = 10):
    return neighbors.nearest(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, k, "vec_id", "vec_id", "embedding", ["label"])


@query(f"WITH {NEAR} SELECT query, neighbour, round(distance, 5) AS distance, rank FROM near")
def euclid_topk(t: Tables):
    return near(t).select("query", "neighbour", F.round("distance", 5).alias("distance"), "rank")


@query(f"WITH {NEAR} SELECT query, round(avg(label), 6) AS estimate FROM near WHERE rank <= 5 GROUP BY query HAVING count(*) >= 5")
def knn_avg(t: Tables):
    return neighbors.knn_average(near(t), "label", 5).withColumn("estimate", F.round("estimate", 6))


@query(f"WITH {NEAR} SELECT query, rank, round(avg(label) OVER (PARTITION BY query ORDER BY rank), 6) AS estimate FROM near")
def prefix_avg_by_rank(t: Tables):
    return neighbors.prefix_averages(near(t), "label").select("query", "rank", F.round("estimate", 6).alias("estimate"))


@query(f"""WITH {NEAR}, w AS (SELECT query, label, 0.75 * (1 - pow(distance / max(distance) OVER (PARTITION BY query), 2)) AS w FROM near)
SELECT query, round(sum(w * label) / nullif(sum(w), 0), 5) AS estimate FROM w GROUP BY query""")
def kernel_epan_avg(t: Tables):
    return neighbors.kernel_average(near(t), "label", 10).withColumn("estimate", F.round("estimate", 5))


@query(f"""WITH {NEAR}, w AS (SELECT *, exp(-distance * distance / 2.0) AS raw FROM near)
SELECT query, neighbour, round(raw / sum(raw) OVER (PARTITION BY query), 6) AS weight FROM w""")
def kernel_gauss_norm(t: Tables):
    return neighbors.gaussian_weights(near(t), 2.0).select("query", "neighbour", F.round("weight", 6).alias("weight"))


@query(f"""WITH {NEAR}, s AS (SELECT query, label, sum(exp(-distance * distance / 2.0)) AS s FROM near GROUP BY query, label)
SELECT query, arg_min(label, (-s, label)) AS vote FROM s GROUP BY query""")
def class_vote(t: Tables):
    return neighbors.class_vote(near(t), "label", 2.0)


@query(f"WITH {NEAR} SELECT query, round((any_value(e.label) + sum(near.label)) / 5.0, 6) AS estimate FROM near JOIN embeddings e ON e.vec_id = query WHERE rank <= 4 GROUP BY query")
def knn_smooth(t: Tables):
    own = t.embeddings.select(F.col("vec_id").alias("query"), "label")
    return neighbors.smooth(near(t), own, "label", 5).withColumn("estimate", F.round("estimate", 6))


@query(f"WITH {NEAR} SELECT query, round(sum(exp(-distance * distance / 2.0) * label) / sum(exp(-distance * distance / 2.0)), 5) AS estimate FROM near GROUP BY query")
def loo_weighted_avg(t: Tables):
    w = neighbors.gaussian_weights(near(t), 2.0)
    return w.groupBy("query").agg(F.round(F.sum(F.col("weight") * F.col("label")), 5).alias("estimate"))


ROUTE = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(list_reverse(embedding) AS DOUBLE[]) AS r FROM embeddings)"


@query(f"SELECT vec_id, round(list_sum(list_transform(list_zip(v, r), lambda p: p[1] * p[2])), 5) AS product, round(list_sum(list_transform(list_zip(v, r), lambda p: abs(p[1] - p[2]))), 5) AS distance1, round(sqrt(list_sum(list_transform(list_zip(v, r), lambda p: pow(p[1] - p[2], 2)))), 5) AS distance2 FROM {ROUTE}")
def dot_and_distances(t: Tables):
    a, b = F.col("embedding"), F.reverse("embedding")
    return t.embeddings.select("vec_id", F.round(vectors.dot(a, b), 5).alias("product"), F.round(vectors.p_distance(a, b, 1), 5).alias("distance1"), F.round(vectors.euclidean(a, b), 5).alias("distance2"))


@query(f"SELECT vec_id, CAST(list_position(v, list_max(v)) AS BIGINT) AS top, CAST(len(v) + 1 AS INTEGER) AS width, round(list_sum(v) - v[1], 5) AS rest FROM {ROUTE}")
def array_functions(t: Tables):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", vectors.argmax(v).alias("top"), F.size(vectors.with_bias(v)).alias("width"), F.round(vectors.total(vectors.without(v, F.lit(1))), 5).alias("rest"))


@query("""SELECT vec_id, round(exp(v[1] - m) / s, 6) AS first, round((exp(v[1] - m) + exp(v[2] - m)) / s, 6) AS two FROM (SELECT vec_id, v, m, list_sum(list_transform(v, lambda x: exp(x - m))) AS s FROM
(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(list_max(embedding) AS DOUBLE) AS m FROM embeddings))""")
def softmax(t: Tables):
    p = numbers.softmax(F.transform("embedding", lambda x: x.cast("double")))
    return t.embeddings.select("vec_id", p.alias("p")).select("vec_id", F.round(F.col("p")[0], 6).alias("first"), F.round(F.col("p")[0] + F.col("p")[1], 6).alias("two"))


def places(t: Tables):
    """Suppliers as places: latitude, longitude and year from their keys, a value that some lack."""
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("id"), (30 + (k * 37 % 1000) / 500).alias("lat"), (-118 + (k * 91 % 1000) / 500).alias("lon"), (2000 + k % 9).cast("double").alias("year"), F.when(k % 4 != 0, F.col("s_acctbal")).alias("y"))


PLACES = "p AS (SELECT s_suppkey AS id, 30 + (s_suppkey * 37 % 1000) / 500 AS lat, -118 + (s_suppkey * 91 % 1000) / 500 AS lon, CAST(2000 + s_suppkey % 9 AS DOUBLE) AS year, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS y FROM supplier)"
LAT = "(pi() * 6378137.0 * (1 - 0.00669437999014) / 180 / pow(1 - 0.00669437999014 * pow(sin(radians((a.lat + b.lat) / 2)), 2), 1.5))"
LON = "(pi() * 6378137.0 / 180 * cos(radians((a.lat + b.lat) / 2)) / sqrt(1 - 0.00669437999014 * pow(sin(radians((a.lat + b.lat) / 2)), 2)))"
BOTH = f"""{PLACES}, d AS (SELECT a.id AS query, b.id AS id, b.y AS y, pow((b.lat - a.lat) * {LAT}, 2) + pow((b.lon - a.lon) * {LON}, 2) AS space2, pow(b.year - a.year, 2) AS time2 FROM p a, p b WHERE a.id % 100 = 0),
c AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY space2, id) AS rs, row_number() OVER (PARTITION BY query ORDER BY time2, id) AS rt FROM d)"""


@query(f"""WITH {BOTH} SELECT query, id, round(distance, 2) AS distance, rank FROM (SELECT query, id, sqrt(space2 + time2 * 1e8) AS distance,
CAST(row_number() OVER (PARTITION BY query ORDER BY sqrt(space2 + time2 * 1e8), id) AS INTEGER) AS rank FROM c WHERE (rs <= 20 OR rt <= 20) AND y IS NOT NULL) WHERE rank <= 5""")
def space_time_two_stage(t: Tables):
    rows = places(t)
    found = neighbors.space_time_nearest(neighbors.space_time_candidates(rows.where("id % 100 = 0"), rows, 20), 5, 10_000.0)
    return found.select("query", "id", F.round("distance", 2).alias("distance"), "rank")


@query(f"""WITH {BOTH} SELECT query, id, round(sqrt(space2 + time2 * 1e6), 2) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sqrt(space2 + time2 * 1e6), id) AS r FROM d) WHERE r <= 10""")
def surface_distance_topk(t: Tables):
    rows = places(t)
    return neighbors.surface_nearest(rows.where("id % 100 = 0"), rows, 10, 1000.0).select("query", F.col("neighbour").alias("id"), F.round("distance", 2).alias("distance"))
