"""Hard negatives from bit-sliced integer products.

Vectors become integers. A row's score for an anchor is their inner product, summed over the bit-planes of the row's
components, the most significant (the signs) first: after each plane what the rest can add lies between two bounds, so
each score has an interval that halves from plane to plane. A row is dropped for an anchor as soon as its interval
cannot reach the worst of the best found so far (positives) or lies outside all the windows that the positives' scores
open (negatives). What is left after the last plane has its exact score, so nothing is lost.

Anchors are a stated set. They are taken in blocks of bounded size, each of which goes over all rows twice: for
the positives, then for the negatives inside the windows. Tasks keep the best rows of an anchor only, so what is
shuffled does not grow with the rows of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from homestead.llm.common import table, written

#: Anchors of one block by number and by the bytes of their vectors, which are what is broadcast.
BLOCK_ROWS, BLOCK_BYTES = 8192, 32 << 20
#: Anchors and components whose products are held at once.
AT_ONCE, CELLS = 64, 1 << 19
#: A component is floor(SCALE * x), held within LIMIT, so that sums over thousands of components are exact in a double.
SCALE, LIMIT = 256, 1 << 20


def quantized(ids: pa.Array, labels: pa.Array, vectors: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and integer components of the rows without null and with finite components only; shorter vectors end in zeros.

    width: components beyond it are left out (they meet zeros).
    """
    if isinstance(vectors, pa.ChunkedArray):
        ids, labels, vectors = (x.combine_chunks() for x in (ids, labels, vectors))
    length = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(length) - length
    bad = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(~np.isfinite(flat), out=bad[1:])
    known = [x.is_valid().to_numpy(zero_copy_only=False) for x in (ids, labels, vectors)]
    use = np.flatnonzero(known[0] & known[1] & known[2] & (bad[begin + length] == bad[begin]))
    width = int(length[use].max(initial=0)) if width is None else width
    out = np.zeros((len(use), width), np.int64)
    whole = np.clip(np.floor(SCALE * np.where(np.isfinite(flat), flat, 0)), -LIMIT, LIMIT - 1).astype(np.int64)
    for n in np.unique(length[use]):
        these, m = np.flatnonzero(length[use] == n), min(int(n), width)
        if m:
            out[these, :m] = whole[begin[use[these]][:, None] + np.arange(m)]
    column = lambda x: x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[use]
    return column(ids), column(labels), out


def _largest(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -inf if there are fewer."""
    n = values.shape[1]
    return np.partition(values, n - k, axis=1)[:, n - k] if n >= k else np.full(len(values), -np.inf)


def sliced(a: np.ndarray, v: np.ndarray, alive: np.ndarray, qualify) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rows of v that are left for any anchor, their scores, and for which anchors each is left.

    alive: anchors x rows. qualify(alive, low, high): what is left, given the bounds of all scores.
    """
    bits = max(int(v.max(initial=0)), -int(v.min(initial=0)) - 1, 0).bit_length()
    down, up = np.minimum(a, 0).sum(1)[:, None], np.maximum(a, 0).sum(1)[:, None]
    places = np.flatnonzero(alive.any(0))
    v, alive = v[places], alive[:, places]
    score = np.zeros(alive.shape)
    for j in range(bits, -1, -1):
        plane = ((v >> j) & 1).astype(np.float64)
        score += (-(1 << bits) if j == bits else 1 << j) * (a @ plane.T)
        rest = (1 << j) - 1
        alive = qualify(alive, score + rest * down, score + rest * up)
        left = alive.any(0)
        if not left.any():
            return places[:0], score[:, :0], alive[:, :0]
        if left.mean() < 0.9 or not j:
            places, v, alive, score = places[left], v[left], alive[:, left], score[:, left]
    return places, score, alive


class Best:
    """The k best rows of each of several lists by score, then by smaller id."""

    def __init__(self, lists: int, k: int):
        self.k, self.ids, self.scores = k, np.zeros((lists, k), np.int64), np.full((lists, k), -np.inf)

    def worst(self, lists: slice) -> np.ndarray:
        return self.scores[lists, -1]

    def take(self, lists: slice, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: lists x ids, -inf where an id does not belong to a list."""
        some = (scores > -np.inf).any(0)
        scores = np.concatenate([self.scores[lists], scores[:, some]], axis=1)
        ids = np.concatenate([self.ids[lists], np.broadcast_to(ids[some], (scores.shape[0], int(some.sum())))], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.ids[lists], self.scores[lists] = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        most = max(1, CELLS // max(width, 1))
        for at in range(0, b.num_rows, most):
            ids, labels, v = quantized(*(b.column(i).slice(at, most) for i in range(3)), width)
            if len(ids):
                yield ids, labels, v


def _positives(held, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, label, a = held.value  # in order of label
        best = Best(len(names), k)
        starts = np.searchsorted(label, np.unique(label)).tolist()
        groups = [slice(at, min(at + AT_ONCE, end)) for begin, end in zip(starts, [*starts, len(label)][1:], strict=True) for at in range(begin, end, AT_ONCE)]
        for ids, labels, v in _chunks(batches, a.shape[1]):
            order = np.argsort(labels, kind="stable")
            ids, labels, v = ids[order], labels[order], v[order]
            for g in groups:
                same = slice(*np.searchsorted(labels, [label[g.start], label[g.start] + 1]))
                if same.start == same.stop:
                    continue
                worst = best.worst(g)

                def qualify(alive, low, high, worst=worst):
                    edge = np.maximum(worst, _largest(np.where(alive, low, -np.inf), k))
                    return alive & (high >= edge[:, None])

                places, score, alive = sliced(a[g], v[same], names[g][:, None] != ids[same][None], qualify)
                best.take(g, ids[same][places], np.where(alive, score, -np.inf))
        which, nth = np.nonzero(best.scores > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(best.ids[which, nth]), pa.array(best.scores[which, nth].astype(np.int64))], ["anchor", "id", "score"])

    return run


def _negatives(held, k: int, low_share: int, high_share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, label, a, positive, worth = held.value  # positive: anchors x slots, ids of the positives; worth: their scores, null where masked
        slots = positive.shape[1]
        floor, top = -(-low_share * worth.data // 100).astype(float), (high_share * worth.data // 100).astype(float)
        floor[worth.mask], top[worth.mask] = np.inf, -np.inf
        best = [Best(len(names), k) for _ in range(slots)]
        for ids, labels, v in _chunks(batches, a.shape[1]):
            for at in range(0, len(names), AT_ONCE):
                g = slice(at, min(at + AT_ONCE, len(names)))
                worst = [b.worst(g) for b in best]

                def qualify(alive, low, high, g=g, worst=worst):
                    left = np.zeros_like(alive)
                    for s in range(slots):
                        lo, hi = floor[g, s][:, None], top[g, s][:, None]
                        maybe = alive & (high >= lo) & (low <= hi)
                        edge = np.maximum(worst[s], _largest(np.where(maybe & (low >= lo) & (high <= hi), low, -np.inf), k))
                        left |= maybe & (high >= edge[:, None])
                    return left

                places, score, alive = sliced(a[g], v, label[g][:, None] != labels[None], qualify)
                for s in range(slots if len(places) else 0):
                    fits = alive & (score >= floor[g, s][:, None]) & (score <= top[g, s][:, None])
                    edge = np.maximum(worst[s], _largest(np.where(fits, score, -np.inf), k))
                    best[s].take(g, ids[places], np.where(fits & (score >= edge[:, None]), score, -np.inf))
        for s, b in enumerate(best):
            which, nth = np.nonzero(b.scores > -np.inf)
            columns = [pa.array(which, pa.int32()), pa.array(np.full(len(which), s), pa.int32()), pa.array(names[which]), pa.array(positive[which, s]), pa.array(worth.data[which, s]), pa.array(b.ids[which, nth]), pa.array(b.scores[which, nth].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "slot", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def _block(rows: DataFrame, asked: DataFrame, positives: int, negatives: int, low_share: int, high_share: int) -> DataFrame:
    context = rows.sparkSession.sparkContext
    got = asked.toArrow()  # a block: bounded in rows and bytes
    names, label, a = quantized(got.column("id"), got.column("label"), got.column("vector"))
    order = np.lexsort((names, label))
    names, label, a = names[order], label[order], a[order].astype(np.float64)
    near = rows.mapInArrow(_positives(context.broadcast((names, label, a)), positives), "anchor int, id long, score long")
    w = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = near.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= positives)
    ids = np.zeros((len(names), positives), np.int64)
    worth = np.ma.masked_all((len(names), positives), np.int64)
    worth.data[:] = 0
    found = near.toPandas()  # as many for each anchor of the block
    where = found["anchor"].to_numpy(int), found["nth"].to_numpy(int) - 1
    ids[where], worth[where] = found["id"].to_numpy(np.int64), found["score"].to_numpy(np.int64)
    far = rows.mapInArrow(_negatives(context.broadcast((names, label, a, ids, worth)), negatives, low_share, high_share), "anchor int, slot int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    w = Window.partitionBy("anchor", "slot").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(rows: DataFrame, asked: Column, id_col: str = "vec_id", label: str | Column = "label", vector: str = "embedding", positives: int = 5, negatives: int = 10, low_share: int = 30, high_share: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which `asked` holds. An anchor's positives are the best rows of its label with another id, its negatives for a
    positive the best rows of other labels whose score lies between the two shares, in hundredths, of the positive's. Ties go to the smaller id.
    Ids and labels are whole numbers. Rows with a null id, label, vector or component, or with a component that is not finite, take no part. A component is floor(256 * x), held
    within 2^20 (x within 4096). Vectors may differ in length: what one lacks counts as 0. Each of several rows with one id counts, also
    as an anchor. Without anchors or rows there are no results.
    """
    label = F.col(label) if isinstance(label, str) else label
    plain = lambda df: df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("vector"))
    plain_rows, anchors = plain(rows), plain(rows.where(asked)).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    n, size = anchors.agg(F.count(F.lit(1)), F.coalesce(F.sum(8 * F.size("vector").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ROWS), -(-size // BLOCK_BYTES))
    if blocks == 1:
        return _block(plain_rows, anchors, positives, negatives, low_share, high_share)
    out = None
    for b in range(blocks):
        part = written(_block(plain_rows, anchors.where(F.pmod(F.xxhash64("id", "label"), F.lit(blocks)) == b), positives, negatives, low_share, high_share), "negatives")
        out = part if out is None else out.unionByName(part)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row; labels of every seventh row are shifted first. Odd rows: see `mine`."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 100 == 0, label=label)


SQL = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(greatest(-1048576, least(1048575, floor(256 * CAST(x AS DOUBLE)))) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM own a JOIN own r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT anchor_id, id, score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
    n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT * FROM ranked WHERE rank <= 10
"""
