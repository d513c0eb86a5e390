"""Text quality from supervised subword embeddings.

A document is the mean of learned vectors of its words and of the character n-grams inside its words, all hashed into
one table; a softmax layer on the mean gives the classes. Vectors and layer are trained by stochastic gradient
descent in numpy, in one task, on a bounded sample of labelled rows. Scores of all documents need only the
projection of the table on the difference of the two classes, one number a bucket, which tasks apply to whole
batches of texts at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homestead.llm.common import first_by_hash, free_name, plain_text, released, short_batches, table, written

BUCKETS, WIDTH, NGRAMS = 1 << 18, 16, (2, 3, 4)
#: At most so many labelled rows are learned from, the same ones each time; they are taken by a hash of the id.
TRAIN_ROWS = 6000
EPOCHS, RATE, SEED = 6, 4.0, 7
#: Documents that score less are rejected.
THRESHOLD = 0.3
#: Longest text in bytes that is hashed at once; longer ones are cut between words.
CHUNK = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
with np.errstate(over="ignore"):
    _POWER, _BACK = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(CHUNK + 2, x, np.uint64)])) for x in (_P, _INV))


def features(raw: bytes) -> np.ndarray:
    """Buckets of all words and of all n-grams of characters inside words of a text in UTF-8, with a mark at word ends."""
    b = np.frombuffer((" " + raw.decode("utf-8", "surrogatepass") + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    b = b + np.uint32(32) * ((b >= 65) & (b <= 90))
    space = (b == 32) | ((b >= 9) & (b <= 13))
    b = np.where(space, np.uint32(32), b)
    starts, ends = np.flatnonzero(~space[1:] & space[:-1]) + 1, np.flatnonzero(space[1:] & ~space[:-1]) + 1
    if not len(starts):
        return np.empty(0, np.int64)
    wide = b.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide * _POWER[: len(b)], dtype=np.uint64)])
        out = [(sums[ends] - sums[starts]) * _BACK[starts] * _P + np.uint64(1)]
        inner = np.concatenate([[0], np.cumsum(space)])
        for n in NGRAMS:
            if len(b) >= n:
                at = np.arange(len(b) - n + 1)
                # white space only as the first or last mark, so that an n-gram stays in one word
                at = at[(inner[at + n - 1] - inner[at + 1] == 0) & ~(space[at] & space[at + n - 1])]
                gram = np.zeros(len(at), np.uint64)
                for k in range(n):
                    gram = (gram ^ wide[at + k]) * _P
                out.append(gram + np.uint64(n))
        h = np.concatenate(out)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - 18)).astype(np.int64)


def pieces(raw: bytes) -> Iterator[bytes]:
    """The text in chunks that end between words where there is room between words."""
    while len(raw) > CHUNK:
        at = raw.rfind(b" ", 0, CHUNK) + 1
        if not at:  # between two characters
            at = CHUNK
            while raw[at] & 0xC0 == 0x80:
                at -= 1
        yield raw[:at]
        raw = raw[at:]
    yield raw


def bag(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    parts = [np.unique(features(p), return_counts=True) for p in pieces(raw)]
    if len(parts) == 1:
        return parts[0]
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)


@dataclass
class Model:
    """margin: per bucket, what it adds to the log odds of class 1, times the features of a document; bias of the odds."""

    margin: np.ndarray
    bias: float
    rows: int

    def log_odds(self, raw: bytes) -> float:
        total, n = 0.0, 0
        for part in pieces(raw):
            f = features(part)
            total, n = total + float(self.margin[f].sum()), n + len(f)
        return total / max(n, 1) + self.bias


def train(texts: Iterable[bytes], labels: Sequence[int], epochs: int = EPOCHS, rate: float = RATE, width: int = WIDTH, seed: int = SEED) -> Model:
    """Stochastic gradient descent over the vectors and a softmax layer of two classes, with a falling rate."""
    bags = [(k.astype(np.int32), (c / c.sum()).astype(np.float32)) if len(k) else None for k, c in map(bag, texts)]
    labels = np.asarray(labels, np.int64)  # may grow as the texts are read
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, width)) - 0.5) / width).astype(np.float32)
    layer = ((rng.random((width, 2)) - 0.5) * 2).astype(np.float32)
    share = np.clip(np.bincount(labels, minlength=2) / max(len(labels), 1), 1e-3, 1)
    bias = np.log(share).astype(np.float32)
    step, steps = 0, max(1, epochs * len(bags))
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            now, step = rate * (1 - step / steps), step + 1
            if bags[i] is None:
                continue
            keys, weights = bags[i]
            mean = weights @ vectors[keys]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            pull = layer @ p
            layer -= np.float32(0.05 * now) * np.outer(mean, p)
            bias -= np.float32(0.005 * now) * p
            vectors[keys] -= np.float32(now) * np.outer(weights, pull)
    to_one = layer[:, 1] - layer[:, 0]
    return Model((vectors @ to_one).astype(np.float32), float(bias[1] - bias[0]), len(bags))


def fold(id_col: str, folds: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> Model:
    """Learns from at most `rows` labelled documents, outside the held-out fold (crc32 of the id modulo 5 is 0).

    Labels that are null, ids that are null and labels without a document are not used; of several labels of one id the largest counts, of several
    documents of one id the least text.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    known = known.where(fold("id", 5) != 0).groupBy("id").agg(F.max("label").alias("label"))
    known = written(known, "labels")
    own = docs.select(F.col(id_col).alias("id"), plain_text(F.col(text_col)).alias("text"))
    there = known.join(own.select("id").distinct(), "id", "left_semi")
    sample = known.join(F.broadcast(first_by_hash(there.select("id"), "id", rows)), "id")
    texts = own.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: list[int] = []

        def read() -> Iterator[bytes]:
            for batch in batches:
                known.extend(batch["label"].tolist())
                yield from (t.encode("utf-8", "surrogatepass") for t in batch["text"])

        model = train(read(), known, epochs)
        yield pd.DataFrame({"margin": [zlib.compress(model.margin.tobytes(), 1)], "bias": [model.bias], "rows": [model.rows]})
        del model
        released()

    got = texts.repartition(1).sortWithinPartitions("id", "text").mapInPandas(fit, "margin binary, bias double, rows bigint").first()
    if got is None:  # no partition at all
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0)
    return Model(np.frombuffer(zlib.decompress(got["margin"]), np.float32), got["bias"], got["rows"])


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability of class 1 from the whole text. A null text counts as empty; an empty one gets the prior. Where docs has a column of that name, the new one has underscores before it."""
    name = free_name(docs, name)
    held = short_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = held.value
        for texts in batches:
            yield pd.Series([1 / (1 + np.exp(-np.clip(model.log_odds(t.encode("utf-8", "surrogatepass")), -60, 60))) for t in texts], dtype="float64")
        released()

    return docs.withColumn(name, probability(plain_text(F.col(text_col))))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs that score at least the threshold; same columns. Empty texts have the score of the prior."""
    name = free_name(docs, "score")
    return score(docs, learn(docs, labels, text_col=text_col), text_col, name).where(F.col(name) >= threshold).drop(name)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents. Null and empty texts get the prior; repeated rows each have a row; a null id is in no fold and is not learned from; of other columns than doc_id and text nothing is read."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
