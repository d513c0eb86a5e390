"""Languages by multinomial naive Bayes over hashed character n-grams.

Letters in lower case, with one space for whatever stands between them, give n-grams of one to three characters, hashed
into buckets. Each task counts buckets by language over its training texts; the sums over all tasks are the model,
a matrix of log probabilities by bucket and language that is small enough to broadcast whatever the corpus. Texts are
scored in batches: the buckets of many texts stand in one array with the text each belongs to (a sparse matrix by rows),
and their rows of the matrix are summed by text. Long texts go through in pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from homestead.llm.common import free_name, released, short_batches, table, written
from homestead.llm.quality import fold

NGRAMS, BITS = (1, 2, 3), 16
#: Bytes of the broadcast matrix at most; with more languages there are fewer buckets.
MATRIX_BYTES = 64 << 20
#: Code points of one batch, and cells of its product with the matrix.
CHUNK, CELLS = 1 << 17, 1 << 22
#: What each bucket of a language counts before any text.
SMOOTHING = 0.5
UNKNOWN = "und"
_P = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """Of each code point: itself if it is a letter, else a space."""
    points = np.arange(0x110000, dtype=np.uint32)
    return np.where(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000), points, np.uint32(32))


def spelled(text: str) -> np.ndarray:
    """Code points of the text in lower case between two spaces, with one space for each stretch without letters; empty if there is no letter."""
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = points == 32
    if space.all():
        return points[:0]
    points = points[~(space & np.concatenate([[True], space[:-1]]))]
    return np.concatenate([[np.uint32(32)], points, [np.uint32(32)] if points[-1] != 32 else points[:0]])


def grams(points: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams that begin at the first `starts` places, and those places. A code point 0 ends a text; no n-gram goes over it."""
    wide, out, where = points.astype(np.uint64) + np.uint64(1), [], []
    h, whole = np.zeros(len(wide), np.uint64), np.ones(len(wide), bool)
    for n in range(1, max(NGRAMS) + 1):
        m = len(wide) - n + 1
        if m <= 0:
            break
        with np.errstate(over="ignore"):
            h = (h[:m] ^ wide[n - 1 :]) * _P
        whole = whole[:m] & (points[n - 1 :] != 0)
        if n in NGRAMS:
            at = np.flatnonzero(whole[:starts] if n > 1 else whole[:starts] & (points[:starts] != 32))
            g = h[at] ^ (h[at] >> np.uint64(31))
            with np.errstate(over="ignore"):
                out.append(((g * _P) >> np.uint64(64 - BITS)).astype(np.int64))
            where.append(at)
    return (np.concatenate(out), np.concatenate(where)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


def batches_of(texts: Iterable[str | None], most: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and the numbers of their texts, for some `most` code points at a time."""
    held: list[np.ndarray] = []
    names: list[int] = []
    size = 0

    def out():
        sizes = [len(h) + 1 for h in held]
        joined = np.concatenate([x for h in held for x in (h, np.zeros(1, np.uint32))])
        buckets, at = grams(joined, len(joined))
        return buckets, np.repeat(names, sizes)[at]

    for i, text in enumerate(texts):
        points = spelled(text) if text else np.empty(0, np.uint32)
        while len(points) > most:  # pieces overlap so that each n-gram begins in one of them
            buckets, _ = grams(points[: most + max(NGRAMS) - 1], most)
            yield buckets, np.full(len(buckets), i)
            points = points[most:]
        if len(points):
            held.append(points)
            names.append(i)
            size += len(points)
        if size > most:
            yield out()
            held, names, size = [], [], 0
    if held:
        yield out()


@dataclass
class Model:
    """languages in order; prior: log share of texts; matrix: log probability by bucket and language; shift: bits that buckets lose."""

    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray
    shift: int

    def log_odds(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sums by text and language, and whether a text has a letter."""
        total, known = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts), bool)
        for buckets, where in batches_of(texts, max(1024, min(CHUNK, CELLS // max(len(self.languages), 1)))):
            order = np.argsort(where, kind="stable")
            buckets, where = buckets[order] >> self.shift, where[order]
            begin = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            total[where[begin]] += np.add.reduceat(self.matrix[buckets], begin, axis=0, dtype=np.float64)
            known[where[begin]] = True
        return total, known


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Counts over all the rows given. Rows with a null language, and texts that are null or have no letter, are left out."""
    rows = short_batches(docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for b in batches:
            for lang, part in b.groupby("lang")["text"]:
                own = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                seen = np.zeros(len(part), bool)
                for buckets, where in batches_of(part):
                    own += np.bincount(buckets, minlength=1 << BITS)
                    seen[where] = True
                texts[lang] = texts.get(lang, 0) + int(seen.sum())
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": np.concatenate([[-1], at]).astype("int32"), "n": np.concatenate([[texts[lang]], own[at]])})
        released()

    counts = written(rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "languages")
    languages = counts.where("bucket = -1 AND n > 0").select("lang", "n").orderBy("lang")
    n = languages.count()
    shift = 0
    while (n << (BITS - shift)) * 4 > MATRIX_BYTES:
        shift += 1
        if shift > BITS - 8:
            raise ValueError(f"{n} languages are too many")
    known = languages.toPandas()
    place = {lang: i for i, lang in enumerate(known["lang"])}
    folded = counts.where("bucket >= 0").groupBy("lang", F.shiftright("bucket", shift).alias("bucket")).agg(F.sum("n").alias("n")).toPandas()  # as large as the matrix at most
    matrix = np.full((1 << (BITS - shift), n), SMOOTHING)
    matrix[folded["bucket"].to_numpy(int), folded["lang"].map(place).to_numpy(int)] += folded["n"].to_numpy()
    matrix = np.log(matrix / matrix.sum(0)).astype(np.float32)
    texts = known["n"].to_numpy(float)
    return Model(list(known["lang"]), np.log(texts / texts.sum()) if n else np.zeros(0), matrix, shift)


def identify(docs: DataFrame, model: Model, text_col: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the most probable language of each whole text and its probability; other names than `name` and `score` are taken where docs has such columns.

    A text that is null or has no letter, and every text if nothing was learned, gets `und` and the score 0. Of equally probable languages the first by name.
    """
    held = short_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang: string, score: double>")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = held.value
        for texts in batches:
            if not model.languages:
                yield pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0})
                continue
            total, known = model.log_odds(list(texts))
            top = total.max(1)
            share = 1 / np.exp(total - top[:, None]).sum(1)
            names = np.array(model.languages, object)[total.argmax(1)]
            yield pd.DataFrame({"lang": np.where(known, names, UNKNOWN), "score": np.where(known, share, 0.0)})
        released()

    found = free_name(docs, "__found")
    docs = docs.withColumn(found, best(F.col(text_col)))
    free = {n: free_name(docs, n) for n in (name, score)}
    return docs.withColumns({free[name]: F.col(f"{found}.lang"), free[score]: F.col(f"{found}.score")}).drop(found)


def held_out(id_col: str) -> Column:
    """Whether a row is in the fold that is not learned from; a null id is not."""
    return F.coalesce(fold(id_col, 5) == 0, F.lit(False))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those outside the held-out fold. Null and empty texts: see `identify`; a null id is neither learned from nor held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(fold("doc_id", 5) != 0))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
