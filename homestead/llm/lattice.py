"""Document likelihood over all segmentations into the pieces of an existing vocabulary.

Words are counted over the whole corpus, so that the lattice of a word is walked once and not once an
occurrence. A forward recursion in log space sums over all ways to cut a word into pieces of the vocabulary
(bytes are pieces too, so any word can be cut); the probability of a document is the product over its words and its end.
Each training word is one more piece of its own, so what is gathered grows with the corpus. The scores of the pieces start from those of
the vocabulary and are fitted to the counts of the training words by expectation maximisation. A unigram vocabulary's scores are log probabilities; the public vocabulary was made by merges, whose scores
are no more than ranks, so its start falls with the rank. Words that make up at least a fixed share of all tokens, of which
there can only be so many, are looked up where the documents are read; the others are joined by a shuffle, in
which by that bound no word is frequent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homestead.llm.common import plain_text, shared_dir, short_batches, table, written

#: A word is looked up where documents are read if it makes up this share of the tokens at least: so there are at most as many as its inverse.
FREQUENT = 1 / 300_000
EM_STEPS = 2
#: Distinct words that a task counts before it passes its counts on.
COUNT_AT_ONCE = 400_000
#: Cells of the table that the recursion fills at once.
CELLS = 1 << 20
#: Places times words whose edges are held at once.
EDGES = 1 << 18
#: Share of the pieces of whole words before the first step.
WHOLE = 0.5
FOLDS, HELD_OUT = 7, 2


def default_vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (the mark of a word's start as a space), all 256 bytes among them, and their first log probabilities.

    Scores that sum to about 1 as log probabilities are taken as such; others are taken as ranks, from 0 down.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            pieces.setdefault(model.id_to_piece(i).replace("▁", " ").encode(), model.get_score(i))
    least = min(pieces.values(), default=0.0)
    for b in range(256):
        least -= 1
        pieces.setdefault(bytes([b]), least)
    scores = np.array(list(pieces.values()))
    likely = np.exp(scores) if abs(np.exp(scores).sum() - 1) < 0.2 else 1 / (10.0 - scores)
    return list(pieces), np.log(likely / likely.sum())


class Lattice:
    """A trie of the pieces as sorted arrays, walked for many words at a time."""

    def __init__(self, pieces: list[bytes]):
        nodes: dict[int, int] = {}
        ends = {0: -1}
        for number, piece in enumerate(pieces):
            at = 0
            for b in piece:
                at = nodes.setdefault(at << 8 | b, len(nodes) + 1)
                ends.setdefault(at, -1)
            ends[at] = number
        self.keys = np.array(sorted(nodes), np.int64)
        self.child = np.array([nodes[k] for k in self.keys.tolist()], np.int64)
        self.end = np.full(len(nodes) + 1, -1, np.int64)
        self.end[list(ends)] = list(ends.values())
        self.first = np.zeros(256, np.int64)
        root = self.keys < 256
        self.first[self.keys[root]] = self.child[root]

    def edges(self, cells: np.ndarray, lengths: np.ndarray, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, words, pieces) for all pieces that lie in words and start at a place from begin to before end; cells: a row of bytes a word."""
        for i in range(begin, cells.shape[1] if end is None else end):
            rows = np.flatnonzero(lengths > i)
            at, to = self.first[cells[rows, i]], i + 1
            while len(rows):
                number = self.end[at]
                hit = number >= 0
                if hit.any():
                    yield i, to, rows[hit], number[hit]
                on = lengths[rows] > to
                rows, at = rows[on], at[on]
                if not len(rows):
                    break
                want = at << 8 | cells[rows, to]
                spot = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
                on = self.keys[spot] == want
                rows, at, to = rows[on], self.child[spot[on]], to + 1

    def score(self, cells: np.ndarray, lengths: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Log probability of each word, summed over its segmentations."""
        alpha = np.full((cells.shape[1] + 1, len(cells)), -np.inf)
        alpha[0] = 0
        for i, to, rows, number in self.edges(cells, lengths):
            alpha[to, rows] = np.logaddexp(alpha[to, rows], alpha[i, rows] + logp[number])
        return alpha[lengths, np.arange(len(cells))]

    def expected(self, cells: np.ndarray, lengths: np.ndarray, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is used in counts[i] occurrences of word i, on average over segmentations."""
        return self.uses(cells, lengths, logp, counts, np.full(len(cells), -np.inf))[0]

    def uses(self, cells: np.ndarray, lengths: np.ndarray, logp: np.ndarray, counts: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, float]:
        """How often each piece, and how often the piece of a whole word, is used in counts[i] occurrences of word i, on average over segmentations.

        whole: the log probability of the piece that is the whole word. The way back goes over blocks of places, so a word of any length needs
        the edges of one block only.
        """
        n, width = len(cells), cells.shape[1]
        alpha = np.full((width + 1, n), -np.inf)
        alpha[0] = 0
        for i, to, rows, number in self.edges(cells, lengths):
            alpha[to, rows] = np.logaddexp(alpha[to, rows], alpha[i, rows] + logp[number])
        total = np.logaddexp(alpha[lengths, np.arange(n)], whole)
        own = float((counts * np.exp(whole - total)).sum())
        beta = np.full(alpha.shape, -np.inf)
        beta[lengths, np.arange(n)] = 0
        out = np.zeros(len(logp))
        block = max(1, EDGES // max(n, 1))
        for begin in range((width - 1) // block * block, -1, -block):
            for i, to, rows, number in reversed(list(self.edges(cells, lengths, begin, min(begin + block, width)))):
                on = beta[to, rows] + logp[number]
                out += np.bincount(number, counts[rows] * np.exp(alpha[i, rows] + on - total[rows]), len(logp))
                beta[i, rows] = np.logaddexp(beta[i, rows], on)
        return out, own


def tabled(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in words, bytes with the mark of a word's start, lengths) for words of like length at a time."""
    lengths = np.array([len(w) + 1 for w in words])
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        end = min(len(order), at + max(1, CELLS // int(lengths[order[at]])))
        while end - at > 1 and (end - at) * int(lengths[order[end - 1]]) > 2 * CELLS:
            end = at + (end - at + 1) // 2
        part = order[at:end]
        width = int(lengths[part[-1]])
        joined = b"".join((b" " + words[i]).ljust(width, b"\0") for i in part.tolist())
        yield part, np.frombuffer(joined, np.uint8).reshape(len(part), width).astype(np.int64), lengths[part]
        at = end


def split_words(text: str) -> list[bytes]:
    """Words between white space (space, tab to carriage return), A-Z in lower case, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def counted(docs: DataFrame) -> DataFrame:
    """word, n (in all documents) and c (in training documents) over docs (text, held_out)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = Counter(), Counter()

        def out() -> pd.DataFrame:
            rows = pd.DataFrame({"word": [*kinds[0], *kinds[1]], "n": [*kinds[0].values(), *kinds[1].values()], "c": [*kinds[0].values(), *repeat(0, len(kinds[1]))]})
            kinds[0].clear()
            kinds[1].clear()
            return rows

        for batch in batches:
            for text, held in zip(batch["text"].tolist(), batch["held_out"].tolist(), strict=True):
                kinds[held].update(split_words(text))
                if len(kinds[0]) + len(kinds[1]) > COUNT_AT_ONCE:
                    yield out()
        if kinds[0] or kinds[1]:
            yield out()

    rows = docs.select("text", "held_out").mapInPandas(count, "word binary, n bigint, c bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def learn_pieces(words: DataFrame, lattice, logp: np.ndarray, n_words: int, n_ends: int, steps: int) -> tuple[np.ndarray, float, float]:
    """Log probabilities of the pieces and of the end, and the share of the pieces of whole words, from the counts of all training words.

    In these steps an occurrence of a word sees the others only (the word has c - 1 of n_words - 1): else every word would be its own
    best piece, and nothing be left for words that were not seen.
    """
    spark = words.sparkSession
    end, share = 0.0, WHOLE if steps else 0.0
    logp = logp + (np.log1p(-share) if steps else 0.0)
    for _ in range(steps):
        held = spark.sparkContext.broadcast((logp, share))

        def expect(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            logp, share = held.value
            total, whole = np.zeros(len(logp)), 0.0
            for batch in batches:
                words, counts = batch["word"].tolist(), batch["c"].to_numpy(float)
                with np.errstate(divide="ignore"):
                    others = np.log(share * (counts - 1) / max(n_words - 1, 1))
                for part, cells, lengths in tabled(words):
                    times, own = lattice.value.uses(cells, lengths, logp, counts[part], others[part])
                    total += times
                    whole += own
            used = np.flatnonzero(total)
            yield pd.DataFrame({"piece": np.append(used, -1), "times": np.append(total[used], whole)})

        sums = words.where("c > 0").select("word", "c").mapInPandas(expect, "piece bigint, times double").groupBy("piece").agg(F.sum("times").alias("times")).toPandas()
        own, sums = float(sums["times"][sums["piece"] < 0].sum()), sums[sums["piece"] >= 0]
        times = np.full(len(logp), 0.1)
        times[sums["piece"].to_numpy(int)] += sums["times"].to_numpy(float)
        every = times.sum() + own + n_ends + 0.1
        logp, end, share = np.log(times / every), float(np.log((n_ends + 0.1) / every)), own / every
    return logp, end, share


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_file: str | None = None, em_steps: int = EM_STEPS, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(id as text) modulo folds is not held_out; a null id is held out of neither. A null text is the
    empty text: its end alone is scored. Ids may occur again. Only the id and text columns are read.
    """
    spark = short_batches(docs).sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), plain_text(F.col(text_col)).alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % folds == held_out, F.lit(False)))
    words = written(counted(rows), "words")
    seen = words.agg(F.sum("n"), F.sum("c"), F.count_if(F.col("c") > 0)).first()
    ends = rows.agg(F.count_if(~F.col("held_out"))).first()[0]
    n_all, n_train, distinct = (seen[0] or 0), (seen[1] or 0) + ends, (seen[2] or 0) + (ends > 0)
    pieces, logp = read_vocabulary(vocabulary_file or default_vocabulary_file())
    lattice = spark.sparkContext.broadcast(Lattice(pieces))
    n_words = n_train - ends
    logp, end, share = learn_pieces(words, lattice, logp, n_words, ends, em_steps)
    held = spark.sparkContext.broadcast(logp)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.empty(len(batch))
            for part, cells, lengths in tabled(batch["word"].tolist()):
                found[part] = lattice.value.score(cells, lengths, held.value)
            with np.errstate(divide="ignore"):
                whole = np.log(share * batch["c"].to_numpy(float) / max(n_words, 1))
            yield batch.assign(logp=np.logaddexp(found, whole) / np.log(10))

    words = written(words.mapInPandas(walk, "word binary, n bigint, c bigint, logp double"), "scored-words")
    frequent = words.where(F.col("n") >= max(1.0, n_all * FREQUENT)).toPandas()
    known = spark.sparkContext.broadcast((frequent["word"].tolist(), np.log10(frequent["c"].to_numpy(float) + 1), frequent["logp"].to_numpy(float), (frequent["c"] > 0).to_numpy(float)))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, *values = known.value
        index = dict(zip(names, range(len(names)), strict=True))
        base, inner, is_known = (np.append(v, 0.0) for v in values)
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.iloc[at : at + 512]
                sums, rest = [], []
                for uid, text in zip(some["uid"].tolist(), some["text"].tolist(), strict=True):
                    doc = split_words(text)
                    found = np.fromiter(map(index.get, doc, repeat(-1)), np.int64, len(doc))
                    sums.append((len(doc), is_known[found].sum(), base[found].sum(), inner[found].sum()))
                    if (found < 0).any():
                        rest += ((uid, w, n) for w, n in Counter([doc[i] for i in np.flatnonzero(found < 0).tolist()]).items())
                out = some[["uid", "id", "held_out"]].copy()
                out[["n_words", "n_known", "base", "inner"]] = np.array(sums, float).reshape(-1, 4)
                more = pd.DataFrame(rest, columns=["uid", "word", "times"])
                yield pd.concat([out.assign(word=None, times=0), more], ignore_index=True).astype({"id": "Int64", "held_out": "boolean", "times": "Int64"})

    path = shared_dir(spark, "looked-up")
    both = rows.withColumn("id", F.col("id").cast("long")).mapInPandas(look_up, "uid bigint, id bigint, held_out boolean, n_words double, n_known double, base double, inner double, word binary, times bigint")
    both.write.parquet(path)
    both = spark.read.schema(both.schema).parquet(path)
    rare = both.where("word IS NOT NULL").select("uid", "word", "times").join(words.drop("n"), "word")
    rare = rare.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("r_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("r_base"), F.sum(F.col("times") * F.col("logp")).alias("r_inner"))
    whole = both.where("word IS NULL").join(rare, "uid", "left").na.fill(0, ["r_known", "r_base", "r_inner"])
    n_tokens = F.col("n_words").cast("long") + 1
    return whole.select(
        "uid", "id", "held_out", n_tokens.alias("n_tokens"), (F.col("n_known") + F.col("r_known") + int(ends > 0)).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("r_base") + float(np.log10(ends + 1)) - n_tokens * float(np.log10(n_train + distinct + 1))).alias("base_score"),
        (F.col("inner") + F.col("r_inner") + end / float(np.log(10))).alias("score"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. A null text is its end alone, a null id is in no fold, each row has a row; other columns are not read."""
    return score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("uid")
