"""Removal of sentences, lines or paragraphs that occur before.

Units are normalised (lower case, white space as one space) and hashed to 128 bits; only digests, places
and lengths are shuffled. For each digest the occurrence ranked first stays, and the places of all others are returned
in the coordinates of the text as it was. Lines can be cut at the ends of their sentences, so that a passage that
was put into a line of other text is met there too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from homestead.llm.common import free_name, plain_text, released, short_batches, table, written

#: A sentence ends with a line, or with a full stop, exclamation or question mark before a space; the spaces belong to it.
UNITS = {"sentence": re.compile(r"(?=[^\n])[^\n.!?]*(?:[.!?](?! )[^\n.!?]*)*(?:[.!?] +)?"), "line": re.compile(r"[^\n]+"), "paragraph": re.compile(r"[^\n](?:[^\n]|\n(?!\s*\n))*")}
#: Words of neighbouring repeated sentences that make a passage: one of over 50 words that starts and ends inside sentences holds about so many words of whole ones.
PASSAGE_WORDS = 30


def cut_units(docs: DataFrame, unit: str = "line", id_col: str = "doc_id", text_col: str = "text", min_words: int = 1, uid: str | None = None) -> DataFrame:
    """uid (of the row), id, unit_no, start, length (in characters), words and digest of all units of at least min_words words."""
    pattern = UNITS[unit]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for uid, doc, text in zip(batch["uid"].tolist(), batch["id"].tolist(), batch["text"].tolist(), strict=True):
                for n, m in enumerate(pattern.finditer(text)):
                    words = m[0].lower().split()
                    if len(words) >= min_words:
                        rows.append((uid, doc, n, m.start(), m.end() - m.start(), len(words), hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()))
                if len(rows) >= 50_000:
                    yield _units(rows)
                    rows = []
            if rows:
                yield _units(rows)
        released()

    row = F.col(uid) if uid else F.monotonically_increasing_id()
    rows = short_batches(docs).select(row.alias("uid"), F.col(id_col).cast("long").alias("id"), plain_text(F.col(text_col)).alias("text"))
    return rows.mapInPandas(run, "uid bigint, id bigint, unit_no int, start int, length int, words int, digest binary")


def _units(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["uid", "id", "unit_no", "start", "length", "words", "digest"]).astype({"id": "Int64"})


def repeated_units(docs: DataFrame, unit: str = "line", id_col: str = "doc_id", text_col: str = "text", min_words: int = 1, min_passage: int = 0, uid: str | None = None) -> DataFrame:
    """The units that occur several times: uid, id, unit_no, start, length, keep_id, keep_unit_no, n_copies, kept.

    Occurrences are ranked by id (null first), row number and place; the first one stays (kept), in its own document too, and
    the others go. With min_passage only units in runs of neighbouring repeated ones of so many words are returned.
    A null text has no units, nor has white space any. Rows that repeat are documents of their own; `uid` may name a column that tells rows apart.
    Only the id and text columns are read.
    """
    units = written(cut_units(docs, unit, id_col, text_col, min_words, uid), "units")
    first = units.groupBy("digest").agg(F.min(F.struct("id", "uid", "unit_no")).alias("keep"), F.count(F.lit(1)).alias("n_copies"))
    first = written(first.where("n_copies > 1"), "repeats")
    again = units.join(first, "digest").withColumn("kept", F.expr("uid = keep.uid AND unit_no = keep.unit_no"))
    if min_passage:
        run = F.col("unit_no") - F.row_number().over(Window.partitionBy("uid").orderBy("unit_no"))
        again = again.withColumn("run", run).withColumn("of_run", F.sum("words").over(Window.partitionBy("uid", "run"))).where(F.col("of_run") >= min_passage)
    return again.select("uid", "id", "unit_no", "start", "length", F.col("keep.id").alias("keep_id"), F.col("keep.unit_no").alias("keep_unit_no"), "n_copies", "kept")


def remove_units(docs: DataFrame, unit: str = "line", id_col: str = "doc_id", text_col: str = "text", min_words: int = 1, min_passage: int = 0) -> DataFrame:
    """docs, with all repeated units but the first of each cut from the text; same columns.

    Each row is cut by its own units: ids may be null or occur again. Rows are written once with a number that tells them apart.
    """
    uid, spans, of = free_name(docs, "uid"), free_name(docs, "spans"), free_name(docs, "of_uid")
    rows = written(docs.withColumn(uid, F.monotonically_increasing_id()), "rows")
    gone = repeated_units(rows, unit, id_col, text_col, min_words, min_passage, uid).where("NOT kept")
    gone = gone.groupBy(F.col("uid").alias(of)).agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias(spans))

    @F.pandas_udf("string")
    def without(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t: str, cut: list | None) -> str:
            at, kept = 0, []
            for s in cut if cut is not None else ():
                kept.append(t[at : s["start"]])
                at = s["start"] + s["length"]
            return "".join([*kept, t[at:]])

        return pd.Series([None if t is None else one(t, c) for t, c in zip(text, spans, strict=True)])

    return rows.join(gone, rows[uid] == gone[of], "left").select(*(without(F.col(text_col), F.col(spans)).alias(c) if c == text_col else rows[c] for c in docs.columns))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of passages that repeat, those that go and those that stay."""
    rows = repeated_units(table(spark, sf_dir, "documents"), "sentence", min_passage=PASSAGE_WORDS)
    return rows.select(F.col("id").alias("doc_id"), "unit_no", "start", "length", F.col("keep_id").alias("keep_doc_id"), "keep_unit_no", "n_copies", "kept")


SQL = r"""
WITH pieces AS (
  SELECT doc_id, string_split(replace(regexp_replace(coalesce(text, ''), '([.!?] +)', '\1' || chr(1), 'g'), chr(10), chr(10) || chr(1)), chr(1)) AS parts FROM documents),
spread AS (
  SELECT doc_id, unnest(parts) AS piece, unnest(range(len(parts))) AS i FROM pieces),
placed AS (
  SELECT doc_id, i, rtrim(piece, chr(10)) AS unit, length(rtrim(piece, chr(10))) AS length,
    coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    sum(CASE WHEN rtrim(piece, chr(10)) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS unit_no
  FROM spread),
units AS (
  SELECT *, lower(trim(regexp_replace(unit, '\s+', ' ', 'g'))) AS norm FROM placed WHERE trim(regexp_replace(unit, '\s+', ' ', 'g')) <> ''),
ranked AS (
  SELECT *, len(string_split(norm, ' ')) AS words, row_number() OVER w AS r, count(*) OVER (PARTITION BY norm) AS n_copies,
    first_value(doc_id) OVER w AS keep_doc_id, first_value(unit_no) OVER w AS keep_unit_no
  FROM units WINDOW w AS (PARTITION BY norm ORDER BY doc_id, unit_no)),
runs AS (
  SELECT *, unit_no - row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) AS run FROM ranked WHERE n_copies > 1),
summed AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id, run) AS of_run FROM runs)
SELECT doc_id, CAST(unit_no AS INTEGER) AS unit_no, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS length,
  keep_doc_id, CAST(keep_unit_no AS INTEGER) AS keep_unit_no, n_copies, r = 1 AS kept
FROM summed WHERE of_run >= 30
"""
