"""A corpus made ready for training, stage by stage.

Each stage takes all rows that the one before kept, as written and read again; the last one packs what is left. In all stages a null text is the
empty text, rows are kept or dropped whole with whatever columns they have (also such as have the names that operators use inside), and an
empty table gives an empty one. What becomes of null ids and of repeated rows each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from homestead.llm import decontam, exact_dedup, jaccard, packing, quality
from homestead.llm.common import table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; repeated rows have one score, empty texts that of the prior."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id (null is the smallest); of equal rows one."""
    return exact_dedup.drop_copies(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similar sets of word shingles link, the one with the smallest id; documents without words all stay."""
    return jaccard.drop_near_copies(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold passages of the benchmark. Rows of one id go together, a row without id by its own text."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences; each row has its own pieces."""
    return packing.pack(docs)


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", dissimilar), ("decontamination", unseen), ("packing", packed)]

#: A learned model, streaming state and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
