"""Dropping lines made from recurring templates, with a log-template tree of fixed depth.

The tree has three levels below its root: the number of tokens of a line, its leading tokens (one with a digit counts as
the wildcard), and the template. Only leaves that lines of several documents reach are looked at further. There, a
token that recurs at its place is constant and any other a variable field; the line with its variable fields
replaced by the wildcard is its template. Lines whose template occurs in several documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from homestead.llm.common import free_name, plain_text, small, table, written

DEPTH = 3
WILD = "<*>"
#: A template is dropped if it occurs in so many documents; a token is constant if it recurs so often at its place.
MIN_DOCS = 3
#: Templates with a larger share of variable fields are left alone.
MAX_WILD = 0.4


def masked(tokens: Column) -> Column:
    """Tokens (parted by one space) with those that hold a digit replaced."""
    return F.regexp_replace(tokens, r"[^ ]*[0-9][^ ]*", WILD)


def tree_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = 1) -> DataFrame:
    """id, line_no, line (white space as one space) and leaf (hash of the path) of all lines of at least min_tokens tokens; lines of white space have none."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(plain_text(F.col(text_col)), "\n")).alias("line_no", "line"))
    lines = lines.select("id", "line_no", F.trim(F.regexp_replace("line", r"\s+", " ")).alias("line"))
    lines = lines.where("line <> ''").withColumn("n_tokens", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    return lines.where(F.col("n_tokens") >= min_tokens).withColumn("leaf", F.xxhash64("n_tokens", masked(F.substring_index("line", " ", DEPTH))))


def template_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, max_wild: float = MAX_WILD, min_tokens: int = 1) -> DataFrame:
    """The lines to drop: id, line_no, template, n_docs.

    Null texts have no lines. Ids name documents: rows with one id count as one document, and null ids as
    one document too. Only the id and text columns are read.
    """
    lines = written(tree_lines(docs, id_col, text_col, min_tokens), "lines")
    leaves = lines.select("leaf", "id").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf")
    leaves = written(leaves, "leaves")
    reached = written(lines.join(small(leaves), "leaf", "left_semi").withColumn("key", F.xxhash64("line")), "reached")
    # equal lines are parsed once
    kinds = written(reached.groupBy("leaf", "key").agg(F.any_value("line").alias("line"), F.any_value("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n")), "kinds")
    tokens = kinds.select("leaf", "key", "n", "n_tokens", F.posexplode(F.split(masked(F.col("line")), " ")).alias("place", "token"))
    constant = tokens.groupBy("leaf", "place", "token").agg(F.sum("n").alias("n")).where((F.col("n") >= min_docs) & (F.col("token") != WILD))
    constant = written(constant.drop("n"), "constant")
    marked = tokens.join(constant.withColumn("same", F.lit(True)), ["leaf", "place", "token"], "left")
    marked = marked.select("leaf", "key", "n_tokens", "place", F.when(F.col("same"), F.col("token")).otherwise(F.lit(WILD)).alias("token"))
    made = marked.groupBy("leaf", "key", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("parts"), F.count_if(F.col("token") == WILD).alias("n_wild"))
    made = written(made.where(F.col("n_wild") <= max_wild * F.col("n_tokens")).select("leaf", "key", F.array_join("parts.token", " ").alias("template")), "templates")
    made = written(reached.select("id", "line_no", "leaf", "key").join(made, ["leaf", "key"]).select("id", "line_no", "template"), "placed")
    often = made.select("id", "template").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)
    often = written(often, "recurring")
    return made.join(often, "template").select("id", "line_no", "template", "n_docs")


def drop_template_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the lines of recurring templates; same columns. A text that loses lines keeps the others in order.

    Rows without id keep their text. Rows with one id are one document, whose rows all lose the lines that any of them loses.
    """
    gone, of = free_name(docs, "gone"), free_name(docs, "of_id")
    lost = template_lines(docs, id_col, text_col, **options).where("id IS NOT NULL").groupBy(F.col("id").alias(of)).agg(F.collect_set("line_no").alias(gone))
    both = docs.join(lost, docs[id_col] == lost[of], "left")
    kept = F.filter(F.split(docs[text_col], "\n"), lambda _, i: ~F.coalesce(F.array_contains(lost[gone], i), F.lit(False)))
    return both.select(*(F.when(lost[gone].isNull(), docs[c]).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else docs[c] for c in docs.columns))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of recurring templates. Null texts have no lines, rows of one id (null ids too) are one document; other columns are not read."""
    return template_lines(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents),
lines AS (
  SELECT doc_id, line_no, string_split(regexp_replace(trim(regexp_replace(raw, '\s+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') AS t FROM split),
keyed AS (
  SELECT *, concat_ws(' ', len(t), t[1], t[2], t[3]) AS leaf FROM lines WHERE t <> ['']),
leaves AS (
  SELECT leaf FROM keyed GROUP BY leaf HAVING count(DISTINCT doc_id) >= 3),
tokens AS (
  SELECT leaf, doc_id, line_no, len(t) AS n, unnest(t) AS token, unnest(range(len(t))) AS place FROM keyed SEMI JOIN leaves USING (leaf)),
marked AS (
  SELECT *, CASE WHEN token <> '<*>' AND count(*) OVER (PARTITION BY leaf, place, token) >= 3 THEN token ELSE '<*>' END AS part FROM tokens),
made AS (
  SELECT doc_id, line_no, string_agg(part, ' ' ORDER BY place) AS template
  FROM marked GROUP BY leaf, doc_id, line_no, n HAVING count(*) FILTER (part = '<*>') <= 0.4 * n),
often AS (
  SELECT template, count(DISTINCT doc_id) AS n_docs FROM made GROUP BY template HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, template, n_docs FROM made JOIN often USING (template)
"""
