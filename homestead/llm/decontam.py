"""Benchmark decontamination with spaced seeds.

A mask takes some tokens of a stretch and ignores the others, so that its hash outlives a substitution at an ignored
place. The hashes of all stretches of the benchmark items are joined with those of the documents; a hit gives a
document, an item and how they lie against each other. Around each hit the item is compared token by token, and a
document counts as contaminated if a stretch of the item has enough equal tokens at equal places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from homestead.llm.common import free_name, plain_text, small, table, written

#: By tokens of a stretch, up to which the masks serve (1: the token counts, 0: it is ignored). However the substitutions lie
#: that a stretch may hold, one in five tokens, one of the masks finds a place in it that has none.
MASKS = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    9: ("1111", "11011", "10111", "11101"),
    14: ("111011", "11010011", "11111"),
    20: ("1111011", "110100010011", "11001010000011", "1110111"),
}
#: Tokens of the compared stretch (the whole item if it is shorter), and the share that must be equal.
WINDOW, SHARE = 20, 0.8


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(plain_text(text)), r"[^\p{L}\p{N}]+"), "")


def seed(words: Column, at: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *(F.get(words, at + k) for k, c in enumerate(mask) if c == "1"))


def seeds(rows: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """rows with a row for each token and mask: at (the token's place, from 0) and seed."""
    if not masks:
        return rows.limit(0).select("*", F.lit(0).alias("at"), F.lit(0).cast("long").alias("seed"))
    placed = rows.select("*", F.posexplode("words").alias("at", "first")).drop("first")
    return placed.select("*", F.explode(F.array(*(seed(F.col("words"), F.col("at"), m) for m in masks))).alias("seed"))


def masks_of(width: int) -> tuple[str, ...]:
    """The masks for stretches of so many tokens."""
    return next(masks for most, masks in MASKS.items() if width <= most)


def item_seeds(items: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """The seeds of all items at all places, and the masks that items of their lengths need."""
    widths = [r[0] for r in items.select(F.least("n", F.lit(WINDOW)).alias("width")).distinct().collect()]
    masks = sorted({m for w in widths for m in masks_of(w)})
    own = items.select("item", "words", "n").limit(0).select("item", F.lit(0).alias("at"), F.lit(0).cast("long").alias("seed"))
    for mask in masks:
        needed = [w for w in widths if mask in masks_of(w) and w >= len(mask)]
        fit = items.where(F.least("n", F.lit(WINDOW)).isin(needed)).select("item", "words", F.explode(F.sequence(F.lit(0), F.col("n") - len(mask))).alias("at"))
        own = own.unionByName(fit.select("item", "at", seed(F.col("words"), F.col("at"), mask).alias("seed")))
    return own.distinct(), tuple(masks)


def best_window(words: Column, item: Column, n: Column, shift: Column) -> Column:
    """Most equal tokens in a stretch of the item: struct(equal, item_start), the first of the best."""
    width = F.least(n, F.lit(WINDOW))
    equal = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when((i + shift >= 0) & (F.get(words, F.greatest(i + shift, F.lit(0))) == F.get(item, i)), 1).otherwise(0))
    sums = F.transform(F.sequence(F.lit(0), n - width), lambda s: F.struct(F.aggregate(F.slice(equal, s + 1, width), F.lit(0), lambda a, x: a + x).alias("equal"), (-s).alias("back")))
    return F.array_max(sums)


def _searched(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, share: float, min_tokens: int) -> DataFrame:
    """A row for each document, item and way they lie that agree enough. Documents without id are told apart by a hash of their text."""
    items = benchmark.select(F.col(item_col).alias("item"), tokens(F.col(item_text)).alias("words")).withColumn("n", F.size("words"))
    items = written(items.where(F.col("n") >= max(1, min_tokens)).distinct(), "items")
    own, masks = item_seeds(items)
    own = written(own, "seeds")
    key = F.when(F.col(id_col).isNull(), F.xxhash64(plain_text(F.col(text_col))))
    texts = docs.select(F.col(id_col).alias("id"), key.alias("text_key"), tokens(F.col(text_col)).alias("words"))
    hits = seeds(texts, masks).drop("words").join(small(own.withColumnRenamed("at", "item_at")), "seed")
    hits = written(hits.select("id", "text_key", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "hits")
    pairs = hits.join(small(items.withColumnRenamed("words", "item_words")), hits["item"].eqNullSafe(items["item"])).drop(items["item"])
    pairs = small(written(pairs.withColumnsRenamed({"id": "hit_id", "text_key": "hit_key"}), "pairs"))
    found = texts.join(pairs, texts["id"].eqNullSafe(pairs["hit_id"]) & texts["text_key"].eqNullSafe(pairs["hit_key"])).withColumn("best", best_window(F.col("words"), F.col("item_words"), F.col("n"), F.col("shift")))
    found = found.select("id", "text_key", "item", F.least("n", F.lit(WINDOW)).alias("width"), F.col("best.equal").alias("equal"), (-F.col("best.back")).alias("item_start"), (F.col("shift") - F.col("best.back")).alias("start"))
    return found.where(F.col("equal") >= share * F.col("width"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = SHARE, min_tokens: int = 1) -> DataFrame:
    """A row for each contaminated document and item: id, item, equal, width, start (token of the document), item_start.

    Null texts hold nothing, nor do items without tokens. A document is named by its id: rows with one id, or with null, are reported once. Items with
    a null id are items too. Items of under min_tokens tokens are not looked for; of very short ones every token must be equal. Of several places
    the best counts, of equal ones the first. Only the id and text columns are read. The search is complete down to a share of SHARE.
    """
    found = _searched(docs, benchmark, id_col, text_col, item_col, item_text, share, min_tokens)
    best = found.groupBy("id", "item").agg(F.max(F.struct("equal", "width", (-F.col("start")).alias("back"), "item_start")).alias("b"))
    return best.select("id", "item", "b.equal", "b.width", (-F.col("b.back")).alias("start"), "b.item_start")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = SHARE, min_tokens: int = 1) -> DataFrame:
    """docs without the contaminated ones; same columns. Rows with one id are one document; a row without id goes only if its own text is contaminated."""
    found = _searched(docs, benchmark, id_col, text_col, item_col, item_text, share, min_tokens)
    ident, key = free_name(docs, "bad_id"), free_name(docs, "bad_key")
    bad = small(written(found.select(F.col("id").alias(ident), F.col("text_key").alias(key)).distinct(), "contaminated"))
    own = F.when(docs[id_col].isNull(), F.xxhash64(plain_text(docs[text_col])))
    return docs.join(bad, docs[id_col].eqNullSafe(bad[ident]) & own.eqNullSafe(bad[key]), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items. Null texts hold nothing; rows of one id, or of none, are reported once; other columns are not read."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})
